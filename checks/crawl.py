"""A whole crawl in one job, and streams replayed from driver tables."""

from pyspark.sql import functions as F

from boardwalk.plans.enrich import crawl, rejected_rows, stored_rows
from boardwalk.operators import audit
from checks import fixtures as fx
from checks.feed import heavy_postings as postings
from checks.registry import register
from checks.vendors import DAY, body_of, landed

GREENHOUSE = body_of(
    "jobs",
    f"'id', ord, 'title', title, 'first_published', {DAY}, 'absolute_url', concat('https://x/', ord), "
    "'location', named_struct('name', location), 'content', replace(replace(description, '<', '&lt;'), '>', '&gt;')",
)
LEVER = body_of(
    "",
    "'id', cast(ord as string), 'text', title, 'categories', named_struct('commitment', employment_type, 'location', location), "
    "'createdAt', unix_seconds(cast(posted_at as timestamp)), 'descriptionPlain', description, 'salaryRange', "
    "named_struct('min', salary_min, 'max', salary_max, 'currency', salary_currency)",
    array=True,
)
# Near the end of the order dates, so the three-week window holds some postings.
AT = "1998-06-01 00:00:00"


def enriched(spark, sf_dir, details=None):
    df = postings(spark, sf_dir)
    pages = landed(df.where(F.col("ord") % 2 == 0), "greenhouse", GREENHOUSE, "map()").unionByName(
        landed(df.where(F.col("ord") % 2 == 1), "lever", LEVER, "map()")
    )
    companies = df.select(
        F.explode(F.array(F.lit("greenhouse"), F.lit("lever"))).alias("provider"), "board_token"
    ).distinct().withColumn("company", F.concat(F.lit("Company "), "board_token"))
    return crawl(pages, companies, details, F.lit(AT).cast("timestamp_ntz"), ["greenhouse", "lever"])


@register("crawl_stored")
def crawl_stored(spark, sf_dir):
    return stored_rows(enriched(spark, sf_dir))


@register(
    "crawl_retention_count",
    fx.with_postings(
        f"select count(*) as n from postings where posted_at is null or floor((epoch(timestamp '{AT}') - epoch(posted_at)) / 86400) <= 21"
    ),
)
def crawl_retention_count(spark, sf_dir):
    return enriched(spark, sf_dir).agg(F.count("*").alias("n"))


@register(
    "crawl_with_details",
    fx.with_postings_cte(
        f"p as (select coalesce(posted_at, case when ord % 3 = 0 then timestamp '{AT}' - (ord % 40) * interval '1' day end) as dated_at from postings)",
        f"select count(*) as n, count(dated_at) as dated from p where dated_at is null or floor((epoch(timestamp '{AT}') - epoch(dated_at)) / 86400) <= 21",
    ),
)
def crawl_with_details(spark, sf_dir):
    """Dates that only the details know count for the window, before and after the fill."""
    at = F.lit(AT).cast("timestamp_ntz")
    p = postings(spark, sf_dir).where(F.col("ord") % 3 == 0).select(
        F.when(F.col("ord") % 2 == 0, "greenhouse").otherwise("lever").alias("provider"), "board_token",
        F.col("ord").cast("string").alias("external_id"), F.concat(F.lit("Detail "), F.col("ord").cast("string")).alias("description"),
        (at - F.make_dt_interval(days=(F.col("ord") % 40).cast("int"))).alias("posted_at"),
    )
    rows = enriched(spark, sf_dir, p)
    return rows.agg(F.count("*").alias("n"), F.count("posted_at").alias("dated"))


@register("crawl_tally")
def crawl_tally(spark, sf_dir):
    rejected = rejected_rows(enriched(spark, sf_dir))
    return audit.exclusion_tally(rejected, "pos")
