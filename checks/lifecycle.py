"""Postings over time, board registry, audit and users."""

from pyspark.sql import functions as F

from boardwalk.operators import audit, keys, lifecycle, registry, users
from boardwalk.rules.specializations import CLASSIFICATION_VERSION
from boardwalk.session import shared_folder
from boardwalk.sources import landed
from checks import fixtures as fx
from checks.classify import CLASSIFIED, spec_sql
from checks.feed import heavy_postings, postings
from checks.registry import register
from checks.text import STATE_SQL

NOW_SQL = f"timestamp '{fx.NOW}'"


def now():
    return F.lit(fx.NOW).cast("timestamp_ntz")


STATE_COLUMNS = ["key", "provider", "board_token", "title", "first_seen_at", "last_seen_at", "closed_at"]


def current(spark, sf_dir):
    """Stored table: the older two thirds of the postings."""
    return postings(spark, sf_dir).where(F.col("ord") % 3 != 0).withColumn(
        "last_seen_at", F.col("first_seen_at")
    ).select(*STATE_COLUMNS)


def batch(spark, sf_dir):
    """New batch: some stored keys (retitled), some new ones, some keys twice."""
    df = postings(spark, sf_dir).where(F.col("ord") % 5 != 0)
    df = df.withColumn("title", F.concat("title", F.lit(" *"))).withColumn("pos", F.col("ord"))
    twice = df.where(F.col("ord") % 4 == 0).withColumn("title", F.lit("late copy")).withColumn(
        "pos", F.col("ord") + 1_000_000
    )
    return df.unionByName(twice).select("key", "provider", "board_token", "title", "pos")


OUTCOME_SITES = (
    "select distinct case o_orderkey % 6 when 0 then 'greenhouse' when 1 then 'lever' when 2 then 'workday' when 3 then 'ukg' "
    "when 4 then 'icims' else 'ashby' end as provider, 'c' || cast(o_custkey % 50 as string) as token, "
    "'s' || cast(o_custkey % 2 as string) as site, cast(o_custkey % 7 as int) as jobs, "
    "case when o_custkey % 50 < 5 and o_custkey % 3 = 0 then 'boom' end as error from orders"
)
HEALTHY = (
    f"oc as ({OUTCOME_SITES}), healthy as (select provider, token as board_token from oc where token <> '' "
    "group by 1, 2 having bool_and(error is null and jobs > 0))"
)
# Boards are read by customer, so most fail through a zero count; a milder table closes more.
MILD = OUTCOME_SITES.replace("cast(o_custkey % 7 as int)", "1 + cast(o_custkey % 7 as int)")
MILD_HEALTHY = HEALTHY.replace(OUTCOME_SITES, MILD)
TABLES = f"""{MILD_HEALTHY},
cur as (select key, provider, board_token, title, first_seen_at, first_seen_at as last_seen_at, closed_at from postings where ord % 3 <> 0),
bt as (select key, provider, board_token, title || ' *' as title from postings where ord % 5 <> 0)"""


def mild_healthy(spark, sf_dir):
    return lifecycle.healthy_boards(fx.from_sql(spark, sf_dir, MILD, "orders"))


def deduped(spark, sf_dir):
    return lifecycle.dedupe_batch(batch(spark, sf_dir), [F.col("pos")]).drop("pos")


@register("batch_dedupe", fx.with_postings("select key, title || ' *' as title from postings where ord % 5 <> 0"))
def batch_dedupe(spark, sf_dir):
    return deduped(spark, sf_dir).select("key", "title")


@register("healthy_boards", f"with {MILD_HEALTHY} select * from healthy")
def healthy(spark, sf_dir):
    return mild_healthy(spark, sf_dir)


@register(
    "upsert_jobs",
    fx.with_postings_cte(
        TABLES,
        f"select coalesce(b.key, c.key) as key, coalesce(b.provider, c.provider) as provider, coalesce(b.board_token, c.board_token) as board_token, "
        f"coalesce(b.title, c.title) as title, coalesce(c.first_seen_at, {NOW_SQL}) as first_seen_at, "
        f"case when b.key is not null then {NOW_SQL} else c.last_seen_at end as last_seen_at, "
        "case when b.key is null then c.closed_at end as closed_at from cur c full outer join bt b on b.key = c.key",
    ),
)
def upsert_jobs(spark, sf_dir):
    return lifecycle.merge_batch(current(spark, sf_dir), deduped(spark, sf_dir), None, now())


@register(
    "close_vanished",
    fx.with_postings_cte(
        TABLES,
        "select c.key from cur c join healthy h using (provider, board_token) where closed_at is null and key not in (select key from bt)",
    ),
)
def close_vanished(spark, sf_dir):
    gone = lifecycle.vanished(current(spark, sf_dir), deduped(spark, sf_dir), mild_healthy(spark, sf_dir))
    return gone.select("key")


@register(
    "merge_and_close",
    fx.with_postings_cte(
        TABLES,
        f"select coalesce(b.key, c.key) as key, coalesce(b.title, c.title) as title, coalesce(c.first_seen_at, {NOW_SQL}) as first_seen_at, "
        f"case when b.key is not null then null when c.closed_at is null and h.provider is not null then {NOW_SQL} else c.closed_at end as closed_at "
        "from cur c full outer join bt b on b.key = c.key left join healthy h on h.provider = c.provider and h.board_token = c.board_token",
    ),
)
def merge_and_close(spark, sf_dir):
    merged = lifecycle.merge_batch(
        current(spark, sf_dir), deduped(spark, sf_dir), mild_healthy(spark, sf_dir), now()
    )
    return merged.select("key", "title", "first_seen_at", "closed_at")


@register(
    "purge_closed",
    fx.with_postings_cte(
        f"going as (select key from postings where closed_at < {NOW_SQL} - interval '7' day)",
        "select key from postings where key not in (select key from going)",
    ),
)
def purge_closed(spark, sf_dir):
    return lifecycle.purge_closed(postings(spark, sf_dir), now()).select("key")


@register(
    "run_log",
    "with outcomes as (" + fx.OUTCOMES_SQL + ") select timestamp '2001-08-01 00:00:00' as started_at, timestamp '2001-08-02 00:00:00' as finished_at, "
    "count(*) as boards_total, count(*) filter (where error is null) as boards_ok, count(*) filter (where error is not null) as boards_failed, "
    "cast(sum(jobs) as bigint) as jobs_scanned, cast(10 as bigint) as jobs_upserted, cast(3 as bigint) as jobs_closed from outcomes",
)
def run_log(spark, sf_dir):
    out = fx.outcomes(spark, sf_dir)
    scanned = out.agg(F.sum("jobs")).first()[0]
    return lifecycle.run_log(out, scanned, 10, 3, "2001-08-01 00:00:00", "2001-08-02 00:00:00")


SIGHTINGS = """select key, provider, board_token, title || ' #' || cast(b.i as string) as title,
  timestamp '2001-01-01 00:00:00' + b.i * interval '1' day as seen_at, b.i as i
from {p} p join (values (0), (1), (2), (3), (4)) as b(i) on (p.ord + b.i) % 3 <> 0 or p.ord % 4 = 0"""
BOARD_RUNS = """select distinct provider, board_token, timestamp '2001-01-01 00:00:00' + b.i * interval '1' day as run_at, b.i as i
from {p} p join (values (0), (1), (2), (3), (4)) as b(i) on (length(p.board_token) + b.i) % 3 <> 1"""


@register(
    "lifecycle_replay",
    fx.with_postings_cte(
        f"s as ({SIGHTINGS.replace('{p}', 'postings')}), r as ({BOARD_RUNS.replace('{p}', 'postings')}), "
        "k as (select key, provider, board_token, arg_max(title, seen_at) as title, min(seen_at) as first_seen_at, max(seen_at) as last_seen_at from s group by 1, 2, 3)",
        "select key, title, first_seen_at, last_seen_at, (select min(run_at) from r where r.provider = k.provider and r.board_token = k.board_token "
        "and run_at > k.last_seen_at) as closed_at from k",
    ),
)
def lifecycle_replay(spark, sf_dir):
    p = postings(spark, sf_dir)
    seen = spark.sql(SIGHTINGS, p=p).drop("i")
    runs = spark.sql(BOARD_RUNS, p=p).drop("i")
    return lifecycle.replay(seen, runs).select("key", "title", "first_seen_at", "last_seen_at", "closed_at")


IDENTITY = (
    "board_token || '|' || title || '|' || coalesce(trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g')), '')"
)


@register(
    "repost_events",
    fx.with_postings_cte(
        f"x as (select *, {IDENTITY} as ident from postings)",
        "select key, previous_key, round((epoch(first_seen_at) - epoch(closed_at)) / 86400, 2) as gap_days from ("
        "select n.key, o.key as previous_key, n.first_seen_at, o.closed_at, row_number() over (partition by n.key order by o.closed_at desc, o.key desc) as rn "
        "from x n join x o on o.provider = n.provider and o.ident = n.ident and o.closed_at <= n.first_seen_at and o.closed_at is not null "
        ") where rn = 1 and key <> previous_key",
    ),
)
def repost_events(spark, sf_dir):
    p = postings(spark, sf_dir)
    return lifecycle.reposts(p, p)


@register(
    "content_changes",
    fx.with_postings("select key from postings where ord % 6 = 0 or (ord % 7 = 0 and salary_max is not null)"),
)
def content_changes(spark, sf_dir):
    p = postings(spark, sf_dir)
    later = p.withColumn("title", F.when(F.col("ord") % 6 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    later = later.withColumn(
        "salary_max", F.when(F.col("ord") % 7 == 0, F.col("salary_max") + 1).otherwise(F.col("salary_max"))
    )
    return lifecycle.content_changes(p, later).select("key")


@register(
    "retention",
    fx.with_postings(f"select key from postings where posted_at is null or floor((epoch({NOW_SQL}) - epoch(posted_at)) / 86400) <= 365"),
)
def retention(spark, sf_dir):
    return lifecycle.retained(postings(spark, sf_dir), now(), 365).select("key")


LACKING = "d as (select *, case when ord % 2 = 0 then description end as have from postings)"


@register(
    "detail_backfill",
    fx.with_postings_cte(
        f"{LACKING}, t as (select key from d "
        "where coalesce(have, '') = '' or posted_at is null)",
        "select d.key, coalesce(nullif(d.have, ''), case when t.key is not null and d.ord % 3 <> 0 then 'Detail ' || cast(d.ord as varchar) end, d.have) as description, "
        "coalesce(d.posted_at, case when t.key is not null and d.ord % 3 <> 0 then d.first_seen_at end) as posted_at from d left join t on t.key = d.key",
    ),
)
def detail_backfill(spark, sf_dir):
    p = postings(spark, sf_dir)
    listed = p.withColumns(
        {"description": F.when(F.col("ord") % 2 == 0, F.col("description")), "external_id": F.col("ord").cast("string"), "pos": F.col("ord")}
    ).select("key", "provider", "board_token", "external_id", "description", "posted_at", "pos")
    details = p.where(F.col("ord") % 3 != 0).select(
        "provider", "board_token", F.col("ord").cast("string").alias("external_id"),
        F.concat(F.lit("Detail "), F.col("ord").cast("string")).alias("description"),
        F.col("first_seen_at").alias("posted_at"),
    )
    return lifecycle.backfill_details(listed, details, ["pos"]).select("key", "description", "posted_at")


_SORTED = "case when ord % 4 = 0 then family end as core_family, case when ord % 3 = 1 then 'unsorted' else family end as sorted_as"


@register(
    "review_details",
    fx.with_postings_cte(
        f"c as (select *, {_SORTED} from postings), r as (select key, row_number() over (partition by provider, board_token order by ord) as rn "
        "from c where core_family is null and sorted_as = 'unsorted'), "
        "t as (select key from c where core_family is not null union all select key from r where rn <= 3)",
        "select c.key, case when t.key is not null and ord % 5 <> 0 then 'Detail ' || cast(ord as varchar) end as description from c left join t on t.key = c.key",
    ),
)
def review_details(spark, sf_dir):
    p = postings(spark, sf_dir).selectExpr("*", _SORTED.split(", case")[0], "case" + _SORTED.split(", case")[1])
    listed = p.select(
        "key", "provider", "board_token", F.col("ord").cast("string").alias("external_id"), F.lit(None).cast("string").alias("description"),
        "posted_at", "ord", "core_family", F.col("sorted_as").alias("family"),
    )
    details = p.where(F.col("ord") % 5 != 0).select(
        "provider", "board_token", F.col("ord").cast("string").alias("external_id"),
        F.concat(F.lit("Detail "), F.col("ord").cast("string")).alias("description"), F.col("first_seen_at").alias("posted_at"),
    )
    return lifecycle.fill_candidates(listed, details, ["ord"], review_cap=3).select("key", "description")


@register("feed_snapshot", fx.with_postings_cte("s as (select * from postings)", "select key, title, company, salary_max, posted_at, closed_at from s"))
def feed_snapshot(spark, sf_dir):
    """The whole feed written as one snapshot and read back by its schema."""
    rows = postings(spark, sf_dir).select("key", "title", "company", "salary_max", "posted_at", "closed_at")
    path = shared_folder(spark, "snapshot")
    landed.write_snapshot(rows, path)
    return landed.read_snapshot(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


_OLD = "case when ord % 3 = 0 then 'spec-2' when ord % 3 = 1 then 'spec-1' end"


@register(
    "spec_backfill",
    fx.with_postings_cte(
        spec_sql("family").replace("coalesce(description, '')", "''"),
        f"select p.key, case when family is not null and coalesce({_OLD}, '') <> 'spec-2' then s.specialization else p.specialization end as specialization, "
        f"case when family is not null and coalesce({_OLD}, '') <> 'spec-2' then 'spec-2' else {_OLD} end as classification_version "
        "from postings p join s3 s on s.key = p.key",
    ),
)
def spec_backfill(spark, sf_dir):
    from boardwalk.operators.classify import with_specialization

    p = postings(spark, sf_dir).withColumns(
        {"classification_version": F.expr(_OLD), "specialization_reason": F.lit(None).cast("string"), "description": F.lit(None).cast("string")}
    )
    out = lifecycle.reclassify_outdated(p, CLASSIFICATION_VERSION, lambda df: with_specialization(df))
    return out.select("key", "specialization", "classification_version")


@register(
    "region_backfill",
    fx.with_postings(
        f"select key, new_region as region from (select key, case when ord % 4 = 0 then 'XX' else region end as old_region, {STATE_SQL} as new_region "
        "from postings where closed_at is null and country = 'US') where old_region is distinct from new_region"
    ),
)
def region_backfill(spark, sf_dir):
    p = postings(spark, sf_dir)
    p = p.withColumn("region", F.when(F.col("ord") % 4 == 0, "XX").otherwise(F.col("region")))
    return lifecycle.recompute_region(p)


# ------------------------------------------------------------------------------- order


@register(
    "interleave",
    "with b as (select event_id, 'p' || cast(cast(floor(sqrt(user_id)) as int) as varchar) as provider from events) "
    "select event_id, (row_number() over (partition by provider order by event_id) - 0.5) / count(*) over (partition by provider) as at from b",
)
def interleave(spark, sf_dir):
    ev = fx.read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("p"), F.floor(F.sqrt("user_id")).cast("int").cast("string")).alias("provider")
    )
    return keys.interleave(ev, "provider", "event_id").select("event_id", "at")


@register(
    "shard_assign",
    "with t as (select event_id, lower(case when event_id % 2 = 0 then 'B' else 'b' end || cast(user_id as varchar)) as tenant from events), "
    "f as (select tenant, dense_rank() over (order by min(event_id)) - 1 as n from t group by 1) "
    "select event_id, cast(n % 8 as int) as shard from t join f using (tenant)",
)
def shard_assign(spark, sf_dir):
    ev = fx.read(spark, sf_dir, "events").select(
        "event_id", F.lit("p").alias("provider"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "B").otherwise("b"), F.col("user_id").cast("string")).alias("token"),
    )
    return keys.shard_of_tenant(ev, 8, "event_id").select("event_id", "shard")


@register(
    "per_board_cap",
    fx.with_postings("select key from postings qualify row_number() over (partition by provider, board_token order by ord) <= 12"),
)
def per_board_cap(spark, sf_dir):
    return keys.cap_per_key(postings(spark, sf_dir), ["provider", "board_token"], [F.col("ord")], 12).select("key")


# ------------------------------------------------------------------------------- audit

TALLY = (
    "tally as (select reason, title, count(*) as n, arg_min(company, ord) as sample_company from (select coalesce(reason, 'no family matched') as reason, "
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[(\\[{][^)\\]}]*[)\\]}]', ' ', 'g'), "
    "'\\s+[-–—]\\s+[^-–—]{1,40}$', ''), '[^a-z0-9+#/&. ]+', ' ', 'g'), '\\s+', ' ', 'g')) as title, company, ord from t8 where fam is null) "
    "where title <> '' group by 1, 2)"
)


def rejected(spark, sf_dir):
    from boardwalk.operators.classify import with_family

    return with_family(heavy_postings(spark, sf_dir).select("key", "company", "title", "description", "ord"))


@register("exclusion_tally", fx.with_postings_cte(f"{CLASSIFIED}, {TALLY}", "select * from tally"))
def exclusion_tally(spark, sf_dir):
    return audit.exclusion_tally(rejected(spark, sf_dir), "ord")


@register(
    "exclusion_report",
    fx.with_postings_cte(
        f"{CLASSIFIED}, {TALLY}",
        "select reason, cast(sum(n) as bigint) as n, round(100 * sum(n) / (select sum(n) from tally), 1) as share, count(*) as titles from tally group by 1",
    ),
)
def exclusion_report(spark, sf_dir):
    return audit.exclusion_report(audit.exclusion_tally(rejected(spark, sf_dir), "ord"))


@register(
    "exclusion_suspects",
    fx.with_postings_cte(
        f"{CLASSIFIED}, {TALLY}",
        "select reason, title, n from tally where regexp_matches(title, '(?i)" + audit.SUSPECT.replace("'", "''") + "')",
    ),
)
def exclusion_suspects(spark, sf_dir):
    return audit.suspect_titles(audit.exclusion_tally(rejected(spark, sf_dir), "ord")).select("reason", "title", "n")


@register("exclusion_reasons", fx.with_postings_cte(f"{CLASSIFIED}, {TALLY}", "select distinct reason from tally"))
def exclusion_reasons(spark, sf_dir):
    return audit.reasons(audit.exclusion_tally(rejected(spark, sf_dir), "ord"))


# Tallies from events: type = reason, user bucket = title, one batch per day.
DAY_TALLY = (
    "select date_trunc('day', ts) as at, event_type as reason, 't' || cast(user_id % 40 as string) as title, count(*) as n, "
    "min('c' || cast(user_id as string)) as sample_company from events group by 1, 2, 3"
)


@register(
    "tally_two_speed",
    f"with b as (select *, \"at\" as d from ({DAY_TALLY})), p as (select d, extract(day from d) % 3 = 1 as fullpass from (select distinct d from b)), "
    "f as (select reason, title, min(d) as first_seen_at from b group by 1, 2), "
    "u as (select b.*, f.first_seen_at from b join f using (reason, title) join p using (d) where fullpass or b.d = f.first_seen_at) "
    "select reason, title, cast(sum(n) as bigint) as n, arg_min(sample_company, d) as sample_company, min(d) as first_seen_at, max(d) as last_seen_at from u group by 1, 2",
)
def tally_two_speed(spark, sf_dir):
    b = fx.from_sql(spark, sf_dir, DAY_TALLY, "events")
    passes = b.select("at").distinct().withColumn("full", F.dayofmonth("at") % 3 == 1)
    return audit.replay_tally(b, passes)


_HALF = "extract(day from d) <= 15"


@register(
    "tally_merge",
    f"with b as (select *, \"at\" as d from ({DAY_TALLY})), old as (select reason, title, sum(n) as n, min(sample_company) as s, min(d) as f, max(d) as l from b where {_HALF} and title <> 't7' group by 1, 2), "
    f"new as (select reason, title, sum(n) as n, min(sample_company) as s from b where not {_HALF} group by 1, 2) "
    "select coalesce(old.reason, new.reason) as reason, coalesce(old.title, new.title) as title, cast(coalesce(old.n, 0) + coalesce(new.n, 0) as bigint) as n, "
    f"coalesce(old.s, new.s) as sample_company, coalesce(old.f, {NOW_SQL}) as first_seen_at, case when new.n is null then old.l else {NOW_SQL} end as last_seen_at "
    "from old full outer join new on old.reason = new.reason and old.title = new.title",
)
def tally_merge(spark, sf_dir):
    b = fx.from_sql(spark, sf_dir, DAY_TALLY, "events")
    half = F.dayofmonth("at") <= 15
    old = b.where(half & (F.col("title") != "t7")).groupBy("reason", "title").agg(
        F.sum("n").alias("n"), F.min("sample_company").alias("sample_company"),
        F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"),
    )
    return audit.merge_tally(old, b.where(~half), now(), True)


@register(
    "field_coverage",
    fx.with_postings(
        "select provider, count(*) as rows, "
        + ", ".join(
            f"cast(floor(100.0 * count(*) filter (where {f} is not null and cast({f} as varchar) <> '') / count(*) + 0.5) as int) as {f}_pct"
            for f in ("posted_at", "remote_type", "description", "salary_min", "location")
        )
        + ", count(*) >= case provider when 'workday' then 100 when 'lever' then 1000000 else 0 end as enough from postings group by 1"
    ),
)
def field_coverage(spark, sf_dir):
    return audit.field_coverage(
        postings(spark, sf_dir), ["posted_at", "remote_type", "description", "salary_min", "location"],
        {"workday": 100, "lever": 1_000_000},
    )


@register(
    "spec_distribution",
    fx.with_postings(
        "select specialization as value, count(*) as n, cast(floor(100.0 * count(*) / (select count(*) from postings) + 0.5) as int) as pct from postings group by 1"
    ),
)
def spec_distribution(spark, sf_dir):
    return audit.distribution(postings(spark, sf_dir), "specialization")


# ------------------------------------------------------------------------------- users


@register(
    "user_marks",
    fx.with_marks('select user_id, job_key, arg_max(seen, event_id) as seen, arg_max(applied, event_id) as applied, arg_max(marks."at", event_id) as "at" from marks group by 1, 2'),
)
def user_marks(spark, sf_dir):
    m = fx.marks(spark, sf_dir)
    old = users.latest_marks(m.where(F.col("event_id") % 2 == 0), F.col("event_id"))
    # The later half of the marks arrives as a batch over everything seen so far.
    return users.merge_marks(old, m, F.col("event_id"))


@register(
    "user_tally",
    fx.with_marks("select user_id, count(*) filter (where applied) as applied, count(*) filter (where seen) as seen from marks group by 1"),
)
def user_tally(spark, sf_dir):
    return users.user_tally(fx.marks(spark, sf_dir))


SEATS = "select cast(c_custkey % 40 as string) as user_id, min(c_name) as email, min(timestamp '2001-01-01 00:00:00') as created_at from customer group by 1"
PROFILES = (
    "select 'u:' || cast(c_custkey % 25 as string) as user_id, max(c_name) as first_name, max(c_mktsegment) as last_name, "
    "cast(count(*) as int) as resume_chars, max(timestamp '2001-02-01 00:00:00') as updated_at, cast(count(distinct c_mktsegment) as int) as n_skills from customer group by 1"
)


@register(
    "admin_rollup",
    f"with marks as ({fx.MARKS_SQL}), t as (select replace(user_id, 'u', 'u:') as k, count(*) filter (where applied) as applied, count(*) filter (where seen) as seen from marks group by 1), "
    f"s as ({SEATS}), p as ({PROFILES}) select email, first_name, last_name, coalesce(applied, 0) as applied, coalesce(seen, 0) as seen, coalesce(n_skills, 0) as skills, "
    "coalesce(resume_chars, 0) as resume_chars, updated_at as last_active, created_at as joined from s left join p on p.user_id = 'u:' || s.user_id left join t on t.k = 'u:' || s.user_id",
)
def admin_rollup(spark, sf_dir):
    seats = fx.from_sql(spark, sf_dir, SEATS, "customer")
    profiles = fx.from_sql(spark, sf_dir, PROFILES, "customer").withColumn(
        "skills", F.expr("transform(sequence(1, n_skills), i -> cast(i as string))")
    )
    m = fx.marks(spark, sf_dir).withColumn("user_id", F.regexp_replace("user_id", "^u", "u:"))
    return users.admin_rollup(seats, profiles, m)


@register(
    "profile_merge",
    "with n as (select c_custkey % 60 as k, max(c_acctbal) as m from customer where c_custkey % 3 = 0 group by 1), "
    "o as (select distinct c_custkey % 60 as k from customer where c_custkey % 2 = 0) "
    "select 'u:' || cast(coalesce(n.k, o.k) as varchar) as user_id, case when n.k is not null then 'new' else 'old' end as first_name from o full outer join n on n.k = o.k",
)
def profile_merge(spark, sf_dir):
    c = fx.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("u:"), (F.col("c_custkey") % 60).cast("string")).alias("user_id"), "c_acctbal", "c_custkey"
    )
    old = c.where(F.col("c_custkey") % 2 == 0).select("user_id", F.lit("old").alias("first_name"), F.lit(0.0).alias("updated_at")).distinct()
    new = c.where(F.col("c_custkey") % 3 == 0).select("user_id", F.lit("new").alias("first_name"), F.col("c_acctbal").alias("updated_at"))
    return users.merge_profiles(old, new).select("user_id", "first_name")


@register(
    "feed_hide_seen",
    fx.with_postings_cte(
        f"marks as ({fx.MARKS_SQL})",
        "select key from (select 'k' || cast(ord % 500 as varchar) as key from postings) where key not in (select job_key from marks where user_id = 'u3' and seen)",
    ),
)
def feed_hide_seen(spark, sf_dir):
    from boardwalk.operators.feed import hide_seen

    p = postings(spark, sf_dir).select(F.concat(F.lit("k"), (F.col("ord") % 500).cast("string")).alias("key"))
    return hide_seen(p, fx.marks(spark, sf_dir), "u3")


@register(
    "feed_only_applied",
    fx.with_postings_cte(
        f"marks as ({fx.MARKS_SQL})",
        "select key from (select 'k' || cast(ord % 500 as varchar) as key from postings) where key in (select job_key from marks where user_id = 'u3' and applied)",
    ),
)
def feed_only_applied(spark, sf_dir):
    from boardwalk.operators.feed import only_applied

    p = postings(spark, sf_dir).select(F.concat(F.lit("k"), (F.col("ord") % 500).cast("string")).alias("key"))
    return only_applied(p, fx.marks(spark, sf_dir), "u3")


SPANS = "select o_custkey as person, o_orderdate as s, o_orderdate + (o_orderkey % 900) * interval '1' day as e from orders"


@register(
    "experience_months",
    f"with x as ({SPANS}), m as (select person, extract(year from s) * 12 + extract(month from s) - 1 as a, extract(year from e) * 12 + extract(month from e) - 1 as b from x), "
    "i as (select *, max(b) over (partition by person order by a, b rows between unbounded preceding and 1 preceding) as before from m where b > a), "
    "g as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by person order by a, b) as island from i), "
    "u as (select person, island, min(a) as a, max(b) as b from g group by 1, 2) "
    "select person, cast(sum(b - a) as bigint) as months, cast(floor(sum(b - a) / 12) as bigint) as years, make_date(min(a) // 12, min(a) % 12 + 1, 1) as from_month from u group by 1",
)
def experience_months(spark, sf_dir):
    return users.experience(fx.from_sql(spark, sf_dir, SPANS, "orders"), "person", "s", "e")

