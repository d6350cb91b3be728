"""Filtered pages over the postings table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.pay import to_usd
from boardwalk.operators.classify import stack_of
from boardwalk.operators.score import quiet_score, with_fit
from boardwalk.rules.quiet import SYNDICATED_PROVIDERS
from boardwalk.schemas import UNKNOWN, FeedQuery

GHOST_LIMIT = 0.4
TRUE = F.lit


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def before(now: str, days: int) -> Column:
    return ts(now) - F.make_dt_interval(days=F.lit(days))


def dated_since(cutoff: Column, undated: bool = True) -> Column:
    """Posted since the cutoff; undated postings count from when they were first seen."""
    dated = F.col("posted_at") >= cutoff
    if not undated:
        return dated
    return dated | (F.col("posted_at").isNull() & (F.col("first_seen_at") >= cutoff))


def contains_any(q: str, *columns: str) -> Column:
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name), F.lit("")).ilike(f"%{q}%")
    return out


def exactly(column: str, wanted: str) -> Column:
    return F.col(column).isNull() if wanted == UNKNOWN else F.col(column) == wanted


def or_unknown(column: str, wanted: str, keep_unknown: bool) -> Column:
    hit = F.col(column) == wanted
    return hit | F.col(column).isNull() if keep_unknown else hit


def letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z]", ""))


def adjacent_filter(mode: str | None) -> Column:
    flag = F.coalesce("adjacent", F.lit(False))
    return {"include": F.lit(True), "only": flag}.get(mode, ~flag)


def predicates(f: FeedQuery) -> dict[str, Column]:
    """Every active filter by name.  Absent filters are absent."""
    out: dict[str, Column] = {
        "open": F.col("closed_at").isNull(),
        "window": dated_since(before(f.now, f.max_age_days)),
    }
    if f.in_scope:
        out["scope"] = F.col("family").isNotNull()
    if f.family != "unsorted":
        out["not_unsorted"] = F.coalesce("family", F.lit("")) != "unsorted"
    if f.family:
        out["family"] = F.col("family") == f.family
    if f.provider:
        out["provider"] = F.col("provider") == f.provider
    if f.stack:
        out["stack"] = stack_of(F.col("matched_skills")) == f.stack
    if f.specialization:
        out["specialization"] = exactly("specialization", f.specialization)
    if f.country:
        out["country"] = exactly("country", f.country)
    if f.remote:
        out["remote"] = or_unknown("remote_type", f.remote, f.keep_unknown)
    if f.seniority:
        out["seniority"] = or_unknown("seniority", f.seniority, f.keep_unknown)
    if f.employment:
        wanted = "".join(ch for ch in f.employment if ch.isascii() and ch.isalpha()).lower()
        hit = letters(F.coalesce("employment_type", F.lit(""))).contains(wanted)
        out["employment"] = hit | F.col("employment_type").isNull() if f.keep_unknown else hit
    if f.has_salary:
        out["has_salary"] = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    if f.min_salary is not None:
        amount = F.coalesce("salary_max", "salary_min", F.lit(0.0))
        if f.min_salary_in_usd:
            amount = to_usd(amount, F.col("salary_currency"))
        out["min_salary"] = amount >= f.min_salary
    if f.within_days is not None:
        out["within_days"] = dated_since(before(f.now, f.within_days), undated=f.keep_unknown)
    out["adjacent"] = adjacent_filter(f.adjacent)
    if f.ai:
        out["ai"] = F.col("ai")
    if f.hide_ghosts:
        out["ghosts"] = F.coalesce("ghost_risk", F.lit(0.0)) < GHOST_LIMIT
    if f.q:
        out["q"] = contains_any(f.q, "title", "company", "location")
    return out


def filtered(postings: DataFrame, f: FeedQuery) -> DataFrame:
    for condition in predicates(f).values():
        postings = postings.where(condition)
    if f.skills:
        postings = with_fit(postings, F.array(*map(F.lit, f.skills)))
        if f.min_fit is not None:
            postings = postings.where(~F.col("fit_known") | (F.col("fit") >= f.min_fit))
    return postings


def ordering(f: FeedQuery) -> list[Column]:
    first = {
        "newest": F.col("posted_at").desc_nulls_last(),
        "salary": F.coalesce("salary_usd", F.lit(-1.0)).desc(),
        "score": F.col("competition_score").desc_nulls_last(),
    }
    if f.sort == "fit":
        return [F.when(F.col("fit_known"), F.col("fit_confidence")).otherwise(-1.0).desc(), F.col("key")]
    return [first[f.sort], F.col("key")]


def page(postings: DataFrame, f: FeedQuery) -> DataFrame:
    """The asked page: a distributed top-k, never a full sort."""
    rows = filtered(postings, f).orderBy(*ordering(f))
    return rows.offset(f.offset).limit(f.limit)


def sort_value(f: FeedQuery) -> Column:
    """What a page's rows are sorted by before their key; null comes last."""
    values = {
        "newest": F.col("posted_at"),
        "salary": F.coalesce("salary_usd", F.lit(-1.0)),
        "score": F.col("competition_score"),
    }
    return F.when(F.col("fit_known"), F.col("fit_confidence")).otherwise(-1.0) if f.sort == "fit" else values[f.sort]


def page_after(postings: DataFrame, f: FeedQuery, after: tuple | None) -> DataFrame:
    """The page behind the row with sort value and key ``after``; the first page for None.

    Adds ``sort_value``, so that the last row of a page tells where the next begins.  Rows before the
    place are filtered out, not sorted and skipped, so a deep page costs what the first one does.
    """
    rows = filtered(postings, f).withColumn("sort_value", sort_value(f))
    if after is not None:
        value, key = after
        here, later = F.col("sort_value"), F.col("key") > F.lit(key)
        if value is None:
            rows = rows.where(here.isNull() & later)
        else:
            at = F.lit(value).cast(rows.schema["sort_value"].dataType)
            rows = rows.where((here < at) | here.isNull() | ((here == at) & later))
    return rows.orderBy(F.col("sort_value").desc_nulls_last(), "key").limit(f.limit)


def page_with_more(postings: DataFrame, f: FeedQuery) -> DataFrame:
    """The page plus ``has_more``, from one extra row instead of a count."""
    rows = filtered(postings, f).orderBy(*ordering(f)).offset(f.offset).limit(f.limit + 1)
    # At most limit + 1 rows reach this window.
    from pyspark.sql import Window

    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*ordering(f))))
    more = F.max("_n").over(Window.partitionBy(F.lit(1))) > f.limit
    return numbered.withColumn("has_more", more).where(F.col("_n") <= f.limit).drop("_n")


def late_page(postings: DataFrame, f: FeedQuery, columns: list[str]) -> DataFrame:
    """Page of narrow keys first, whole rows joined back: for very wide tables.

    The key side holds at most ``limit`` rows, so broadcasting it is safe.
    """
    keys = page(postings, f).select("key")
    return postings.join(F.broadcast(keys), "key").select(*columns)


def counts(postings: DataFrame, f: FeedQuery) -> DataFrame:
    """Matched rows, and how many of them are undated."""
    return filtered(postings, f).agg(
        F.count("*").alias("total"), F.count_if(F.col("posted_at").isNull()).alias("undated")
    )


def unknowns(page_rows: DataFrame, f: FeedQuery, undated: int | Column = 0) -> DataFrame:
    """Rows of a page that only passed because unknown values are kept."""
    def n(column: str, active) -> Column:
        return F.count_if(F.col(column).isNull()) if active else F.lit(0).cast("bigint")

    undated = undated if isinstance(undated, Column) else F.lit(undated)
    return page_rows.agg(
        F.lit(0).cast("bigint").alias("country"),
        n("seniority", f.seniority).alias("seniority"),
        n("remote_type", f.remote).alias("remote"),
        n("employment_type", f.employment).alias("employment"),
        (undated if f.within_days else F.lit(0)).cast("bigint").alias("posted_within"),
    )


def in_scope_total(postings: DataFrame, f: FeedQuery) -> DataFrame:
    """Open postings with a family inside the window, whatever else is filtered."""
    return postings.where(
        F.col("closed_at").isNull()
        & F.col("family").isNotNull()
        & dated_since(before(f.now, f.max_age_days))
    ).agg(F.count("*").alias("in_scope"))


def refresh_window(runs: DataFrame, minutes: int = 30) -> DataFrame:
    """Newest finish and the postings scanned by every run within it (shards add up)."""
    finished = runs.where(F.col("finished_at").isNotNull())
    newest = finished.agg(F.max("finished_at").alias("refreshed_at"))
    recent = F.col("finished_at") > F.col("refreshed_at") - F.make_dt_interval(mins=F.lit(minutes))
    # One-row side.
    return (
        finished.join(F.broadcast(newest), F.col("finished_at") <= F.col("refreshed_at"))
        .groupBy("refreshed_at")
        .agg(F.coalesce(F.sum(F.when(recent, F.col("jobs_scanned"))), F.lit(0)).alias("scanned"))
    )


FEED_COLUMNS = [
    "key", "title", "company", "provider", "location", "country", "region", "remote_type",
    "seniority", "employment_type", "department", "salary_min", "salary_max",
    "salary_currency", "posted_at", "apply_url", "family", "adjacent", "sector",
    "specialization", "ai", "matched_skills", "skill_score", "ghost_risk",
]


def to_feed_row(postings: DataFrame, now: str) -> DataFrame:
    """Row as shown: defaults filled, age added, classifier-debug columns left out."""
    from boardwalk.functions.dates import age_days

    shown = postings.select(*FEED_COLUMNS)
    return shown.withColumns(
        {
            "adjacent": F.coalesce("adjacent", F.lit(False)),
            "ai": F.coalesce("ai", F.lit(False)),
            "matched_skills": F.coalesce("matched_skills", F.array().cast("array<string>")),
            "skill_score": F.coalesce("skill_score", F.lit(0)),
            "ghost_risk": F.coalesce("ghost_risk", F.lit(0.0)),
            "age_days": age_days(F.col("posted_at"), ts(now)),
            "in_scope": F.col("family").isNotNull(),
        }
    )


def hide_seen(postings: DataFrame, marks: DataFrame, user: str) -> DataFrame:
    seen = marks.where((F.col("user_id") == user) & F.col("seen"))
    return postings.join(seen.selectExpr("job_key as key"), "key", "left_anti")


def only_applied(postings: DataFrame, marks: DataFrame, user: str) -> DataFrame:
    applied = marks.where((F.col("user_id") == user) & F.col("applied"))
    return postings.join(applied.selectExpr("job_key as key"), "key", "left_semi")


def posting_by_key(postings: DataFrame, key: str) -> DataFrame:
    return postings.where(F.col("key") == key)


def with_board_extra(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """Workday postings get the address of the first of their boards with host and site."""
    usable = boards.where(
        F.element_at("extra", "host").isNotNull() & F.element_at("extra", "site").isNotNull()
    )
    first = usable.groupBy("provider", F.col("token").alias("board_token")).agg(
        F.min_by(
            F.struct(F.element_at("extra", "host").alias("host"), F.element_at("extra", "site").alias("site")),
            F.element_at("extra", "site"),
        ).alias("address")
    )
    only = first.where(F.col("provider") == "workday")
    return postings.join(only, ["provider", "board_token"], "left").select(
        *postings.columns,
        F.col("address.host").alias("board_host"),
        F.col("address.site").alias("board_site"),
    )


# ------------------------------------------------------------------------------- pages


def quiet_filter(
    now: str,
    max_age_days: int,
    on_site: bool = False,
    no_entry: bool = False,
    mid_market: bool = False,
    seniority: str | None = None,
    paid_only: bool = False,
    q: str | None = None,
    country: str | None = None,
) -> Column:
    """Quiet page filter.  ``<>`` drops unknown values on purpose."""
    keep = (
        F.col("closed_at").isNull()
        & F.col("quiet")
        & (F.col("adjacent") == F.lit(False))
        & dated_since(before(now, max_age_days))
    )
    if on_site:
        keep = keep & (F.col("remote_type") != "fully_remote")
    if no_entry:
        keep = keep & (F.col("seniority") != "entry")
    if mid_market:
        keep = keep & ~F.col("provider").isin(SYNDICATED_PROVIDERS)
    if seniority:
        keep = keep & (F.col("seniority") == seniority)
    if paid_only:
        keep = keep & F.col("salary_min").isNotNull()
    if q:
        keep = keep & contains_any(q, "title", "company")
    if country:
        keep = keep & exactly("country", country)
    return keep


def quiet_page(
    postings: DataFrame, family: str, now: str, max_age_days: int,
    ranked: bool = False, offset: int = 0, limit: int = 50, pool: int | None = None, **options,
) -> DataFrame:
    """Newest quiet postings; ``ranked`` orders all of them, or the newest ``pool``, by quiet score."""
    rows = postings.where(quiet_filter(now, max_age_days, **options) & (F.col("family") == family))
    newest = [F.col("posted_at").desc_nulls_last(), F.col("key")]
    if not ranked:
        return rows.orderBy(*newest).offset(offset).limit(limit)
    rows = rows if pool is None else rows.orderBy(*newest).limit(pool)
    scored = rows.withColumn(
        "quiet_score", quiet_score(F.col("provider"), F.col("remote_type"), F.col("seniority"))
    )
    return scored.orderBy(F.col("quiet_score").desc(), "key").offset(offset).limit(limit)


def institution_filter(
    now: str, max_age_days: int, family: str | None = None, quiet: bool = False
) -> Column:
    keep = (
        F.col("closed_at").isNull()
        & F.col("sector").isNotNull()
        & F.col("family").isNotNull()
        & (F.col("adjacent") == F.lit(False))
        & dated_since(before(now, max_age_days))
    )
    if family:
        keep = keep & (F.col("family") == family)
    if quiet:
        keep = keep & F.col("quiet")
    return keep


def institution_page(
    postings: DataFrame, now: str, max_age_days: int, sector: str | None = None,
    specialization: str | None = None, q: str | None = None, country: str | None = None,
    offset: int = 0, limit: int = 50, **options,
) -> DataFrame:
    keep = institution_filter(now, max_age_days, **options)
    if sector:
        keep = keep & (F.col("sector") == sector)
    if specialization:
        keep = keep & (F.col("specialization") == specialization)
    if q:
        keep = keep & contains_any(q, "title", "company")
    if country:
        keep = keep & exactly("country", country)
    rows = postings.where(keep).orderBy(F.col("posted_at").desc_nulls_last(), "key")
    return rows.offset(offset).limit(limit)


def state_filter(
    region: str, now: str, max_age_days: int, workplace: str | None = None,
    seniority: str | None = None, paid_only: bool = False, q: str | None = None,
) -> Column:
    keep = (
        F.col("closed_at").isNull()
        & (F.col("region") == region)
        & F.col("family").isNotNull()
        & dated_since(before(now, max_age_days))
    )
    if workplace:
        keep = keep & (F.col("remote_type") == workplace)
    if seniority:
        keep = keep & (F.col("seniority") == seniority)
    if paid_only:
        keep = keep & F.col("salary_min").isNotNull()
    if q:
        keep = keep & contains_any(q, "title", "company")
    return keep


def state_page(
    postings: DataFrame, region: str, families: list[str], now: str, max_age_days: int,
    offset: int = 0, limit: int = 50, **options,
) -> DataFrame:
    rows = postings.where(
        state_filter(region, now, max_age_days, **options) & F.col("family").isin(families)
    )
    return rows.orderBy(F.col("posted_at").desc_nulls_last(), "key").offset(offset).limit(limit)
