"""Exclusion tally, reports and coverage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.match import folded, hit
from boardwalk.functions.text import audit_title
from boardwalk.operators.classify import UNMATCHED
from boardwalk.schemas import EXCLUSIONS

FULL_PASS_HOURS = 20
WINDOW_MINUTES = 30
# Fixed value: a rejected title holding one of these deserves a second look.
SUSPECT = (
    r"\b(engineer|engineering|developer|architect|administrator|programmer|sre|devops|scientist|"
    r"analyst|technical|systems?|cloud|data|software|platform|infrastructure|security|network|"
    r"database|integration|automation)\b"
)


def exclusion_tally(rejected: DataFrame, pos: str, top: int | None = None) -> DataFrame:
    """(reason, title, n, sample_company) of postings without a family.

    All titles, or with ``top`` the most frequent ones.  The sample is the company of the first posting by ``pos``.
    """
    rows = rejected.where(F.col("family").isNull()).select(
        F.coalesce("excluded_reason", F.lit(UNMATCHED)).alias("reason"),
        audit_title(F.col("title")).alias("title"), "company", pos,
    )
    tally = (
        rows.where(F.length("title") > 0)
        .groupBy("reason", "title")
        .agg(F.count("*").alias("n"), F.min_by("company", pos).alias("sample_company"))
    )
    return tally if top is None else tally.orderBy(F.col("n").desc(), "reason", "title").limit(top)


def merge_tally(table: DataFrame, tally: DataFrame, at: Column, full: Column | bool) -> DataFrame:
    """Add a tally to the exclusions table.

    A full pass adds counts, moves ``last_seen_at`` and fills a missing sample.  A quick
    pass only inserts titles never seen before.
    """
    full = F.lit(full) if isinstance(full, bool) else full
    clean = tally.where(
        F.col("reason").isNotNull() & F.col("title").isNotNull() & (F.col("title") != "")
    )
    new = clean.groupBy("reason", "title").agg(
        F.sum("n").alias("_n"), F.min("sample_company").alias("_sample")
    )
    joined = table.join(new, ["reason", "title"], "full_outer")
    added = F.col("n").isNull()
    touched = F.col("_n").isNotNull() & full
    return joined.select(
        "reason", "title",
        F.when(added, F.col("_n")).when(touched, F.col("n") + F.col("_n")).otherwise(F.col("n"))
        .cast("bigint").alias("n"),
        F.when(added, F.col("_sample"))
        .when(touched, F.coalesce("sample_company", "_sample"))
        .otherwise(F.col("sample_company")).alias("sample_company"),
        F.when(added, at).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(added | touched, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def is_full_pass(window_started, now) -> tuple[bool, object]:
    """(full pass?, window start afterwards) for a tally recorded at ``now``."""
    from datetime import timedelta

    if window_started is None or now - window_started >= timedelta(hours=FULL_PASS_HOURS):
        return True, now
    return now - window_started <= timedelta(minutes=WINDOW_MINUTES), window_started


def _per_crawl(tallies: DataFrame) -> DataFrame:
    """(reason, title, at, n, sample): a crawl's rows of one title added up; rows without either are dropped."""
    return (
        tallies.where(F.coalesce(F.length("title") > 0, F.lit(False)) & F.col("reason").isNotNull())
        .groupBy("reason", "title", "at")
        .agg(F.sum("n").alias("n"), F.min("sample_company").alias("sample"))
    )


def fold_tallies(table: DataFrame, tallies: DataFrame, passes: DataFrame) -> DataFrame:
    """The exclusions table after any number of crawls: the fold of ``merge_tally`` in one join.

    ``tallies`` is (at, reason, title, n, sample_company), ``passes`` (at, full), one row per crawl,
    all later than what ``table`` holds.  Full passes count; of the others only the one that brings a
    title for the first time does.  Crawls of a title add up before the shuffle, so a title that
    every crawl names costs no more than any other.
    """
    full = F.col("full")
    named = F.when(full & F.col("sample").isNotNull(), F.col("at"))
    heard = _per_crawl(tallies).join(passes, "at").groupBy("reason", "title").agg(
        F.sum(F.when(full, F.col("n"))).alias("_full_n"),
        F.max(F.when(full, F.col("at"))).alias("_full_at"),
        F.min_by("sample", named).alias("_full_sample"),
        F.min("at").alias("_first_at"),
        F.min_by(F.struct("n", "full", "sample"), "at").alias("_first"),
    )
    new = F.col("n").isNull()
    brought = F.when(new & ~F.col("_first.full"), F.col("_first.n"))
    total = F.coalesce("n", F.lit(0)) + F.coalesce("_full_n", F.lit(0)) + F.coalesce(brought, F.lit(0))
    return table.join(heard, ["reason", "title"], "full_outer").select(
        "reason", "title", total.cast("bigint").alias("n"),
        F.coalesce(F.col("sample_company"), F.when(new, F.col("_first.sample")), F.col("_full_sample")).alias("sample_company"),
        F.when(new, F.col("_first_at")).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.greatest(F.col("last_seen_at"), F.when(new, F.col("_first_at")), F.col("_full_at")).alias("last_seen_at"),
    )


def replay_tally(tallies: DataFrame, passes: DataFrame) -> DataFrame:
    """Exclusions table after many tallies at once, from nothing."""
    return fold_tallies(tallies.sparkSession.createDataFrame([], EXCLUSIONS), tallies, passes)


def exclusion_report(exclusions: DataFrame) -> DataFrame:
    """(reason, n, share, titles): share of all discards in percent."""
    by_reason = exclusions.groupBy("reason").agg(
        F.sum("n").alias("n"), F.count("*").alias("titles")
    )
    # One row: the total of a table that is one row per reason.
    total = by_reason.agg(F.sum("n").alias("_total"))
    return by_reason.join(F.broadcast(total), F.col("n") <= F.col("_total")).select(
        "reason", "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("share"), "titles"
    )


def suspect_titles(exclusions: DataFrame) -> DataFrame:
    folded_title = exclusions.withColumn("_t", folded(F.col("title")))
    return folded_title.where(hit("_t", SUSPECT)).drop("_t")


def reasons(exclusions: DataFrame) -> DataFrame:
    return exclusions.select("reason").distinct()


def field_coverage(
    postings: DataFrame, fields: list[str], minimum: dict[str, int] | None = None
) -> DataFrame:
    """(provider, rows, <field>_pct ..., enough): fill percentage per vendor."""
    def filled(name: str) -> Column:
        c = F.col(name)
        return F.coalesce(c.cast("string") != "", F.lit(False))

    out = postings.groupBy("provider").agg(
        F.count("*").alias("rows"),
        *[
            F.floor(100 * F.count_if(filled(f)) / F.count("*") + 0.5).cast("int").alias(f"{f}_pct")
            for f in fields
        ],
    )
    floors = F.create_map(*[F.lit(x) for p in (minimum or {"": 0}).items() for x in p])
    return out.withColumn(
        "enough", F.col("rows") >= F.coalesce(F.element_at(floors, F.col("provider")), F.lit(0))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) with NULL as its own value; percent rounded to whole numbers."""
    grouped = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = grouped.agg(F.sum("n").alias("_total"))
    return grouped.join(F.broadcast(total), F.col("n") <= F.col("_total")).select(
        "value", "n", F.floor(100 * F.col("n") / F.col("_total") + 0.5).cast("int").alias("pct")
    )
