"""The postings table over time: merge, close, purge, replay, history.

Every step is table in, table out.  Writers are in ``streaming``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.dates import exact_age
from boardwalk.functions.text import content_hash, identity_hash
from boardwalk.operators.keys import cap_per_key, first_per_key
from boardwalk.operators.ordered import last_before

PURGE_AFTER_DAYS = 7


def check_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Same columns and types as the contract, in its order; anything else raises."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(ddl)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [
        f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType.simpleString()}"
        for f in want
        if have.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("table does not fit its schema: " + "; ".join(wrong))
    return df.select(*want.fieldNames())


def dedupe_batch(batch: DataFrame, order: list[Column]) -> DataFrame:
    """First row per key within one batch."""
    return first_per_key(batch, ["key"], order)


def healthy_boards(outcomes: DataFrame) -> DataFrame:
    """(provider, board_token) whose every site answered with postings."""
    fine = F.col("error").isNull() & (F.col("jobs") > 0)
    return (
        outcomes.where(F.coalesce(F.length("token") > 0, F.lit(False)))
        .groupBy("provider", F.col("token").alias("board_token"))
        .agg(F.bool_and(fine).alias("_ok"))
        .where("_ok")
        .drop("_ok")
    )


def _merge_columns(current: DataFrame) -> list[str]:
    return [
        c for c in current.columns if c not in ("key", "first_seen_at", "last_seen_at", "closed_at")
    ]


def merge_batch(
    current: DataFrame, batch: DataFrame, healthy: DataFrame | None, now: Column
) -> DataFrame:
    """Upsert a deduplicated batch and close what vanished, in one pass.

    A key in the batch takes the batch's columns, keeps its ``first_seen_at`` and is
    open again.  An open key that is not in the batch closes when its board was read
    healthily.  With an empty batch, or without ``healthy``, nothing closes.
    """
    columns = _merge_columns(current)
    old = current.select("key", F.struct(*[c for c in current.columns if c != "key"]).alias("o"))
    new = batch.select("key", F.struct(*columns).alias("n"))
    joined = old.join(new, "key", "full_outer")
    seen = F.col("n").isNotNull()
    merged = joined.select(
        "key",
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns],
        F.coalesce(F.col("o.first_seen_at"), now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(~seen, F.col("o.closed_at")).alias("closed_at"),
        seen.alias("_seen"),
    )
    if healthy is None:
        return merged.drop("_seen").select(*current.columns)
    # The batch is empty or not for every row alike: one flag, one row.
    some = batch.limit(1).agg((F.count("*") > 0).alias("_some"))
    boards = healthy.select("provider", "board_token", F.lit(True).alias("_healthy")).join(
        F.broadcast(some), F.col("_some")
    )
    closing = F.col("closed_at").isNull() & ~F.col("_seen") & F.col("_healthy").isNotNull()
    return (
        merged.join(boards, ["provider", "board_token"], "left")
        .withColumn("closed_at", F.when(closing, now).otherwise(F.col("closed_at")))
        .select(*current.columns)
    )


def vanished(current: DataFrame, batch: DataFrame, healthy: DataFrame) -> DataFrame:
    """Open postings of healthy boards that the batch no longer lists."""
    if batch.isEmpty():
        return current.limit(0)
    open_rows = current.where(F.col("closed_at").isNull())
    return open_rows.join(healthy, ["provider", "board_token"], "left_semi").join(
        batch.select("key"), "key", "left_anti"
    ).select(*current.columns)


def purge_closed(
    current: DataFrame, now: Column, days: int = PURGE_AFTER_DAYS, budget: int | None = None
) -> DataFrame:
    """Drop all rows closed longer than ``days``, or with ``budget`` the oldest so many of them."""
    old = F.col("closed_at") < now - F.make_dt_interval(days=F.lit(days))
    if budget is None:
        return current.where(~F.coalesce(old, F.lit(False)))
    going = current.where(old).orderBy("closed_at", "key").limit(budget).select("key")
    return current.join(going, "key", "left_anti").select(*current.columns)


def run_log(outcomes: DataFrame, scanned: int, upserted: int, closed: int, started, finished) -> DataFrame:
    """One row of the run log.  A run that stored nothing must not look fresh."""
    if upserted == 0:
        raise ValueError("the crawl stored no postings; refusing to mark the corpus fresh")
    ok = F.col("error").isNull()
    return outcomes.agg(
        F.count("*").alias("boards_total"),
        F.count_if(ok).alias("boards_ok"),
        F.count_if(~ok).alias("boards_failed"),
    ).select(
        F.lit(started).cast("timestamp_ntz").alias("started_at"),
        F.lit(finished).cast("timestamp_ntz").alias("finished_at"),
        "boards_total", "boards_ok", "boards_failed",
        F.lit(scanned).cast("bigint").alias("jobs_scanned"),
        F.lit(upserted).cast("bigint").alias("jobs_upserted"),
        F.lit(closed).cast("bigint").alias("jobs_closed"),
    )


def replay(sightings: DataFrame, board_runs: DataFrame) -> DataFrame:
    """State after every batch at once: what folding ``merge_batch`` would give.

    ``sightings`` holds (key, provider, board_token, seen_at, ...), ``board_runs``
    (provider, board_token, run_at) of healthy readings.  A posting is closed by the
    first healthy reading of its board after it was last seen.  Purging is left to the
    caller.  Postings and readings are put in one order by board and time, and the next
    reading is carried back to the postings before it, so a board may have any number of both.
    """
    payload = [c for c in sightings.columns if c not in ("key", "seen_at")]
    state = sightings.groupBy("key").agg(
        F.max_by(F.struct(*payload), "seen_at").alias("_payload"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
    ).select("key", "_payload.*", "first_seen_at", "last_seen_at")
    board = ["provider", "board_token"]
    runs = board_runs.select(*board, "run_at").dropna().distinct()
    last = state.select(*board, "key", F.col("last_seen_at").alias("at"), F.lit(None).cast("timestamp_ntz").alias("run_at"))
    events = last.unionByName(runs.select(*board, F.lit(None).cast("string").alias("key"), F.col("run_at").alias("at"), "run_at"))
    # backwards in time; of equal times the postings come first, which a reading at that time does not close
    order = [F.desc("at"), F.col("run_at").asc_nulls_first()]
    closing = last_before(events, board, order, F.col("run_at"), "closed_at").where(
        F.col("key").isNotNull() & F.col("closed_at").isNotNull()
    )
    return state.join(closing.select("key", "closed_at"), "key", "left")


def reposts(postings: DataFrame, prior: DataFrame) -> DataFrame:
    """New postings whose identity was open before: (key, previous_key, gap_days).

    ``prior`` are closed postings; the newest one closed before the posting appeared
    counts.  Closed rows are first reduced to what matters per identity and day.
    """
    def identity(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "identity", identity_hash(F.col("board_token"), F.col("title"), F.col("location"))
        )

    # One identity can be very frequent; join on identity, aggregate at once, and let
    # the newest match win inside the aggregate instead of sorting all matches.
    new = identity(postings).select("key", "provider", "board_token", "identity", "first_seen_at")
    old = identity(prior.where(F.col("closed_at").isNotNull())).select(
        "provider", "identity", F.col("key").alias("previous_key"), "closed_at"
    )
    events = new.select(
        "provider", "identity", F.col("first_seen_at").alias("at"),
        F.struct("key", "first_seen_at").alias("new"),
        F.lit(None).cast("struct<closed_at:timestamp_ntz,previous_key:string>").alias("old"),
    ).unionByName(
        old.select(
            "provider", "identity", F.col("closed_at").alias("at"),
            F.lit(None).cast("struct<key:string,first_seen_at:timestamp_ntz>").alias("new"),
            F.struct("closed_at", "previous_key").alias("old"),
        )
    )
    return _as_of(events)


def _as_of(events: DataFrame) -> DataFrame:
    """Latest ``old`` at or before each ``new`` of an identity, without a pairwise join.

    Events are put in order of identity and time, closings first among equal times, and the
    last closing is carried on, so a frequent identity is spread over many tasks.
    """
    order = [F.col("at"), F.col("old").isNull(), F.col("old.previous_key")]
    found = last_before(events, ["provider", "identity"], order, F.col("old"), "hit").where(F.col("new").isNotNull())
    gap = exact_age(F.col("hit.closed_at"), F.col("new.first_seen_at"))
    return found.where(
        F.col("hit").isNotNull() & (F.col("hit.previous_key") != F.col("new.key"))
    ).select(
        F.col("new.key").alias("key"),
        F.col("hit.previous_key").alias("previous_key"),
        F.round(gap, 2).alias("gap_days"),
    )


def content_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys present in both tables whose content hash differs."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        c = F.col
        return df.select(
            "key",
            content_hash(
                c("title"), c("description"), c("location"), c("salary_min"), c("salary_max"),
                c("employment_type"),
            ).alias(name),
        )

    both = hashed(before, "old_hash").join(hashed(after, "new_hash"), "key")
    return both.where(F.col("old_hash") != F.col("new_hash"))


def retained(postings: DataFrame, now: Column, days: int) -> DataFrame:
    """Postings inside the window at ingest; undated ones stay."""
    age = F.floor(exact_age(F.col("posted_at"), now))
    return postings.where(F.col("posted_at").isNull() | (age <= days))


def backfill_details(
    postings: DataFrame, details: DataFrame, order: list[str], cap: int | None = None
) -> DataFrame:
    """Fill missing descriptions and dates from fetched details.

    ``details`` is (provider, board_token, external_id, description, posted_at).  With ``cap`` only
    so many rows of a board are filled, the first by the columns in ``order``.
    """
    board = ["provider", "board_token"]
    lacking = postings.where(
        ~F.coalesce(F.length("description") > 0, F.lit(False)) | F.col("posted_at").isNull()
    )
    targets = lacking.select(*board, "external_id", *order)
    if cap is not None:
        targets = cap_per_key(targets, board, [F.col(c) for c in order], cap)
    chosen = details.join(targets.select(*board, "external_id"), [*board, "external_id"], "left_semi")
    found = first_per_key(chosen, [*board, "external_id"], [F.col("description").desc_nulls_last()])
    found = found.select(
        *board, "external_id",
        F.col("description").alias("_description"), F.col("posted_at").alias("_posted_at"),
    )
    out = postings.join(found, [*board, "external_id"], "left")
    return out.withColumns(
        {
            "description": F.coalesce(
                F.when(F.length("description") > 0, F.col("description")), F.col("_description"),
                F.col("description"),
            ),
            "posted_at": F.coalesce("posted_at", "_posted_at"),
        }
    ).select(*postings.columns)


def backfill_candidates(
    classified: DataFrame, order: list[Column], review_cap: int | None = None
) -> DataFrame:
    """Rows worth a detail fetch: every row with a core family, and of the others those left
    'unsorted' for review, at most ``review_cap`` per board if given.
    """
    core = F.col("core_family").isNotNull()
    review = classified.where(~core & (F.col("family") == "unsorted"))
    if review_cap is not None:
        review = cap_per_key(review, ["provider", "board_token"], order, review_cap)
    return classified.where(core).unionByName(review)


def fill_candidates(
    classified: DataFrame, details: DataFrame, order: list[str], review_cap: int | None = None
) -> DataFrame:
    """All rows; descriptions and dates filled from ``details`` for those worth a detail fetch."""
    place = ["provider", "board_token", "external_id"]
    worth = backfill_candidates(classified, [F.col(c) for c in order], review_cap).select(*place)
    return backfill_details(classified, details.join(worth, place, "left_semi"), order)


def reclassify_outdated(postings: DataFrame, version: str, classify) -> DataFrame:
    """Run ``classify`` on rows without the current version only; the rest pass through."""
    current = F.coalesce(F.col("classification_version") == version, F.lit(False))
    in_family = F.col("family").isNotNull()
    stale = postings.where(in_family & ~current)
    return postings.where(~in_family | current).unionByName(
        classify(stale).select(*postings.columns)
    )


def recompute_region(postings: DataFrame) -> DataFrame:
    """(key, region) of open US postings whose stored state is out of date."""
    from boardwalk.functions.geo import us_state

    rows = postings.where(F.col("closed_at").isNull() & (F.col("country") == "US"))
    fresh = rows.select(
        "key", F.col("region").alias("_old"), us_state("location", "country").alias("region")
    )
    return fresh.where(~F.col("_old").eqNullSafe(F.col("region"))).select("key", "region")
