"""Micro-batch jobs.  A micro-batch may hold any number of crawls.

The batch functions are the same ones the tables are built with in batch mode; these wrappers
load the previous version, apply the batch's crawls one after the other by their time, and store
the next version.  So it makes no difference how a stream is cut into batches, as long as a crawl
arrives in one of them, and a replayed batch gives the same result.
"""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boardwalk.operators.audit import fold_tallies, is_full_pass
from boardwalk.operators.lifecycle import dedupe_batch, healthy_boards, merge_batch, purge_closed
from boardwalk.operators.registry import fold_outcomes
from boardwalk.session import checkpoint as cut
from boardwalk.streaming.buckets import BucketedPostings
from boardwalk.streaming.tables import VersionedTable


def _by_crawl(batch: DataFrame, at: str):
    """(time, rows) of each crawl in the batch, oldest first.  One time per crawl reaches the driver."""
    rows = batch.where(F.col(at).isNotNull()).persist()
    try:
        for when, in rows.select(at).distinct().orderBy(at).collect():
            yield when, rows.where(F.col(at) == F.lit(when).cast("timestamp_ntz"))
    finally:
        rows.unpersist()


def _each_batch(stream: DataFrame, checkpoint: str, step, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_postings_stream(
    sightings: DataFrame, table: VersionedTable, outcomes_of, checkpoint: str,
    at: str = "seen_at", purge: bool = False, once: bool = True,
) -> StreamingQuery:
    """Keep the postings table: upsert, close what vanished, optionally purge.

    ``outcomes_of(batch_time)`` gives the crawl outcomes of that run, or None.  Late
    postings are merged like any other; a closed one that is seen again re-opens.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        if table.has(batch_id):
            return
        state = table.before(batch_id)
        for when, crawled in _by_crawl(batch, at):
            now = F.lit(when).cast("timestamp_ntz")
            rows = dedupe_batch(crawled, [F.col("page"), F.col("pos")])
            outcomes = outcomes_of(when)
            healthy = None if outcomes is None else healthy_boards(outcomes)
            merged = merge_batch(state, rows, healthy, now)
            state = cut(purge_closed(merged, now) if purge else merged)
        table.write(batch_id, state)
        table.forget_before(batch_id)

    return _each_batch(sightings, checkpoint, step, once)


CRAWLS_IN_BATCH = 1_000_000


def write_path_stream(
    sightings: DataFrame, store: BucketedPostings, outcomes_of, checkpoint: str,
    at: str = "seen_at", purge: bool = False, once: bool = True,
) -> StreamingQuery:
    """Keep a bucketed postings table: every crawl is a version that rewrites only the buckets it concerns.

    ``outcomes_of(crawl_time)`` gives the outcomes of that run, or None.  A batch that is replayed
    finds the versions of the crawls that it had finished.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        for turn, (when, crawled) in enumerate(_by_crawl(batch, at)):
            rows = dedupe_batch(crawled, [F.col("page"), F.col("pos")])
            outcomes = outcomes_of(when)
            healthy = None if outcomes is None else healthy_boards(outcomes)
            version = batch_id * CRAWLS_IN_BATCH + turn
            store.apply(version, rows, healthy, when, purge)
            store.forget_before(version)

    return _each_batch(sightings, checkpoint, step, once)


def board_health_stream(
    outcomes: DataFrame, boards: VersionedTable, seed: DataFrame, checkpoint: str,
    at: str = "at", may_retire: bool = True, once: bool = True,
) -> StreamingQuery:
    """Keep the registry's health columns from a stream of crawl outcomes, one new version for each batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if boards.has(batch_id):
            return
        state = boards.before(batch_id) if boards.versions() else seed
        boards.write(batch_id, fold_outcomes(state, batch, at, may_retire))
        boards.forget_before(batch_id)

    return _each_batch(outcomes, checkpoint, step, once)


def tally_stream(
    tallies: DataFrame, table: VersionedTable, marker: VersionedTable, checkpoint: str,
    at: str = "at", once: bool = True,
) -> StreamingQuery:
    """Two-speed exclusion tally.  ``marker`` keeps when the last full pass opened."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if marker.has(batch_id):
            return
        stored = marker.before(batch_id).first()
        opened: datetime | None = stored["window_started_at"] if stored else None
        rows = batch.where(F.col(at).isNotNull()).persist()
        try:
            passes = []
            for when, in rows.select(at).distinct().orderBy(at).collect():  # one time for each crawl
                full, opened = is_full_pass(opened, when)
                passes.append((when, full))
            told = table.spark.createDataFrame(passes, "at timestamp_ntz, full boolean")
            tallies = rows.select("reason", "title", "n", "sample_company", F.col(at).cast("timestamp_ntz").alias("at"))
            table.write(batch_id, fold_tallies(table.before(batch_id), tallies, told))
        finally:
            rows.unpersist()
        row = table.spark.createDataFrame([(opened,)], "window_started_at timestamp_ntz")
        marker.write(batch_id, row)
        for each in (table, marker):
            each.forget_before(batch_id)

    return _each_batch(tallies, checkpoint, step, once)
