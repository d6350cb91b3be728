"""The bucketed postings table: the fold's results, and what it reads and writes."""

import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boardwalk.operators import lifecycle
from boardwalk.streaming import jobs
from boardwalk.streaming.buckets import BucketedPostings, Layout, run_log

T0 = datetime(2026, 1, 1)
STATE = (
    "key string, provider string, board_token string, title string, first_seen_at timestamp_ntz, "
    "last_seen_at timestamp_ntz, closed_at timestamp_ntz"
)
ROW = "key string, provider string, board_token string, title string"
BOARDS = "provider string, board_token string"


def crawl(rng, day):
    """Some boards, some of their postings; one board has most of them."""
    boards = [b for b in ["hot", "b1", "b2", "b3", "b4", None] if rng.random() < 0.6]
    rows = [
        (f"{b}:{i}", "a", b, f"t{day}") for b in boards for i in range(60 if b == "hot" else 5) if rng.random() < 0.7
    ]
    return rows, [("a", b) for b in boards if b and rng.random() < 0.8]


def at(day):
    return T0 + timedelta(days=day)


def rows_of(df):
    return sorted(map(tuple, df.select("key", "title", "first_seen_at", "last_seen_at", "closed_at").collect()))


def files(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("part-*.parquet"))


@pytest.mark.parametrize("purge", [False, True])
def test_equals_the_fold_of_the_whole_table(spark, tmp_path, purge):
    rng = random.Random(3)
    store = BucketedPostings(spark, str(tmp_path / "s"), STATE, Layout(buckets=5, files=3))
    state = spark.createDataFrame([], STATE)
    for day in range(0, 20, 4):
        rows, healthy = crawl(rng, day)
        batch, healthy = spark.createDataFrame(rows, ROW), spark.createDataFrame(healthy, BOARDS)
        size = state.count()
        merged = lifecycle.merge_batch(state, batch, healthy, F.lit(at(day)).cast("timestamp_ntz"))
        left = lifecycle.purge_closed(merged, F.lit(at(day)).cast("timestamp_ntz")) if purge else merged
        was, state = state, spark.createDataFrame(left.collect(), STATE)
        store.apply(day, batch, healthy, at(day), purge)
        assert rows_of(store.read()) == rows_of(state)
        assert rows_of(store.read(open_only=True)) == rows_of(state.where("closed_at is null"))
        facts = store.facts(day).first()
        opened = was.where("closed_at is not null").join(batch, "key", "left_semi").count()
        new = batch.join(was, "key", "left_anti").count()
        assert (facts.scanned, facts.upserted, facts.inserted, facts.reopened) == (len(rows), len(rows), new, opened)
        assert facts.closed == state.where(F.col("closed_at") == F.lit(at(day))).count()
        assert facts.purged == size + new - state.count()


@pytest.fixture
def filled(spark, tmp_path):
    store = BucketedPostings(spark, str(tmp_path / "s"), STATE, Layout(buckets=8))
    rows = [(f"b{b}:{i}", "a", f"b{b}", "old") for b in range(20) for i in range(4)]
    store.apply(0, spark.createDataFrame(rows, ROW), None, at(0))
    store.apply(1, spark.createDataFrame([r for r in rows if r[0].endswith((":0", ":1"))], ROW), spark.createDataFrame([("a", f"b{b}") for b in range(20)], BOARDS), at(1))
    return store, tmp_path / "s"


def test_other_buckets_are_neither_read_nor_written(spark, filled):
    store, root = filled
    batch = spark.createDataFrame([("b3:0", "a", "b3", "new")], ROW)
    own = store.concerned(batch, None)
    assert len(own) == 1
    for state in (root / "data").glob("v=*/closed=*/bucket=*"):
        if int(state.name.split("=")[1]) not in own:
            shutil.move(state, f"{state}-away")  # nothing can read it there
    before = set(files(root / "data"))
    store.apply(2, batch, spark.createDataFrame([("a", "b3")], BOARDS), at(2))
    written = [f for f in files(root / "data") if f not in before]
    assert written and {int(f.split("bucket=")[1].split("/")[0]) for f in written} == own
    facts = store.facts(2).first()
    assert (facts.buckets_read, facts.buckets_written, facts.upserted, facts.closed) == (1, 1, 1, 1)
    named = {(r["bucket"], r["wrote"]) for r in store.manifest()}
    assert {b for b, wrote in named if wrote == 2} == own and len({b for b, _ in named}) > 3


def test_open_rows_come_from_open_files_only(filled):
    store, _ = filled
    assert any("closed=true" in f for f in store.read().inputFiles())
    assert store.read(open_only=True).inputFiles() and not any("closed=true" in f for f in store.read(open_only=True).inputFiles())


def test_a_version_counts_once_its_manifest_is_there(spark, filled):
    store, root = filled
    want = rows_of(store.read())
    shutil.copytree(root / "data" / "v=000000000001", root / "data" / "v=000000000002")  # a crawl that died
    assert rows_of(store.read()) == want
    batch = spark.createDataFrame([("b3:0", "a", "b3", "new")], ROW)
    store.apply(2, batch, None, at(2))
    once = rows_of(store.read())
    assert len(once) == len(want) and once != want
    store.apply(2, spark.createDataFrame([("x", "a", "b3", "other")], ROW), None, at(3))  # replayed: nothing is done
    assert rows_of(store.read()) == once
    store.apply(3, spark.createDataFrame([], ROW), spark.createDataFrame([("a", "b3")], BOARDS), at(3))
    assert rows_of(store.read()) == once  # an empty batch closes nothing
    store.forget_before(3, keep=1)
    assert rows_of(store.read()) == once


def test_stream_over_the_store(spark, tmp_path):
    rng = random.Random(8)
    ddl = f"{ROW}, seen_at timestamp_ntz, page int, pos int"
    plan = {day: crawl(rng, day) for day in range(4)}
    for day, (rows, _) in plan.items():
        rows = [(*r, at(day), 1, n) for n, r in enumerate(rows)] + [(*r[:3], "late copy", at(day), 2, n) for n, r in enumerate(rows[:3])]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def outcomes_of(when):
        rows = [(p, b, "", 1, None, None) for p, b in plan[(when - T0).days][1]]
        return spark.createDataFrame(rows, "provider string, token string, site string, jobs int, error string, failure string")

    state = spark.createDataFrame([], STATE)
    for day, (rows, healthy) in plan.items():
        merged = lifecycle.merge_batch(state, spark.createDataFrame(rows, ROW), spark.createDataFrame(healthy, BOARDS), F.lit(at(day)).cast("timestamp_ntz"))
        state = spark.createDataFrame(merged.collect(), STATE)
    for n in (1, 1000):
        store = BucketedPostings(spark, str(tmp_path / f"s{n}"), STATE, Layout(buckets=4))
        source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", n).json(str(tmp_path / "in"))
        jobs.write_path_stream(source, store, outcomes_of, str(tmp_path / f"cp{n}")).awaitTermination()
        assert rows_of(store.read()) == rows_of(state)


def test_run_log_refuses_a_run_without_postings(spark, filled):
    store, _ = filled
    outcomes = spark.createDataFrame([("a", "x", None), ("a", "y", "boom")], "provider string, token string, error string")
    row = run_log(outcomes, store.facts(1), "2026-01-02", "2026-01-03").first()
    assert (row.boards_total, row.boards_ok, row.boards_failed, row.jobs_scanned, row.jobs_upserted, row.jobs_closed) == (2, 1, 1, 40, 40, 40)
    store.apply(5, spark.createDataFrame([], ROW), None, at(5))
    with pytest.raises(Exception, match="refusing to mark"):
        run_log(outcomes, store.facts(5), "2026-01-02", "2026-01-03").collect()


def test_a_crawls_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    store = BucketedPostings(spark, str(tmp_path / "s"), STATE, Layout(buckets=4))
    rows = [(f"b{b}:{i}", "a", f"b{b}", "t") for b in range(5) for i in range(4)]
    batch = spark.createDataFrame(rows, ROW).mapInArrow(tell, ROW)
    store.apply(0, batch, spark.createDataFrame([("a", "b1")], BOARDS), at(0))
    assert made.value == len(rows) == store.read().count()
    assert store.facts(0).first().scanned == len(rows)
    assert not any((tmp_path / "s").glob("landed/v=*"))  # gone after the commit
