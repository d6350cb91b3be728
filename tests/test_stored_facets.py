"""Stored facet views kept by change: equal to fresh ones, and reading what the crawl changed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardwalk.operators import facets
from boardwalk.schemas import FeedQuery
from boardwalk.streaming.buckets import BucketedPostings, Layout
from boardwalk.streaming.snapshots import StoredFacets

T0 = datetime(2026, 1, 1)
ROW = (
    "key string, provider string, board_token string, posted_at timestamp_ntz, country string, family string, "
    "seniority string, matched_skills array<string>, specialization string, adjacent boolean, ghost_risk double, remote_type string"
)
STATE = ROW + ", first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, closed_at timestamp_ntz"
BOARDS = "provider string, board_token string"
SHAPES = facets.default_shapes(["cloud", "data"], ["US", "DE"])
DAYS = 21


def posting(rng, board, i, day):
    pick = rng.choice
    posted = None if i % 5 == 0 else T0 - timedelta(days=(i * 7) % 30) + timedelta(hours=i)
    return (
        f"{board}:{i}", "a", board, posted, pick(["US", "DE", "FR", None]), pick(["cloud", "data", "unsorted", None]),
        pick(["senior", None]), pick([["Python"], ["Java"], [], None]), pick(["x", None]), pick([True, False, None]),
        pick([0.1, 0.9, None]), pick(["hybrid", None]),
    )


def crawl(rng, day):
    boards = [b for b in ["hot", "b1", "b2", "b3", "b4"] if rng.random() < 0.5]
    rows = [posting(rng, b, i, day) for b in boards for i in range(40 if b == "hot" else 6) if rng.random() < 0.7]
    return rows, [("a", b) for b in boards if rng.random() < 0.8]


def counts(df):
    return sorted(map(tuple, df.select("shape_key", "dim", "value", "n").collect()), key=str)


@pytest.fixture
def stores(spark, tmp_path):
    store = BucketedPostings(spark, str(tmp_path / "s"), STATE, Layout(buckets=6))
    return store, StoredFacets(spark, str(tmp_path / "v"), SHAPES, DAYS)


def step(spark, store, views, rng, day):
    rows, healthy = crawl(rng, day)
    now = T0 + timedelta(days=day)
    store.apply(day, spark.createDataFrame(rows, ROW), spark.createDataFrame(healthy, BOARDS), now)
    views.refresh(store, day, str(now))
    store.forget_before(day)
    return now


def test_ten_crawls_equal_a_fresh_count(spark, stores):
    store, views = stores
    rng = random.Random(5)
    for day in range(0, 30, 3):
        now = step(spark, store, views, rng, day)
        if day % 9 == 0:
            fresh = facets.snapshot(store.read(), SHAPES, str(now), DAYS)
            assert counts(views.latest()) == counts(fresh)


def test_views_equal_live_facets(spark, stores):
    store, views = stores
    now = step(spark, store, views, random.Random(1), 0)
    for key, family, country, ghosts in SHAPES[::4]:
        f = FeedQuery(now=str(now), max_age_days=DAYS, family=family, country=country, hide_ghosts=ghosts)
        live = facets.facets(store.read(), f).select(F.lit(key).alias("shape_key"), "dim", "value", "n")
        assert counts(views.latest().where(F.col("shape_key") == key)) == counts(live)


def test_unchanged_buckets_are_read_for_age_only(spark, stores):
    store, views = stores
    rng = random.Random(2)
    step(spark, store, views, rng, 0)
    board = "b1"
    batch = spark.createDataFrame([posting(rng, board, i, 1) for i in range(4)], ROW)
    store.apply(1, batch, spark.createDataFrame([("a", board)], BOARDS), T0 + timedelta(days=1))
    old, new, rest = store.open_changes(0, 1)
    mine = spark.createDataFrame([("a", board)], BOARDS).select(store.layout.bucket()).first()[0]
    assert {r[0] for r in new.select(store.layout.bucket()).distinct().collect()} == {mine}
    assert {r[0] for r in old.select(store.layout.bucket()).distinct().collect()} <= {mine}
    assert mine not in {r[0] for r in rest.select(store.layout.bucket()).distinct().collect()}
    stored = views.latest()
    plan = facets.snapshot_change(stored, old, new, rest, SHAPES, str(T0), str(T0 + timedelta(days=1)), DAYS)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    pushed = [line for line in text.splitlines() if "PushedFilters" in line and "posted_at" in line]
    assert any("LessThan(posted_at" in line for line in pushed)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_other_shapes_and_replays(spark, tmp_path, stores):
    store, views = stores
    now = step(spark, store, views, random.Random(3), 0)
    before = counts(views.latest())
    views.refresh(store, 0, str(now + timedelta(days=9)))  # a replay changes nothing
    assert counts(views.latest()) == before
    more = StoredFacets(spark, str(tmp_path / "v"), [*SHAPES, ("data|FR|g0", "data", "FR", False)], DAYS)
    store.apply(1, spark.createDataFrame([], ROW), None, now + timedelta(days=1))
    more.refresh(store, 1, str(now + timedelta(days=1)))
    fresh = facets.snapshot(store.read(), more.shapes, str(now + timedelta(days=1)), DAYS)
    assert counts(more.latest()) == counts(fresh)


def test_empty_table(spark, stores):
    store, views = stores
    store.apply(0, spark.createDataFrame([], ROW), None, T0)
    views.refresh(store, 0, str(T0))
    assert counts(views.latest()) == sorted(((s[0], facets.COUNTRY_UNKNOWN, "", 0) for s in SHAPES), key=str)


def test_cells_are_summed_by_value_before_they_meet_views(spark):
    rows = [(f"k{i}", "a", "b", T0, "US", "cloud", f"s{i}", [], "x", False, 0.1, f"r{i % 7}", T0, T0, None) for i in range(60)]
    found = facets._entries(facets.cells(spark.createDataFrame(rows, STATE)))
    sums = {(r.dim, r.value): r.c for r in found.collect()}
    assert sums["country", "US"] == 60 and sums["remote", "r0"] == 9 and sums["seniority", "s3"] == 1
    others = found.where("dim not in ('seniority', 'remote')")
    assert others.count() == others.select("dim").distinct().count()  # 60 cells, one sum for each value
