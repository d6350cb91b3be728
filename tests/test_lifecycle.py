"""State over time: folds, replays and streams agree."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardwalk.operators import audit, keys, lifecycle, registry, users
from boardwalk.schemas import EXCLUSIONS, FeedQuery
from boardwalk.streaming import jobs
from boardwalk.streaming.tables import VersionedTable

T0 = datetime(2026, 1, 1)
STATE = (
    "key string, provider string, board_token string, title string, first_seen_at timestamp_ntz, "
    "last_seen_at timestamp_ntz, closed_at timestamp_ntz"
)
# batch -> [(key, board, title)], and board -> postings read, None when it failed
BATCHES = [
    [("a:x:1", "x", "one"), ("a:x:2", "x", "two"), ("a:y:1", "y", "why")],
    [("a:x:2", "x", "two!"), ("a:y:1", "y", "why")],
    [("a:x:1", "x", "one again"), ("a:x:2", "x", "two!")],
]
READ = [{"x": 2, "y": 1}, {"x": 1, "y": 1}, {"x": 2, "y": None}]


def batch_rows(i):
    return [
        (k, "a", b, t, T0 + timedelta(days=i), 1, n) for n, (k, b, t) in enumerate(BATCHES[i])
    ]


BATCH = "key string, provider string, board_token string, title string, seen_at timestamp_ntz, page int, pos int"


def outcome_rows(spark, i):
    rows = [("a", b, "", n or 0, None if n else "boom", None if n else "refused") for b, n in READ[i].items()]
    return spark.createDataFrame(rows, "provider string, token string, site string, jobs int, error string, failure string")


def fold(spark):
    state = spark.createDataFrame([], STATE)
    for i in range(len(BATCHES)):
        rows = spark.createDataFrame(batch_rows(i), BATCH)
        now = F.lit(T0 + timedelta(days=i)).cast("timestamp_ntz")
        unique = lifecycle.dedupe_batch(rows, [F.col("page"), F.col("pos")])
        state = lifecycle.merge_batch(state, unique, lifecycle.healthy_boards(outcome_rows(spark, i)), now)
    return state


def collected(df):
    columns = ["key", "title", "first_seen_at", "last_seen_at", "closed_at"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fold(spark):
    day = [T0 + timedelta(days=i) for i in range(3)]
    assert collected(fold(spark)) == [
        ("a:x:1", "one again", day[0], day[2], None),
        ("a:x:2", "two!", day[0], day[2], None),
        ("a:y:1", "why", day[0], day[1], None),  # its board failed in the last run
    ]


def test_replay_equals_fold(spark):
    seen = spark.createDataFrame([r for i in range(3) for r in batch_rows(i)], BATCH).drop("page", "pos")
    runs = [("a", b, T0 + timedelta(days=i)) for i in range(3) for b, n in READ[i].items() if n]
    runs = spark.createDataFrame(runs, "provider string, board_token string, run_at timestamp_ntz")
    assert collected(lifecycle.replay(seen, runs)) == collected(fold(spark))


@pytest.mark.parametrize("files", [1, 1000])
def test_stream_equals_fold_and_can_be_replayed(spark, tmp_path, files):
    for i in range(3):
        rows = spark.createDataFrame(batch_rows(i), BATCH)
        rows.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files).json(str(tmp_path / "in"))
    table = VersionedTable(spark, str(tmp_path / "state"), STATE)

    def outcomes_of(when):
        return outcome_rows(spark, (when - T0).days)

    for run in ("one", "two"):  # a second stream over the same state changes nothing
        q = jobs.merge_postings_stream(source, table, outcomes_of, str(tmp_path / f"cp-{run}"))
        q.awaitTermination()
        assert collected(table.latest()) == collected(fold(spark))


def test_merge_is_idempotent(spark):
    state = fold(spark)
    rows = spark.createDataFrame(batch_rows(2), BATCH)
    now = F.lit(T0 + timedelta(days=2)).cast("timestamp_ntz")
    again = lifecycle.merge_batch(state, rows, lifecycle.healthy_boards(outcome_rows(spark, 2)), now)
    assert collected(again) == collected(state)


def test_empty_batch_closes_nothing(spark):
    state = fold(spark)
    none = spark.createDataFrame([], BATCH)
    now = F.lit(T0 + timedelta(days=9)).cast("timestamp_ntz")
    healthy = lifecycle.healthy_boards(outcome_rows(spark, 0))
    assert lifecycle.merge_batch(state, none, healthy, now).where("closed_at is not null").count() == 0
    assert lifecycle.vanished(state, none, healthy).count() == 0


def test_zero_run_is_refused(spark):
    with pytest.raises(ValueError):
        lifecycle.run_log(outcome_rows(spark, 0), 5, 0, 0, "2026-01-01", "2026-01-02")


def test_schema_contract(spark):
    with pytest.raises(ValueError):
        lifecycle.check_schema(spark.range(1), STATE)
    assert lifecycle.check_schema(fold(spark), STATE).columns[0] == "key"


def test_ranks_of_a_hot_group_with_sparse_orders(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('g', id % 5))) as g", "if(id = 0, null, id * id * id) as o")
    ranked = keys.rank_in_group(df, ["g"], "o", "r")
    groups = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["g"] or "", r["o"] or -1)):
        groups.setdefault(r["g"], []).append(r["r"])
    assert sum(map(len, groups.values())) == 3000 and None in groups
    assert all(v == list(range(1, len(v) + 1)) for v in groups.values())
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" not in plan or "_part" in plan.split("hashpartitioning(g#", 1)[1].split(")", 1)[0]


def test_replay_and_reposts_with_very_many_runs_of_one_board(spark):
    at = lambda c: F.expr(f"timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, {c})")
    runs = spark.range(100_000).select(F.lit("a").alias("provider"), F.lit("x").alias("board_token"), at("id * 10").alias("run_at"))
    seen = spark.range(2000).select(
        F.concat(F.lit("k"), "id").alias("key"), F.lit("a").alias("provider"), F.when(F.col("id") % 5 > 0, "x").alias("board_token"), at("id * 7").alias("seen_at")
    )
    got = lifecycle.replay(seen, runs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    for r in got.collect():
        second = int(r["key"][1:]) * 7
        want = None if int(r["key"][1:]) % 5 == 0 else T0 + timedelta(seconds=second // 10 * 10 + 10)
        assert r["closed_at"] == want
    closed = spark.range(100_000).select(
        F.concat(F.lit("o"), "id").alias("key"), F.lit("a").alias("provider"), F.lit("x").alias("board_token"), F.lit("T").alias("title"),
        F.lit("L").alias("location"), at("id").alias("first_seen_at"), at("id * 10").alias("closed_at"),
    )
    new = spark.range(7, 100_000, 100).select(
        F.concat(F.lit("n"), "id").alias("key"), F.lit("a").alias("provider"), F.lit("x").alias("board_token"), F.lit("T").alias("title"),
        F.lit("L").alias("location"), at("id * 3").alias("first_seen_at"), F.lit(None).cast("timestamp_ntz").alias("closed_at"),
    )
    events = lifecycle.reposts(new, closed).collect()
    assert len(events) == 1000
    assert all(r["previous_key"] == f"o{int(r['key'][1:]) * 3 // 10}" for r in events)


def test_interleave_and_shards(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b")], "o int, provider string")
    at = {r["o"]: r["at"] for r in keys.interleave(df, "provider", "o").collect()}
    assert at == {0: 0.5 / 3, 1: 1.5 / 3, 2: 2.5 / 3, 3: 0.5}
    boards = spark.createDataFrame(
        [(0, "w", "T"), (1, "w", "u"), (2, "w", "t"), (3, "w", "v")], "o int, provider string, token string"
    )
    shard = {r["o"]: r["shard"] for r in keys.shard_of_tenant(boards, 2, "o").collect()}
    assert shard == {0: 0, 1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize("files", [1, 3, 1000])
def test_health_stream_retires_after_five(spark, tmp_path, files):
    seed = spark.createDataFrame(
        [("a", "x", "X", None, True, "m", None, 1, 0, None, None, None, None)],
        "provider string, token string, company string, extra map<string,string>, active boolean, source string, "
        "domain string, job_count int, consecutive_failures int, last_error string, last_ok_at timestamp_ntz, "
        "last_crawled_at timestamp_ntz, verified_at timestamp_ntz",
    )
    ddl = "provider string, token string, site string, jobs int, error string, failure string, at timestamp_ntz"
    history = ["gone", "gone", None, "gone", "refused", "gone", "gone", "gone", "gone"]
    for i, f in enumerate(history):
        row = [("a", "x", "", 1, f and "a/x: HTTP 404", f, T0 + timedelta(days=i))]
        spark.createDataFrame(row, ddl).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).json(str(tmp_path / "in"))
    ddl_boards = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seed.schema)
    table = VersionedTable(spark, str(tmp_path / "b"), ddl_boards)
    jobs.board_health_stream(stream, table, seed, str(tmp_path / "cp")).awaitTermination()
    row = table.latest().first()
    assert (row["consecutive_failures"], row["active"], row["last_error"]) == (5, False, "HTTP 404")
    rows = [("a", "x", f and "a/x: HTTP 404", f, T0 + timedelta(days=i), i) for i, f in enumerate(history)]
    outcomes = spark.createDataFrame(rows, "provider string, token string, error string, failure string, at timestamp_ntz, n int")
    whole = registry.health_history(outcomes, "at", "n").first()
    assert (whole["consecutive_failures"], whole["active"]) == (5, False)


def test_refusals_never_retire(spark):
    rows = [("a", "x", "HTTP 429", "refused", T0 + timedelta(days=i), i) for i in range(9)]
    outcomes = spark.createDataFrame(rows, "provider string, token string, error string, failure string, at timestamp_ntz, n int")
    assert registry.health_history(outcomes, "at", "n").first()["active"]


@pytest.mark.parametrize("files", [1, 3, 1000])
def test_tally_stream_two_speeds(spark, tmp_path, files):
    ddl = "reason string, title string, n long, sample_company string, at timestamp_ntz"
    hours = [0, 0.4, 2, 21]
    for i, h in enumerate(hours):
        rows = [("r", "t", 10, None if i == 0 else "c", T0 + timedelta(hours=h))]
        if i == 2:
            rows.append(("r", "new", 3, "d", T0 + timedelta(hours=h)))
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).json(str(tmp_path / "in"))
    table = VersionedTable(
        spark, str(tmp_path / "t"),
        "reason string, title string, n long, sample_company string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    )
    marker = VersionedTable(spark, str(tmp_path / "m"), "window_started_at timestamp_ntz")
    jobs.tally_stream(stream, table, marker, str(tmp_path / "cp")).awaitTermination()
    got = {r["title"]: (r["n"], r["sample_company"]) for r in table.latest().collect()}
    # Opening pass, same window, a quick pass that only inserts, and the next full pass.
    assert got == {"t": (30, "c"), "new": (3, "d")}


@pytest.mark.parametrize("cuts", [[], [3], [2, 5]])
def test_tallies_of_many_crawls_equal_the_fold(spark, cuts):
    rng = random.Random(11)
    ddl = "at timestamp_ntz, reason string, title string, n long, sample_company string"
    rows = [
        (T0 + timedelta(days=d), "r", f"t{rng.randint(0, 5)}" if rng.random() < 0.9 else rng.choice(["", None]),
         rng.randint(1, 9), rng.choice(["a", "b", None]))
        for d in range(8) for _ in range(4)
    ]
    passes = [(T0 + timedelta(days=d), rng.random() < 0.5) for d in range(8)]
    one_by_one = spark.createDataFrame([], EXCLUSIONS)
    for at, full in passes:
        crawl = spark.createDataFrame([r for r in rows if r[0] == at], ddl)
        step = audit.merge_tally(one_by_one, crawl, F.lit(at).cast("timestamp_ntz"), full)
        one_by_one = spark.createDataFrame(step.collect(), EXCLUSIONS)
    table, edges = spark.createDataFrame([], EXCLUSIONS), [0, *cuts, 8]
    for a, b in zip(edges, edges[1:]):
        part = [p for p in passes[a:b]]
        told = spark.createDataFrame(part, "at timestamp_ntz, full boolean")
        heard = spark.createDataFrame([r for r in rows if part[0][0] <= r[0] <= part[-1][0]], ddl)
        table = spark.createDataFrame(audit.fold_tallies(table, heard, told).collect(), EXCLUSIONS)
    assert sorted(map(tuple, table.collect()), key=str) == sorted(map(tuple, one_by_one.collect()), key=str)


def test_full_pass_window():
    assert audit.is_full_pass(None, T0) == (True, T0)
    assert audit.is_full_pass(T0, T0 + timedelta(minutes=30)) == (True, T0)
    assert audit.is_full_pass(T0, T0 + timedelta(hours=1)) == (False, T0)
    assert audit.is_full_pass(T0, T0 + timedelta(hours=20)) == (True, T0 + timedelta(hours=20))


def test_experience_counts_overlap_once(spark):
    rows = [("p", datetime(2010, 1, 1), datetime(2012, 1, 1)), ("p", datetime(2011, 6, 1), datetime(2013, 1, 1)),
            ("p", datetime(2015, 1, 1), datetime(2015, 7, 1)), ("p", datetime(2016, 1, 1), datetime(2016, 1, 20))]
    df = spark.createDataFrame(rows, "who string, s timestamp_ntz, e timestamp_ntz")
    row = users.experience(df, "who", "s", "e").first()
    assert (row["months"], row["years"]) == (42, 3)


def test_mark_seen_clears_applied(spark):
    rows = [("u", "k", True, True, T0), ("u", "k", True, False, T0 + timedelta(days=1))]
    marks = spark.createDataFrame(rows, "user_id string, job_key string, seen boolean, applied boolean, at timestamp_ntz")
    row = users.latest_marks(marks, F.col("at")).first()
    assert (row["seen"], row["applied"]) == (True, False)


def test_purge_takes_the_oldest_first(spark):
    rows = [(f"k{i}", T0 - timedelta(days=20 - i)) for i in range(10)] + [("open", None)]
    df = spark.createDataFrame(rows, "key string, closed_at timestamp_ntz")
    left = lifecycle.purge_closed(df, F.lit(T0).cast("timestamp_ntz"), budget=3)
    assert sorted(r["key"] for r in left.collect()) == sorted([f"k{i}" for i in range(3, 10)] + ["open"])


@pytest.mark.parametrize(
    "bad",
    [{"sort": "oldest"}, {"adjacent": "maybe"}, {"offset": -1}, {"limit": 0}, {"within_days": 0},
     {"family": "cloud", "specialization": "frontend"}],
)
def test_bad_queries_are_refused(bad):
    with pytest.raises(ValueError):
        FeedQuery(now="2026-01-01 00:00:00", **bad)


def test_null_groups_keep_their_rows(spark):
    from boardwalk.operators.keys import interleave, shard_of_tenant
    from boardwalk.operators.score import with_board_size

    rows = [("a", "x", 1), (None, "x", 2), ("a", None, 3), (None, None, 4), ("a", "x", 5)]
    df = spark.createDataFrame(rows, "provider string, token string, ord long")
    assert sorted(r.board_size for r in with_board_size(df, "provider", "token").collect()) == [1, 1, 1, 2, 2]
    assert interleave(df, "provider", "ord").count() == 5
    shards = {r.ord: r.shard for r in shard_of_tenant(df, 2, "ord").collect()}
    assert shards == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


@pytest.mark.parametrize("may_retire", [True, False])
def test_health_at_once_equals_crawl_by_crawl(spark, may_retire):
    import random

    rng = random.Random(5)
    ddl = (
        "provider string, token string, company string, extra map<string,string>, active boolean, consecutive_failures int, "
        "last_error string, last_ok_at timestamp_ntz, last_crawled_at timestamp_ntz"
    )
    seed = [("workday", f"t{i // 2}", "c", {"site": f"s{i % 2}"}, i % 5 > 0, i % 4 or None, "old", None, None) for i in range(24)]
    seed = spark.createDataFrame([*seed, ("lever", "plain", "c", None, True, 4, None, T0, T0)], ddl)
    rows = []
    for at in range(12):
        for i in range(25):
            for _ in range(rng.randrange(3)):
                kind = rng.choice(["gone", "gone", "gone", "refused", None])
                board = ("workday", f"t{i // 2}", f"s{i % 2}") if i < 24 else ("lever", "plain", None)
                rows.append((*board, kind and f"HTTP {rng.randrange(400, 404)}", kind, T0 + timedelta(days=at)))
    rows += [("workday", "t1", "s1", None, None, None), ("workday", "unknown", "", None, None, T0)]
    out = spark.createDataFrame(rows, "provider string, token string, site string, error string, failure string, at timestamp_ntz")
    state = seed
    for at in range(12):
        now = F.lit(T0 + timedelta(days=at)).cast("timestamp_ntz")
        after = registry.apply_outcomes(state, out.where(F.col("at") == now), now, may_retire)
        state = spark.createDataFrame(after.collect(), ddl)
    key = lambda r: (r["provider"], r["token"], str(r["extra"]))
    want = sorted(state.collect(), key=key)
    assert sorted(registry.fold_outcomes(seed, out, "at", may_retire).collect(), key=key) == want
    half = F.col("at") < F.lit(T0 + timedelta(days=5)).cast("timestamp_ntz")
    twice = registry.fold_outcomes(registry.fold_outcomes(seed, out.where(half), "at", may_retire), out.where(~half), "at", may_retire)
    assert sorted(twice.collect(), key=key) == want
