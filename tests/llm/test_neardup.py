"""Near-duplicate vectors against all pairs."""

import numpy as np

from boardwalk.llm import neardup


def brute(rows, threshold=0.95):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and None not in v and np.all(np.isfinite(v)) and any(v)]
    parent, links = {k: k for k, _ in good}, {k: 0 for k, _ in good}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: (links[k], root(k)) for k in links}


def planted(n=700, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i * 3, [float(x) for x in rng.standard_normal(16)]) for i in range(n)]
    for i in range(0, 200):  # close, at the edge, and far
        base = np.array(rows[i % 40][1])
        rows.append((10_000 + i, [float(x) for x in base + rng.standard_normal(16) * (0.02, 0.25, 0.33, 0.8)[i % 4]]))
    rows += [(20_000 + i, rows[5][1]) for i in range(150)] + [(30_000 + i, [x * 7.5 for x in rows[9][1]]) for i in range(3)]
    nan, inf = float("nan"), float("inf")
    return rows + [(1, None), (2, []), (4, [0.0] * 16), (5, [nan] * 16), (7, [inf] + [1.0] * 15), (8, [None] + [1.0] * 15), (10, [1.0] * 3), (11, [2.0] * 3)]


def test_against_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, rep string, n int")
    got = {r.vec_id: r for r in neardup.near_duplicates(df, window=64, block=128).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    found = sum(got[k].n_links for k in want)
    assert found >= 0.97 * sum(n for n, _ in want.values())
    for k, (n, root) in want.items():
        assert got[k].n_links <= n
        assert got[k].component_id >= root and got[k].kept == (got[k].component_id == k)
    assert sum(got[k].component_id == root for k, (_, root) in want.items()) >= 0.98 * len(want)
    for k in set(got) - set(want):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)


def test_nulls_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.001])], schema)
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == [("2", 2, 2), ("3", 2, 2), ("3", 2, 2), ("None", 0, None)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_tight_group_larger_than_a_window_and_a_block(spark):
    rng = np.random.default_rng(8)
    base, close = rng.standard_normal(24), rng.standard_normal((3000, 24))
    rows = [(i, [float(x) for x in base + close[i] * (0.001, 0.01)[i % 2]]) for i in range(2900)]
    rows += [(i, [float(x) for x in base * (1 + i / 7)]) for i in range(2900, 3000)]  # rescaled
    rows += [(10_000 + i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 24)))]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all((got[i].n_links, got[i].component_id) == (2999, 0) for i in range(3000))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(10_000, 10_300))
