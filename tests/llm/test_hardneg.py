"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from boardwalk.llm import hardneg
from boardwalk.llm.hardneg import Mine, Tree, mine
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>, row string, x int"


def plain(rows, anchors, spec, scale=256):
    """The same by all pairs."""
    rows = {(k, l, tuple(math.floor(scale * x) for x in v)) for k, l, v in rows
            if k is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, la, va in rows:
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), k, l) for k, l, v in rows if k != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[: spec.positives]:
            fit = sorted((t, n) for t, n, l in scored if l != la and spec.low * -s <= 100 * -t <= spec.high * -s)
            out += [(a, p, i + 1, n, -s, -t) for i, (t, n) in enumerate(fit[: spec.negatives])]
    return sorted(out)


def run(spark, rows, spec=Mine(), step=5):
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % step == 0, spec=spec).collect())


@pytest.mark.parametrize("spec", [Mine(), Mine(tile=40, leaf=4, fan=2, block=7), Mine(positives=2, negatives=9, low=80, high=100, tile=64, leaf=8)], ids=["one", "many", "other"])
def test_against_all_pairs(spark, spec):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((6, 8))
    rows = [(i, int(i % 4), (centre[i % 6] + 0.4 * rng.standard_normal(8)).tolist()) for i in range(300)]
    rows += [(1000 + i, int(i % 3), [0.25] * 8) for i in range(120)]  # one common vector
    rows += rows[:20]  # repeated rows
    rows += [(15, 2, rows[3][2]), (None, 1, [1.0] * 8), (2000, None, [1.0] * 8), (2005, 1, None), (2010, 1, [1.0] * 7 + [None]),
             (2015, 1, [float("nan")] * 8), (2020, 1, [float("inf")] * 8), (2025, 1, [1.0, 2.0]), (2026, 1, [0.5, 1.0]), (2027, 2, [0.4, 0.8]),
             (2030, 0, []), (2031, 0, []), (2032, 1, []), (2035, 1, [0.0] * 8)]
    assert run(spark, rows, spec) == plain(rows, lambda k: k % 5 == 0, spec)


def test_large_components(spark):
    rows = [(i, i % 2, [float(i) * 1e5, 1e5 - i]) for i in range(30)]
    assert run(spark, rows) == plain(rows, lambda k: k % 5 == 0, Mine())


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0])]) == []


def test_boxes_bound_their_scores():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (500, 6)).astype(float)
    tree = Tree(x, 16, 4)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    for q in rng.integers(-50, 50, (20, 6)).astype(float):
        low, high = (x[0] for x in tree.bounds(q[None, :]))
        for n, at in enumerate(tree.leaves):
            assert low[n] <= (x[at] @ q).min() and (x[at] @ q).max() <= high[n]
        assert low[tree.root] <= (x @ q).min() and (x @ q).max() <= high[tree.root]


def test_query_is_registered():
    from boardwalk.llm.registry import ORACLE, QUERIES

    assert QUERIES["op12_hard_negatives"] is hardneg.op12_hard_negatives and "op12_hard_negatives" in ORACLE
