"""Mixing against a plain water-filling loop."""

import re
from collections import Counter, defaultdict

import pytest

from boardwalk.llm import mixing
from boardwalk.llm.common import Scratch


def brute_targets(sizes, weights, share, epochs):
    total, clamped = sum(sizes.values()) * share, {}
    while True:
        free = {s: weights[s] for s in sizes if s not in clamped}
        left = total - sum(clamped.values())
        level = left / sum(free.values()) if free else 0
        over = {s for s in free if level * weights[s] >= sizes[s] * epochs}
        if not over:
            return {s: clamped.get(s, level * weights[s]) for s in sizes}
        clamped.update({s: sizes[s] * epochs for s in over})


@pytest.mark.parametrize("share,epochs", [(1.5, 2.0), (0.2, 2.0), (1.5, 1.5), (9.0, 2.0)])
def test_targets(spark, share, epochs):
    sizes = {f"s{i:02d}": (i * i * 37) % 901 for i in range(23)} | {None: 500, "": 10}
    weights = {s: 1 + (i * 7) % 5 for i, s in enumerate(sizes)}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.targets(Scratch(spark, "t"), df, share, epochs).collect()}
    want = brute_targets(sizes, weights, share, epochs)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def rows():
    out = []
    for i in range(900):
        source = None if i % 31 == 0 else f"s{i % 7 if i % 3 else 0}"
        text = None if i % 50 == 1 else " ".join(["w"] * (i * 13 % 41)) if i % 90 else "long " * 3000
        out.append((None if i % 45 == 2 else i, source, text, i, "x"))
    return out + out[:40]


SCHEMA = "doc_id long, source string, text string, place int, whole string"


def test_plan_and_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.plan(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df.repartition(5)).collect()))
    assert len(got) == len(rows())
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.size * r.times and 0 <= r.times <= 2
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    names = sorted((s for s in size if s is not None)) + [None]
    want = brute_targets({s: size[s] for s in names}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    mixed = mixing.mix(df).collect()
    assert mixed[0].__fields__ == SCHEMA.replace(",", "").split()[::2]
    words = Counter()
    for r in mixed:
        words[r.source] += len(re.findall(r"\S+", r.text or ""))
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in words.items() if n}


def test_given_weights_and_empty(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w w") for i in range(40)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1)], "source string, weight int")
    got = mixing.plan(df, weights=weights, share=0.25).collect()
    assert sum(r.taken for r in got if r.source == "a") == 10 and all(r.times == 0 for r in got if r.source == "b")
    empty = df.where("false")
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.plan(nothing).collect()] == [0, 0]
