"""Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from boardwalk.llm import simjoin

SCHEMA = "doc_id long, text string, rep string, size int, part long"


def token_set(text, n=4):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[k:] for k in range(n)])) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, n=4, percent=85):
    sets = {k: token_set(t, n) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: (len(sets[k]), root(k)) for k in keys}


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.choice([3, 9, 40, 120, 300]))) for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    for i in range(160):  # near copies with ever more edits, some of one text
        words = texts[7 if i % 2 else i % 60].split()
        for _ in range(int(len(words) * rng.choice([0, 0.005, 0.01, 0.02, 0.04]))):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [f"{passage} {' '.join(word() for _ in range(k))}" for k in range(3, 60)]
    texts += [None, "", " \t", "one", "ONE", "one two three", "one two three four", "Éa b c d", "éa b c d", texts[0].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spec", [simjoin.Join(), simjoin.Join(block=16, leaf=4, bins=64), simjoin.Join(words=5, percent=80)])
def test_against_all_pairs(spark, spec):
    rows = planted()
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.similar(df, spec=spec).collect()}
    assert got == brute(rows, spec.words, spec.percent)


def test_edge_of_the_threshold(spark):
    words = [f"a{i}" for i in range(23)]  # 20 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(words[:19]))]  # 17 and 16 of 20
    got = {r.doc_id: r.component_id for r in simjoin.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}  # 17/20 links, 16/17 too, so 3 joins through 2
    got = {r.doc_id: r.component_id for r in simjoin.similar(spark.createDataFrame(rows[::2], "doc_id long, text string")).collect()}
    assert got == {1: 1, 3: 3}  # 16/20 does not


def test_null_keys_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (4, "A b c d e"), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in simjoin.similar(spark.createDataFrame(rows, schema)).collect())
    assert got == [("4", 2, 4), ("5", 2, 4), ("5", 2, 4), ("9", 0, 9), ("None", 2, None)]
    assert simjoin.similar(spark.createDataFrame([], schema)).count() == 0


def test_tree_keeps_every_pair_that_links():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: 60 + 300 * (i % 2)], rng.integers(1, 90))) for i in range(150)]
    sets += [np.unique(s[rng.random(len(s)) > 0.04]) for s in sets if len(s) > 3]
    tree = simjoin.Tree([simjoin.bitmap(s) for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets)), 8)
    found = {tuple(sorted(map(int, p))) for p in tree.pairs(85)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if simjoin.linked(sets[i], sets[j], 85)}
    assert want <= found and len(found) < 0.5 * len(sets) ** 2 / 2 and want
