"""Jaccard join of word n-gram sets by signature trees.

Every distinct set has a token bitmap.  Sets that can link share one of their rarest tokens, so one
tree stands for each such token, and a pair that meets in no tree can't have the overlap needed.
In a tree the sets are ordered by size; nodes hold the OR of their bitmaps and their size range, and
a dual traversal drops every pair of nodes whose largest possible overlap is too small, or whose
sets are all connected already.  What is left is checked on the exact sets.

* Equal sets are one class before anything else, so copies cost nothing.
* Rarity comes from a count of all tokens of all documents in a fixed number of bins.  Any order
  of tokens gives the same links; this one keeps common passages from bringing sets together.
* Trees with the same members are kept once.  Large ones are cut into blocks that are the nodes of
  their upper level; tasks hold two blocks at most.
* Before the trees are traversed, each set is checked against one leader of each of its trees, three
  times. That joins most near copies with a number of checks in proportion to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, broadcast_if_few, components, running_totals, ship
from boardwalk.llm.registry import register, table


@dataclass(frozen=True)
class Join:
    """Words in a token, needed similarity in percent, and sizes that change no result."""

    words: int = 4
    percent: int = 85
    bins: int = 1 << 18
    block: int = 1024
    leaf: int = 16

    def need(self, size):
        """Tokens that a set of this size shares at least with any set it links with."""
        return (self.percent * size + 99) // 100


# Odd multipliers that mix word hashes into one number.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
REMEMBERED = 150_000


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased."""

    def __init__(self, words: int):
        self.n, self.seen = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, seen = (text or "").encode().lower().split(), self.seen
        if not words:
            return np.zeros(0, np.uint64)
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in {*words}.difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        if len(h) < self.n:  # one token for the whole sequence, told apart from all n-grams
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        end = len(h) - self.n + 1
        x = h[:end] * _MIX[0]
        for k in range(1, self.n):
            x = (x ^ (x >> np.uint64(31))) * _MIX[k % len(_MIX)] + h[k : end + k]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(x ^ (x >> np.uint64(32)))


def _texts(batch: pa.RecordBatch):
    for at in range(batch.num_rows):
        yield batch.column(0)[at].as_py(), batch.column(1)[at].as_py()


def _measure(docs: DataFrame, spec: Join) -> DataFrame:
    """A row for each document, (0, key, size, two hashes of its set), and for each bin, (1, bin, tokens)."""

    def work(batches):
        shingles, counts, bits = Shingler(spec.words), np.zeros(spec.bins, np.int64), np.uint64(64 - spec.bins.bit_length() + 1)
        for batch in batches:
            out = []
            for key, text in _texts(batch):
                s = shingles(text)
                np.add.at(counts, (s >> bits).astype(np.int64), 1)
                raw = s.tobytes()
                out.append((0, key, len(s), xxhash.xxh64_intdigest(raw) >> 1, xxhash.xxh64_intdigest(raw, seed=7) >> 1))
            yield _rows(out, "kind int, key long, size long, h1 long, h2 long")
        (full,) = np.nonzero(counts)
        for part in np.array_split(full, max(1, len(full) // 50_000)):
            yield _rows([(1, int(b), int(counts[b]), 0, 0) for b in part], "kind int, key long, size long, h1 long, h2 long")

    return docs.mapInArrow(work, "kind int, key long, size long, h1 long, h2 long")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rare(docs: DataFrame, weight, spec: Join) -> DataFrame:
    """(token, key) of the rarest tokens of each set: so many that sets that link must share one."""

    def work(batches):
        shingles, bits, heavy = Shingler(spec.words), np.uint64(64 - spec.bins.bit_length() + 1), weight.value
        for batch in batches:
            tokens, keys = [], []
            for key, text in _texts(batch):
                s = shingles(text)
                if key is None or not len(s):
                    continue
                n = len(s) - int(spec.need(len(s))) + 1
                first = np.lexsort((s, heavy[(s >> bits).astype(np.int64)]))[:n]
                tokens.append(s[first])
                keys.append(np.full(n, key, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys))], ["token", "key"])

    return docs.mapInArrow(work, "token long, key long")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Token bitmap of four bits or more for each token, at least 256 bits, as 64-bit words."""
    width = max(256, 1 << (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap folded to n words; the bit of a token stays its number modulo the width."""
    return np.bitwise_or.reduce(words.reshape(-1, n), axis=0)


def _sets(docs: DataFrame, spec: Join, exact: bool) -> DataFrame:
    """(rep, size, bits): set size and bitmap of each document, or its exact set in place of the bitmap."""

    def work(batches):
        shingles = Shingler(spec.words)
        for batch in batches:
            sets = [(key, shingles(text)) for key, text in _texts(batch)]
            yield _rows([(k, len(s), (s if exact else bitmap(s)).tobytes()) for k, s in sets], "rep long, size long, bits binary")

    return docs.mapInArrow(work, "rep long, size long, bits binary")


def _of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose key is in the written table ``wanted``; texts are shuffled only if that is long."""
    return docs.join(broadcast_if_few(wanted, 200_000), "key", "left_semi")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least this share of their union in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("size").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs


def _where(pairs: DataFrame, test) -> DataFrame:
    """Pairs (a, b) of ``_with_both`` for which test(bits, bits, size, size) is true."""

    def work(batches):
        for batch in batches:
            a, b, x, y, nx, ny = (batch.column(c).to_pylist() for c in ("a", "b", "bits_a", "bits_b", "n_a", "n_b"))
            own = [test(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), nx[i], ny[i]) for i in range(len(a))]
            yield _rows([(a[i], b[i]) for i in range(len(a)) if own[i]], "a long, b long")

    return pairs.mapInArrow(work, "a long, b long")


def _verify(scratch: Scratch, pairs: DataFrame, bitmaps: DataFrame, docs: DataFrame, spec: Join, turn: int) -> DataFrame:
    """The pairs (a, b) that link: bitmaps drop what can't, then the exact sets of the rest decide."""
    left = _where(_with_both(pairs, bitmaps), lambda x, y, n, m: _possible(x, y, n, m, spec))
    left = scratch.save(left, f"left{turn}")
    ends = left.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    exact = scratch.save(_sets(_of(docs, scratch.save(ends, f"ends{turn}")), spec, exact=True), f"exact{turn}")
    links = _where(_with_both(left, exact), lambda x, y, n, m: linked(x, y, spec.percent))
    links = scratch.save(links.distinct(), f"links{turn}")
    scratch.drop(f"left{turn}", f"ends{turn}", f"exact{turn}")
    return links


def _possible(x: np.ndarray, y: np.ndarray, nx: int, ny: int, spec: Join) -> bool:
    n = min(len(x), len(y))
    x, y = fold(x, n), fold(y, n)
    most = min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= spec.percent * (nx + ny - most)


class Tree:
    """Signature tree over sets sorted by size: halved down to leaves."""

    def __init__(self, bits: list[np.ndarray], size: np.ndarray, part: np.ndarray, leaf: int):
        self.order = np.argsort(size, kind="stable")
        self.size, self.part, self.leaf = size[self.order], part[self.order], leaf
        width = min(len(b) for b in bits)
        self.bits = np.stack([fold(bits[i], width) for i in self.order])
        self.extra = self.size - np.bitwise_count(self.bits).sum(axis=1)  # tokens that share a bit with another
        self.nodes: dict[tuple[int, int], tuple] = {}

    def node(self, lo: int, hi: int) -> tuple:
        """(OR of bitmaps, smallest and largest size, most shared bits, the only part or None)."""
        if (lo, hi) not in self.nodes:
            if hi - lo <= self.leaf:
                ored, extra = np.bitwise_or.reduce(self.bits[lo:hi], axis=0), int(self.extra[lo:hi].max())
                one = self.part[lo] if (self.part[lo:hi] == self.part[lo]).all() else None
            else:
                mid = (lo + hi) // 2
                a, b = self.node(lo, mid), self.node(mid, hi)
                ored, extra, one = a[0] | b[0], max(a[3], b[3]), a[4] if a[4] == b[4] else None
            self.nodes[lo, hi] = (ored, int(self.size[lo]), int(self.size[hi - 1]), extra, one)
        return self.nodes[lo, hi]

    def pairs(self, percent: int, split: int | None = None):
        """Pairs of places whose sets may link and are in different parts; dual traversal from the root."""
        stack = [(0, len(self.size), 0, len(self.size))]
        while stack:
            al, ah, bl, bh = stack.pop()
            x, y = self.node(al, ah), self.node(bl, bh)
            if x[4] is not None and x[4] == y[4]:
                continue
            most = min(x[2], y[2], int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3]))
            if 100 * most < percent * (max(x[1], most) + max(y[1], most) - most):
                continue
            if ah - al <= self.leaf and bh - bl <= self.leaf:
                yield from self._leaves(al, ah, bl, bh, percent)
            elif (al, ah) == (bl, bh):
                mid = (al + ah) // 2
                stack += [(al, mid, al, mid), (al, mid, mid, ah), (mid, ah, mid, ah)]
            elif ah - al >= bh - bl:
                mid = (al + ah) // 2
                stack += [(al, mid, bl, bh), (mid, ah, bl, bh)]
            else:
                mid = (bl + bh) // 2
                stack += [(al, ah, bl, mid), (al, ah, mid, bh)]

    def _leaves(self, al, ah, bl, bh, percent):
        x, y = self.bits[al:ah, None], self.bits[None, bl:bh]
        nx, ny = self.size[al:ah, None], self.size[None, bl:bh]
        most = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=2), ny - np.bitwise_count(y & ~x).sum(axis=2))
        ok = (100 * most >= percent * (nx + ny - most)) & (self.part[al:ah, None] != self.part[None, bl:bh])
        i, j = np.nonzero(ok)
        for p, q in zip(i + al, j + bl, strict=True):
            if p < q or (al, ah) != (bl, bh):
                yield self.order[p], self.order[q]


def _traverse(members: DataFrame, spec: Join) -> DataFrame:
    """Candidate pairs of all trees, each from the tree with the smallest mark that both sets are in.

    Rows are (token, left, right, side, rep, part, size, bits, trees), a tree's together; ``trees`` are
    the marks, smaller than this tree's, of the set's other trees.  Trees with equal marks tell a pair twice.
    """

    def flush(group: list) -> list[tuple]:
        reps, parts, sizes, bits, sides, trees = zip(*group, strict=True)
        trees = [set(t) for t in trees]
        tree = Tree([np.frombuffer(b, np.uint64) for b in bits], np.array(sizes), np.array(parts), spec.leaf)
        return [
            (min(reps[i], reps[j]), max(reps[i], reps[j])) for i, j in tree.pairs(spec.percent)
            if (sides[i] == 2 or sides[i] != sides[j]) and trees[i].isdisjoint(trees[j])
        ]

    def work(batches):
        at, group = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("token", "left", "right", "rep", "part", "size", "bits", "side", "trees")]
            out = []
            for token, left, right, *row in zip(*cols, strict=True):
                if (token, left, right) != at:
                    out += flush(group) if len(group) > 1 else []
                    at, group = (token, left, right), []
                group.append(row)
            yield _rows(out, "a long, b long")
        yield _rows(flush(group) if len(group) > 1 else [], "a long, b long")

    return members.mapInArrow(work, "a long, b long")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", spec: Join = Join()) -> DataFrame:
    """(key, n_shingles, component_id) of every row; ``key`` is an integer.

    A row's set: the distinct ``spec.words``-word shingles of its lower-cased text (A-Z only); with
    fewer words the whole sequence as one; nothing for a null text or one without words, which links
    with nothing.  Sets link from ``spec.percent`` percent of their union on.  ``component_id`` is the
    smallest key reachable by links.  Rows with a null key link with nothing and have no component;
    rows that share a key all get the smallest component among them.  Tokens are 64-bit hashes.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simjoin")
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    measured = scratch.save(_measure(docs, spec), "measured")
    bins = measured.where("kind = 1").groupBy("key").agg(F.sum("size").alias("n")).toArrow()  # at most spec.bins rows
    weight = np.zeros(spec.bins, np.int64)
    weight[np.asarray(bins.column("key"))] = np.asarray(bins.column("n"))
    weight = spark.sparkContext.broadcast(weight)

    rows = scratch.save(measured.where("kind = 0").select("key", "size", "h1", "h2"), "rows")
    scratch.drop("measured")
    filled = rows.where("size > 0 and key is not null")
    classes = filled.groupBy("h1", "h2", "size").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    copies = scratch.save(classes.where("n > 1"), "copies")  # only these have members besides themselves
    in_copies = filled.join(broadcast_if_few(copies.drop("n")), ["h1", "h2", "size"], "left")
    owners = scratch.save(in_copies.select("key", "size", F.coalesce("rep", "key").alias("rep")).distinct(), "owners")

    by_token = Window.partitionBy("token")
    shared = _rare(docs, weight, spec).withColumn("c", F.count("*").over(by_token)).where("c > 1").drop("c")
    shared = scratch.save(shared, "shared")
    first = shared.join(owners, "key").select("token", "rep", "size").distinct()
    tokens = first.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    chosen = tokens.where("c > 1").groupBy("c", "who").agg(F.min("token").alias("token"))
    trees = scratch.save(first.join(chosen.select("token"), "token"), "trees")
    scratch.drop("shared")

    wanted = scratch.save(trees.select(F.col("rep").alias("key")).distinct(), "wanted")
    bitmaps = scratch.save(_sets(_of(docs, wanted), spec, exact=False), "bitmaps")

    parts, links, turn = trees.select("rep").distinct().withColumn("part", F.col("rep")), None, 0

    def grown(found: DataFrame) -> None:
        nonlocal parts, links, turn
        new = _verify(scratch, found, bitmaps, docs, spec, turn)
        links = new if links is None else links.unionByName(new)
        comps = components(Scratch(spark, "simjoin-parts"), links, "a", "b").withColumnRenamed("node", "rep")
        parts = scratch.save(wanted.select(F.col("key").alias("rep")).join(comps, "rep", "left").select(
            "rep", F.coalesce("component", "rep").alias("part")), f"parts{turn}")
        turn += 1

    # a set that is in many trees is little changed from what its near copies have in common
    central = scratch.save(trees.groupBy("rep").agg(F.count("*").alias("trees")), "central")
    for seed in range(3):  # leaders: the most central set, then other central ones
        placed = trees.join(parts, "rep").join(central, "rep")
        luck = F.lit(1.0) - F.lit(0.2 if seed else 0.0) * F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1000)) / 1000
        lead = F.max_by(F.struct("rep", "size", "part"), F.struct(F.col("trees") * luck, F.col("rep"))).over(by_token)
        star = placed.withColumn("lead", lead).where("part != lead.part").where(
            f"least(size, lead.size) * 100 >= {spec.percent} * greatest(size, lead.size)"
        )
        pairs = star.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()
        grown(pairs)

    mixed = trees.join(parts, "rep")
    open_ = mixed.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("token")
    mixed = scratch.save(mixed.join(open_, "token"), "mixed")
    scratch.drop("trees", "central")
    of_rep = mixed.groupBy("rep").agg(F.collect_list(F.hash("token")).alias("marks"))  # a set's own rarest tokens at most
    ranked = running_totals(scratch, mixed, ["token"], ["size", "rep"], {"place": F.lit(1)}, "ranked")
    ranked = scratch.save(ranked.withColumn("block", F.floor(F.col("place") / spec.block)), "blocks")
    scratch.drop("ranked")
    nodes = ranked.groupBy("token", "block").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("part").alias("p"), F.max("part").alias("q")
    )
    other = nodes.select("token", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "p", "q")])
    node_pairs = nodes.join(other, "token").where("block <= block2").where(
        f"hi * 100 >= {spec.percent} * lo2 and not (p = q and p2 = q2 and p = p2)"
    )
    node_pairs = node_pairs.select("token", F.col("block").alias("left"), F.col("block2").alias("right"))
    sides = node_pairs.withColumn("side", F.explode(
        F.when(F.col("left") == F.col("right"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    )).withColumn("block", F.when(F.col("side") == 1, F.col("right")).otherwise(F.col("left")))
    members = sides.join(ranked.select("token", "block", "rep", "part"), ["token", "block"]).join(
        bitmaps, "rep"
    ).join(of_rep, "rep").withColumn("mark", F.hash("token"))
    members = members.withColumn("trees", F.filter("marks", lambda m: m < F.col("mark"))).drop("marks", "mark")
    dealt = members.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right", "side", "size", "rep")
    candidates = scratch.save(_traverse(dealt, spec).distinct(), "candidates")
    scratch.drop("mixed", "blocks")
    grown(candidates)

    tops = parts.where("part != rep")
    final = owners.join(broadcast_if_few(tops), "rep", "left").groupBy("key").agg(F.min(F.coalesce("part", "rep")).alias("component_id"))
    out = rows.join(final, "key", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )
    return out


@register("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir):
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
