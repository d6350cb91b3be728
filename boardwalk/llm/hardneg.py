"""Hard negatives by inner product, found in R-trees packed by sort-tile-recursive order.

Spark packs the upper levels: vectors are sorted along their widest axis and cut into slabs, each slab
is sorted along the second widest and cut into tiles of ``Mine.tile`` vectors.  A task packs a tile
further, down to leaves of ``Mine.leaf``, and keeps the bounding box of every node.  For a query vector
a box gives each coordinate's interval of products, and their sums bound the scores inside.  Nodes wait
in a queue, the highest bound first; a node goes unopened if its interval misses the score window or
lies strictly below the k-th best score known, so that equal scores stay.

A query first looks through its own tile, which gives the k-th score that prunes the other tiles.
Queries go to the tiles in blocks, a tile and a block to a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, broadcast_if_few, running_totals, ship
from boardwalk.llm.registry import register, table


@dataclass(frozen=True)
class Mine:
    """Positives of an anchor, negatives of a positive, their window in percent of its score, and sizes that change no result."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    tile: int = 2048
    leaf: int = 64
    fan: int = 8
    block: int = 4096


class Tree:
    """R-tree over the rows of a matrix: packed leaves, then ``fan`` nodes to a node up to one root.

    Sums of products are exact: whole numbers in doubles while they fit, Python's own numbers beyond.
    """

    def __init__(self, x: np.ndarray, leaf: int, fan: int):
        self.x, self.children = x, []
        wide = np.argsort(-np.ptp(x, axis=0).astype(float), kind="stable")[:3] if x.shape[1] else np.zeros(0, int)
        self.leaves = [*self._packed(np.arange(len(x)), list(wide), leaf)]
        low, high = [x[at].min(axis=0) for at in self.leaves], [x[at].max(axis=0) for at in self.leaves]
        level = list(range(len(self.leaves)))
        while len(level) > 1:
            upper = []
            for i in range(0, len(level), fan):
                own = level[i : i + fan]
                low.append(np.min([low[n] for n in own], axis=0))
                high.append(np.max([high[n] for n in own], axis=0))
                self.children.append(own)
                upper.append(len(low) - 1)
            level = upper
        self.root, self.low, self.high = level[0], np.array(low), np.array(high)

    def _packed(self, at: np.ndarray, axes: list, leaf: int):
        pages = -(-len(at) // leaf)
        if pages <= 1 or not axes:
            yield from np.array_split(at, max(1, pages))
            return
        at = at[np.argsort(self.x[at, axes[0]], kind="stable")]
        slabs = pages if len(axes) == 1 else int(np.ceil(pages ** (1 / len(axes))))
        for part in np.array_split(at, slabs):
            yield from self._packed(part, axes[1:], leaf)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each row of ``q`` in every node."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


@dataclass
class Asks:
    """Searches of one tile: row of ``q``, own key, label, whether it must be the same, rows wanted, and bounds on the score.

    Scores lie in ``least`` <= 100 * score <= ``most`` and are not below ``known``.
    """

    q: np.ndarray
    at: np.ndarray
    key: np.ndarray
    label: np.ndarray
    same: np.ndarray
    k: np.ndarray
    least: np.ndarray
    most: np.ndarray
    known: np.ndarray


def search(tree: Tree, keys: np.ndarray, labels: np.ndarray, asks: Asks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, score, key) of the best rows of every ask, best first, equal scores by key.

    Every ask has its own queue.  In each turn all of them open their node with the highest bound, and
    those that open the same leaf share one product with its rows.
    """
    lowest, highest = (x[asks.at] for x in tree.bounds(asks.q))
    waiting = np.zeros(highest.shape, bool)  # nodes in the queues
    waiting[:, tree.root] = True
    never = -np.inf
    floor = asks.known.copy()
    found = [np.zeros(0, np.int64), np.zeros(0, asks.q.dtype), np.zeros(0, np.int64)]
    live = np.arange(len(asks.at))
    while len(live):
        queue = np.where(waiting[live], highest[live], never)
        node = queue.argmax(axis=1)
        bound = queue[np.arange(len(live)), node]
        going = (bound > never) & (bound >= floor[live]) & (100 * bound >= asks.least[live])  # all others are bounded by less
        live, node = live[going], node[going]
        waiting[live, node] = False
        inside = 100 * lowest[live, node] <= asks.most[live]
        new = []
        for n in np.unique(node[inside]):
            own = live[inside & (node == n)]
            if n >= len(tree.leaves):
                waiting[np.ix_(own, tree.children[n - len(tree.leaves)])] = True
                continue
            at = tree.leaves[n]
            score = asks.q[asks.at[own]] @ tree.x[at].T
            ok = (labels[at][None, :] == asks.label[own][:, None]) == asks.same[own][:, None]
            ok &= (keys[at][None, :] != asks.key[own][:, None]) & (score >= floor[own][:, None])
            ok &= (100 * score >= asks.least[own][:, None]) & (100 * score <= asks.most[own][:, None])
            i, j = np.nonzero(ok)
            new.append((own[i], score[i, j], keys[at[j]]))
        if new:
            ask, score, key = (np.concatenate(x) for x in zip(found, *new, strict=True))
            order = np.lexsort((key, -score, ask))
            ask, score, key = ask[order], score[order], key[order]
            rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
            keep = rank < asks.k[ask]
            found = [ask[keep], score[keep], key[keep]]
            full = rank == asks.k[ask] - 1
            floor[ask[full]] = np.maximum(floor[ask[full]], score[full])
    return tuple(found)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of one length; doubles if every score fits in one exactly."""
    x = np.array(vectors.to_pylist(), np.int64).reshape(len(vectors), -1)
    large = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x.astype(np.float64) if large * large * 100 * max(1, x.shape[1]) < 1 << 53 else x.astype(object)


def _answer(rows: pa.Table, asks: pa.Table, spec: Mine) -> pa.Table:
    """(ask, score, key) that a tile has for each ask."""
    out = [np.zeros(0, np.int64)] * 3
    if rows.num_rows and asks.num_rows:
        x, q = _matrix(rows.column("x")), _matrix(asks.column("x"))
        if x.dtype != q.dtype:
            x, q = (m if m.dtype == object else m.astype(np.int64).astype(object) for m in (x, q))
        code = {v: i for i, v in enumerate(set(rows.column("label").to_pylist()))}
        label = [np.array([code.get(v, -1) for v in t.column("label").to_pylist()]) for t in (rows, asks)]
        score = asks.column("score").to_pylist()
        bound = lambda low, values: np.array([low if v is None else v for v in values], x.dtype)
        out = search(Tree(x, spec.leaf, spec.fan), np.asarray(rows.column("key")), label[0], Asks(
            q, np.arange(len(q)), np.asarray(asks.column("key")), label[1], np.array([s is None for s in score]),
            np.where([s is None for s in score], spec.positives, spec.negatives),
            bound(-np.inf, [spec.low * s if s is not None else None for s in score]),
            bound(np.inf, [spec.high * s if s is not None else None for s in score]),
            bound(-np.inf, asks.column("known").to_pylist()),
        ))
    ask = asks.column("ask").combine_chunks() if asks.num_rows else pa.array([], pa.string())
    return pa.table({"ask": ask.take(pa.array(out[0])), "score": pa.array([int(s) for s in out[1]], pa.int64()), "key": pa.array(out[2], pa.int64())})


def _search(scratch: Scratch, rows: DataFrame, tiles: DataFrame, asks: DataFrame, k: int, spec: Mine, name: str) -> DataFrame:
    """(ask, score, key, rank): the k best rows of each ask over all tiles of its length."""
    kind = "ask string, score long, key long"

    def answer(rows, asks):
        return _answer(rows, asks, spec)

    near = asks.withColumn("known", F.lit(None).cast("long"))
    own = rows.groupBy("tile").cogroup(near.groupBy("tile")).applyInArrow(lambda key, a, b: answer(a, b), kind)
    own = scratch.save(own, f"{name}_own")
    known = own.groupBy("ask").agg(F.count("*").alias("c"), F.min("score").alias("known")).where(f"c = {k}")
    far = asks.join(known.select("ask", "known"), "ask", "left")
    far = far.withColumn("block", F.pmod(F.xxhash64("anchor"), F.col("blocks")))
    pairs = far.select("dim", "block").distinct().join(tiles, "dim")
    pairs = scratch.save(pairs, f"{name}_pairs")  # blocks of queries against tiles of rows
    asked = far.withColumnRenamed("tile", "home").join(pairs, ["dim", "block"]).where("tile != home")
    by = ["tile", "block"]
    there = rows.join(pairs.select("tile", "block"), "tile")
    rest = there.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(lambda key, a, b: answer(a, b), kind)
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "key")
    both = own.unionByName(scratch.save(rest, f"{name}_rest")).withColumn("rank", F.row_number().over(order))
    return scratch.save(both.where(F.col("rank") <= k), name)


def _tiled(scratch: Scratch, rows: DataFrame, spec: Mine) -> DataFrame:
    """Add ``dim``, ``tile`` and ``row``: the upper levels of the tree, each length by itself."""
    rows = rows.withColumn("dim", F.size("x"))
    spread = rows.select("dim", F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.var_pop("v").alias("v"))
    second = Window.partitionBy("dim").orderBy(F.desc("v"), "at")
    axes = spread.withColumn("n", F.row_number().over(second)).where("n <= 2").groupBy("dim").agg(
        F.min_by("at", "n").alias("one"), F.max_by("at", "n").alias("two")
    )
    pages = F.ceil(F.col("rows") / spec.tile)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.sqrt(pages))).withColumn(
        "slabs", F.ceil(pages / F.col("parts"))
    )
    lengths = scratch.save(sizes.join(axes, "dim", "left"), "lengths")  # a row for each length
    told = rows.join(broadcast_if_few(lengths), "dim").withColumns(
        {c: F.coalesce(F.get("x", F.col(c)), F.lit(0)) for c in ("one", "two")}
    )
    first = running_totals(scratch, told, ["dim"], ["one", "key"], {"place": F.lit(1)}, "first")
    first = first.withColumn("slab", F.floor(F.col("place") * F.col("slabs") / F.col("rows"))).drop("place")
    then = running_totals(scratch, first, ["dim", "slab"], ["two", "key"], {"place": F.lit(1)}, "second")
    part = F.floor(F.col("place") * F.col("parts") / F.ceil(F.col("rows") / F.col("slabs")))
    tile = F.concat_ws("-", "dim", "slab", part)
    return then.select("key", "label", "x", "anchor", "dim", tile.alias("tile"), F.concat_ws("-", "dim", "slab", "place").alias("row"))


def mine(
    df: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, spec: Mine = Mine()
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` marks.

    ``key`` is an integer.  Rows with a null key, label or vector, or with a null, NaN or infinite
    component take no part.  Each component x counts as floor(``scale`` * x), and a score is the inner
    product of these whole numbers; it must fit a long.  Vectors of different lengths have no score.
    An anchor's positives are the first ``spec.positives`` rows of its label, its negatives for each of them the
    first ``spec.negatives`` rows of other labels with a score from ``spec.low`` to ``spec.high`` percent
    of the positive's.  Higher scores come first, ties by smaller key.  Rows with the anchor's own key
    are neither.  Rows equal in key, label and vector count once; other rows that share a key are
    anchors, positives and negatives each for itself.  Positives without negatives give no row.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hardneg")
    v = F.col("v")
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).dropna(subset=["key", "label", "v"])
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.select("key", "label", "anchor", F.transform(v, lambda x: F.floor(x * scale)).alias("x")).distinct()
    rows = scratch.save(_tiled(scratch, rows, spec), "rows")
    tiles = scratch.save(rows.groupBy("dim", "tile").agg(F.count("*").alias("rows")).select("dim", "tile"), "tiles")
    chosen = rows.where("anchor").drop("anchor")
    blocks = chosen.groupBy("dim").agg(F.ceil(F.count("*") / spec.block).alias("blocks"))
    chosen = scratch.save(chosen.join(F.broadcast(blocks), "dim").withColumnRenamed("row", "anchor"), "anchors")
    body = rows.select("key", "label", "x", "tile")

    asks = chosen.withColumns({"ask": F.col("anchor"), "score": F.lit(None).cast("long")})
    positives = _search(scratch, body, tiles, asks, spec.positives, spec, "positives")
    told = positives.select(
        F.col("ask").alias("anchor"), F.concat_ws(":", "ask", "rank").alias("ask"), F.col("key").alias("positive_id"), "score"
    )
    asks = told.join(chosen, "anchor")
    negatives = _search(scratch, body, tiles, asks.drop("positive_id"), spec.negatives, spec, "negatives")
    named = asks.select("ask", F.col("key").alias("anchor_id"), "positive_id", F.col("score").alias("positive_score"))
    return negatives.join(named, "ask").select(
        "anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, other) as k from s where same) where k <= 5),
n as (select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


@register("op12_hard_negatives", SQL)
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)
