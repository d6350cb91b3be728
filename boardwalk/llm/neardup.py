"""Near-duplicate vectors by sorted projection passes.

In every pass the vectors are put in the order of their concatenated random hashes, the signs of
projections on random directions, so that close vectors tend to be near each other.  Each is then
compared with its whole block of consecutive places and with the ``window`` places before the block.
A vector with links in the far half of that window goes on to the blocks before, twice as many each
time, until none of them brings a link; so groups of any size are met whole.  Verified pairs of all
passes are united.  Equal codes are ordered anew in every pass.  Equal vectors are one class from the
start, so copies cost nothing and are never paired.  A task holds a block and what it is set against.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, components, join_counted, running_totals, ship
from boardwalk.llm.registry import register, table

PASSES, WINDOW, BLOCK, SEED = 20, 256, 1024, 20240


def directions(dim: int, passes: int, seed: int = SEED) -> np.ndarray:
    """64 random directions for each pass, the same on every machine."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * 64))


def _codes(classes: DataFrame, passes: int) -> DataFrame:
    """(rep, codes): for each pass 64 signs packed in one number, first direction first."""

    def work(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            reps, vectors = batch.column(0), batch.column(1)
            ends, flat = np.asarray(vectors.offsets), np.asarray(vectors.values, np.float64)
            codes = np.zeros((len(reps), passes), np.int64)
            for dim in np.unique(np.diff(ends)):
                at = np.flatnonzero(np.diff(ends) == dim)
                plane = planes.setdefault(int(dim), directions(int(dim), passes))
                for part in np.array_split(at, max(1, len(at) // 2000)):
                    x = flat[ends[part][:, None] + np.arange(dim)]
                    bits = np.packbits((x @ plane > 0).reshape(len(part), passes, 64), axis=2)
                    codes[part] = bits.view(">i8")[:, :, 0].astype(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), passes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([reps, lists], ["rep", "codes"])

    return classes.select("rep", "vector").mapInArrow(work, "rep long, codes array<long>")


def _arrays(block: pa.Table):
    """Places, representatives, blocks in all passes, and vectors with their lengths, in order of place."""
    order = np.argsort(np.asarray(block.column("place")), kind="stable")
    homes = np.asarray(block.column("homes").combine_chunks().flatten()).reshape(len(order), -1)
    vectors = block.column("vector").combine_chunks()
    ends, flat = np.asarray(vectors.offsets), np.asarray(vectors.values, np.float64)
    take = lambda at: flat[ends[:-1][order[at]][:, None] + np.arange(np.diff(ends)[order[at[0]]])]
    place, rep = np.asarray(block.column("place"))[order], np.asarray(block.column("rep"))[order]
    return order, place, rep, homes[order], np.diff(ends)[order], take


def _linked(x: np.ndarray, y: np.ndarray, threshold: float):
    """(i, j) of linked rows of ``x`` and ``y``, for some rows of ``x`` at a time."""
    norm_x, norm_y = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, y))
    for start in range(0, len(x), 256):
        some = slice(start, start + 256)
        i, j = np.nonzero((x[some] @ y.T) / (norm_x[some][:, None] * norm_y[None, :]) >= threshold)
        yield i + start, j


def _result(pairs: list, going: list) -> pa.Table:
    """Pairs (a, b), then the vectors that go on, with a null b."""
    cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    one, two, on = cat([p[0] for p in pairs]), cat([p[1] for p in pairs]), np.unique(cat(going))
    b = pa.array(np.maximum(one, two), pa.int64())
    return pa.table({"a": np.concatenate([np.minimum(one, two), on]), "b": pa.chunked_array([b, pa.nulls(len(on), pa.int64())])})


def _compare(turn: int, block: pa.Table, threshold: float, window: int, size: int) -> pa.Table:
    """Pairs of a block: each vector of the block itself with those before it in this table.

    A pair whose two vectors share a block in an earlier pass has been told there.
    """
    order, place, rep, homes, length, take = _arrays(block)
    own = np.asarray(block.column("own").to_numpy(zero_copy_only=False))[order]
    pairs, going = [], []
    for dim in np.unique(length):
        at = np.flatnonzero(length == dim)
        mine = at[own[at]]
        if not len(mine):
            continue
        begin = place[mine[0]] // size * size
        for i, j in _linked(take(mine), take(at), threshold):
            i, j = mine[i], at[j]
            going.append(rep[i[place[j] < begin - window // 2]])
            new = (place[j] < place[i]) & ~(homes[i, :turn] == homes[j, :turn]).any(axis=1)
            pairs.append((rep[i[new]], rep[j[new]]))
    return _result(pairs, going)


def _extend(asking: pa.Table, asked: pa.Table, threshold: float) -> pa.Table:
    """Pairs of the vectors that go on with those of an earlier block; pairs that share a block have been told."""
    if not asking.num_rows or not asked.num_rows:
        return _result([], [])
    _, _, rep, homes, length, take = _arrays(asking)
    _, _, rep2, homes2, length2, take2 = _arrays(asked)
    pairs, going = [], []
    for dim in np.intersect1d(length, length2):
        at, at2 = np.flatnonzero(length == dim), np.flatnonzero(length2 == dim)
        for i, j in _linked(take(at), take2(at2), threshold):
            i, j = at[i], at2[j]
            going.append(rep[i])
            new = ~(homes[i] == homes2[j]).any(axis=1)
            pairs.append((rep[i[new]], rep2[j[new]]))
    return _result(pairs, going)


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
    passes: int = PASSES, window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; ``key`` is an integer.

    Every link has a cosine of at least ``threshold`` in double precision; a pair that in no pass is in
    one block, within a window, or in blocks that other links lead to is not found.  Vectors that are null, empty or zero, hold null, NaN or infinite
    components, or have a null key link with nothing; vectors of different lengths don't either.
    ``component_id`` is the smallest key reachable by links.  Rows with equal vectors are linked
    with each other and share their links.  Repeated keys give repeated rows.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "neardup")
    v = F.col("vector")
    whole = (
        v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0) & F.col("key").isNotNull()
    )
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = scratch.save(rows.withColumn("whole", F.coalesce(whole, F.lit(False))), "rows")
    good = rows.where("whole").drop("whole")
    classes = good.groupBy("vector").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    classes = scratch.save(classes, "classes")

    if window > block:
        raise ValueError("the window can't be longer than a block")
    codes = _codes(classes, passes).select("rep", F.posexplode("codes").alias("pass", "code"))
    codes = codes.withColumn("tie", F.xxhash64("rep", "pass"))
    places = running_totals(scratch, codes, ["pass"], ["code", "tie", "rep"], {"place": F.lit(1)}, "codes")
    placed = places.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda x: x["place"].cast("long")).alias("places"))
    placed = placed.join(classes.select("rep", "vector"), "rep").select(
        "rep", "vector", "places", F.transform("places", lambda p: F.floor(p / block).cast("int")).alias("homes")
    )
    placed = scratch.save(placed, "placed")
    at = F.floor(F.col("place") / block).cast("long")
    homes = F.array(F.struct(at.alias("block"), F.lit(True).alias("own")))
    homes = F.when(
        F.col("place") % block >= block - window, F.concat(homes, F.array(F.struct((at + 1).alias("block"), F.lit(False).alias("own"))))
    ).otherwise(homes)
    blocks = placed.select("rep", "vector", "homes", F.posexplode("places").alias("pass", "place")).select(
        "pass", "rep", "vector", "homes", "place", F.explode(homes).alias("home")
    ).select("pass", "home.*", "rep", "place", "homes", "vector")

    def compare(key, t):
        out = _compare(key[0].as_py(), t, threshold, window, block)
        return out.append_column("pass", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

    found = scratch.save(blocks.groupBy("pass", "block").applyInArrow(compare, "a long, b long, pass int"), "found0")
    links, reach = found.where("b is not null").select("a", "b"), 1
    going = scratch.save(found.where("b is null").select("pass", F.col("a").alias("rep")).distinct(), "going0")
    spots = placed.select("rep", F.posexplode("places").alias("pass", "place")).withColumn("block", at)
    while going.limit(1).count():  # the distance doubles, so the turns are few
        asks = going.join(spots, ["rep", "pass"]).where(F.col("block") >= reach)
        asks = asks.withColumn("target", F.explode(F.sequence(F.greatest(F.col("block") - 2 * reach + 1, F.lit(0)), F.col("block") - reach)))
        asks = scratch.save(asks, f"asks{reach}")
        wanted = asks.select("pass", "block", "target").distinct()
        asked = spots.join(wanted.withColumnsRenamed({"block": "asker", "target": "block"}), ["pass", "block"])
        asked = asked.select("rep", "pass", "place", F.col("asker").alias("block"), F.col("block").alias("target"))
        body = placed.select("rep", "homes", "vector")

        def extend(key, t, u):
            out = _extend(t, u, threshold)
            return out.append_column("pass", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

        by = ["pass", "block", "target"]
        more = asks.join(body, "rep").groupBy(*by).cogroup(asked.join(body, "rep").groupBy(*by))
        more = scratch.save(more.applyInArrow(extend, "a long, b long, pass int"), f"found{reach}")
        links = links.unionByName(more.where("b is not null").select("a", "b"))
        going = scratch.save(more.where("b is null").select("pass", F.col("a").alias("rep")).distinct(), f"going{reach}")
        reach *= 2
    links = scratch.save(links.distinct(), "links")

    sizes = classes.select("rep", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, F.col("b") == F.col("rep")).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    part_of = components(scratch, links, "a", "b").withColumnRenamed("node", "rep")
    summed = classes.join(others, "rep", "left").join(part_of, "rep", "left").select(
        "vector", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    summed = scratch.save(summed, "summed")
    found = join_counted(good, summed, ["vector"], "n", rows.count()).select("key", "n_links", "component_id")
    rest = rows.where("not whole").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = found.unionByName(rest).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("key", key)


@register("op2_embedding_neardup")
def op2_embedding_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
