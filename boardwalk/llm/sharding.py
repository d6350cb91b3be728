"""Sharding by a k-d tree over document metadata: leaves of near equal bytes.

A node that stands for k shards is split along its widest dimension at the weighted median (for odd
k, at the quantile that gives both sides their part).  All nodes of a level are split together: one
range-sorted pass of running byte totals over narrow rows, with no text in it.  A node of any size
is dealt over many tasks, and only a row for each node, never more than shards, reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, broadcast_if_few, running_totals, text_bytes
from boardwalk.llm.registry import register, table

# Fixed value: bytes that a document takes besides its text.
OVERHEAD = 16


def text_axis(c: Column) -> Column:
    """A number in the order of the text's first six bytes; null before all."""
    head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def document_axes(df: DataFrame, key: str = "doc_id") -> dict[str, Column]:
    """Metadata dimensions of ``documents``, as far as the columns are there."""
    axes = {c: text_axis(F.col(c)) for c in ("source", "lang") if c in df.columns}
    axes["size"] = F.log2(F.col("size").cast("double"))
    axes["key"] = F.coalesce(F.col(key).cast("double"), F.lit(-1.0))
    return axes


def shard(
    df: DataFrame, key: str = "doc_id", text: str = "text", axes: dict[str, Column] | None = None,
    shards: int | None = None, target_bytes: int | None = None,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; give ``shards`` or ``target_bytes``.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none and checksum 0.  Shards are
    numbered in tree order from 0, slots from 0 by key (null first) without gaps.  Axes are numbers;
    where rows tie along the split axis a hash of the key decides, so any axis can be cut anywhere,
    and a hot value, key or text is divided like other rows.  Equal texts are not held together:
    that would make bytes unequal.  Repeated rows count one by one.  Shards may be empty when there
    are fewer rows than shards or a document exceeds the target.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    scratch = Scratch(df.sparkSession, "shard")
    sized = df.withColumns({"size": text_bytes(F.col(text)) + OVERHEAD, "crc": F.crc32(F.coalesce(text, F.lit(""))).cast("long")})
    axes = axes or document_axes(df, key)
    names = list(axes)
    rows = sized.select(
        F.col(key).alias("key"), "size", "crc", F.xxhash64(F.col(key), "crc").alias("tie"),
        *[v.cast("double").alias(f"a_{k}") for k, v in axes.items()],
    )
    rows = scratch.save(rows, "rows")
    spans = [f(f"a_{k}").alias(f"{n}_{k}") for k in names for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("bytes"), *spans).first()
    total = whole["bytes"] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    wide = {k: (whole[f"hi_{k}"] or 0) - (whole[f"lo_{k}"] or 0) or 1.0 for k in names}
    rows, counts, level = rows.withColumn("node", F.lit(0)), {0: shards}, 0
    while any(k > 1 for k in counts.values()):
        splits = []
        for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *spans).collect():
            k = counts[r["node"]]
            axis = max(names, key=lambda a: ((r[f"hi_{a}"] - r[f"lo_{a}"]) / wide[a], -names.index(a)))
            splits.append((r["node"], names.index(axis), r["bytes"] * (k // 2) / k, r["node"] + k // 2 if k > 1 else None))
        nodes = scratch.save(df.sparkSession.createDataFrame(splits, "_n int, axis int, cut double, right int"), f"nodes{level}")
        placed = rows.join(broadcast_if_few(nodes), F.col("node") == F.col("_n")).drop("_n")
        placed = placed.withColumn("v", F.get(F.array(*[f"a_{k}" for k in names]), F.col("axis")))
        moved = running_totals(scratch, placed, ["node"], ["v", "tie", "key", "size"], {"before": F.col("size")}, f"level{level}")
        right = F.col("right").isNotNull() & (F.col("before") + F.col("size") / 2 >= F.col("cut"))
        moved = moved.withColumn("node", F.when(right, F.col("right")).otherwise(F.col("node")))
        rows = scratch.save(moved.select("key", "size", "crc", "tie", *[f"a_{k}" for k in names], "node"), f"split{level}")
        scratch.drop(f"level{level}", f"nodes{level}", "rows" if not level else f"split{level - 1}")
        counts = {n: k for at, c in counts.items() for n, k in ([(at, 1)] if c == 1 else [(at, c // 2), (at + c // 2, c - c // 2)])}
        level += 1
    slots = running_totals(scratch, rows, ["node"], ["key", "crc", "size"], {"slot": F.lit(1)}, "slots")
    return slots.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("node").alias("shard"), F.col("slot").cast("long").alias("slot")
    )


@register("op6_kd_shards")
def op6_kd_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return shard(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
