"""Staged columns."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out exactly once per row.

    The columns travel through a one-element ``explode``.  Filter pushdown and project
    merging stop there, so a later filter on a deep verdict does not copy the rules
    behind it into every place that mentions it.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    out = df.select(*kept, packed.alias("_packed"))
    return out.select(*kept, *[F.col(f"_packed.{k}").alias(k) for k in columns])


def per_value(df: DataFrame, read: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add the columns of ``work``, worked out once for each distinct set of values in ``read``.

    ``work`` may look at the columns ``read`` alone and keeps their rows.  Postings repeat titles and
    texts over boards and crawls, so costly rules see each text once and rows only pay a join.  Rows
    and values meet by a hash and by the values themselves, nulls included.
    """
    judged = work(df.select(*read).distinct())
    added = [c for c in judged.columns if c not in read]
    values = judged.select(F.xxhash64(*read).alias("_hash"), *[F.col(c).alias(f"_read_{i}") for i, c in enumerate(read)], *added)
    rows = df.drop(*added)
    same = F.col("_hash_of") == F.col("_hash")
    for i, c in enumerate(read):
        same = same & F.col(c).eqNullSafe(F.col(f"_read_{i}"))
    met = rows.withColumn("_hash_of", F.xxhash64(*read)).join(values, same, "left")
    return met.select(*rows.columns, *added)
