"""Sums and last values along an order, for groups of any size.

Rows are range-partitioned by (group, order) and cut off from their past with a checkpoint, so that
their partitions stay as they are.  What one partition of a group hands to the next is one row; those
rows are added up apart and joined back.  So no task holds more than a range of rows, however large a
group is and however unevenly its order values lie.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.session import checkpoint


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows dealt by (by, order) over the session's shuffle partitions; ``_part`` rises with the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return checkpoint(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))


def _beside(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows next to the one row of their (group, partition); null groups are groups."""
    named = carried.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(named[f"_k_{k}"])
    return rows.join(named, cond).drop(*[f"_k_{k}" for k in keys], "_part")


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add for each name the sum over the rows before within ``by``, and as ``<name>_total`` that of the group."""
    valued = df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    rows, keys = ranged(valued, by, order), [*by, "_part"]
    parts = rows.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *keys,
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(group).alias(f"{k}_total") for k in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    out = _beside(own, carried, keys).withColumns({k: F.col(f"_i_{k}") + F.col(f"_c_{k}") for k in sums})
    return out.select(*df.columns, *sums, *[f"{k}_total" for k in sums])


def last_before(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the last ``value`` that is not null among the rows before within ``by``; null if there is none.

    ``order`` must not leave rows with a value and rows that look for one tied.
    """
    rows, keys = ranged(df.withColumn("_v", value), by, order), [*by, "_part"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(before))
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.where(F.col("_v").isNotNull()).withColumn("_n", F.row_number().over(inside)).withColumn(
        "_last", F.last("_v").over(whole)
    )
    ends = ends.groupBy(*keys).agg(F.max_by("_last", "_n").alias("_last"))
    parts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    parts = _left(parts, ends, keys)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    return _beside(own, carried, keys).withColumn(name, F.coalesce("_own", "_carried")).select(*df.columns, name)


def _left(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    named = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(named[f"_k_{k}"])
    return rows.join(named, cond, "left").drop(*[f"_k_{k}" for k in keys])
