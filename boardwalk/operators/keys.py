"""First-wins, caps, interleaving and numbering that hold up under hot keys."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.operators.ordered import running_sums


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` lets Spark cut every map task to one row per key before the
    shuffle, so a key holding a third of the rows costs no more than any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def cap_per_key(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows per key, the first in ``order`` (cut map-side as above)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def join_on_nullable(rows: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    named = sizes.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(named[f"_k_{k}"])
    return rows.join(named, cond, "left").drop(*[f"_k_{k}" for k in keys])


def rank_in_group(df: DataFrame, group: list[str], ord_col: str, out: str = "rank") -> DataFrame:
    """1-based position of each row within its group, ordered by a column.

    Rows are dealt by ranges of (group, order), so neither a large group nor sparse or
    equal order values land in one task.  Null groups are a group, null orders come first;
    rows with equal (group, order) are numbered in no fixed order.
    """
    ranked = running_sums(df, group, [F.col(ord_col)], {"_before": F.lit(1)})
    return ranked.withColumn(out, F.col("_before") + 1).drop("_before", "_before_total")


def interleave(df: DataFrame, group: str, ord_col: str) -> DataFrame:
    """Balanced order across groups: (i + 0.5) / size of the group, then input order.

    Adds ``at``; sort by (at, order column) to read the rows interleaved.  Rows of a null
    group are interleaved as a group of their own.
    """
    ranked = running_sums(df, [group], [F.col(ord_col)], {"_before": F.lit(1)})
    at = (F.col("_before") + F.lit(0.5)) / F.col("_before_total")
    return ranked.withColumn("at", at).drop("_before", "_before_total")


def shard_of_tenant(
    df: DataFrame, shards: int, ord_col: str, provider: str = "provider", token: str = "token"
) -> DataFrame:
    """Every row of a tenant gets one shard: tenants are dealt in order of first sight.

    Tenants are numbered once (one row each), in ranges of that order, then joined back to
    their rows; a null provider or token makes a tenant too.
    """
    rows = df.withColumn("_tenant", F.lower(token))
    first = rows.groupBy(provider, "_tenant").agg(F.min(ord_col).alias("_first"))
    numbered = rank_in_group(first, [], "_first", "_ordinal")
    numbered = numbered.select(
        provider, "_tenant", ((F.col("_ordinal") - 1) % shards).cast("int").alias("shard")
    )
    return join_on_nullable(rows, numbered, [provider, "_tenant"]).drop("_tenant")
