"""Helpers of the text operators: shared tables, running totals, joins on hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same text works in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python finds it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        # the driver serves this file as long as it runs, so it stays
        name = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent).as_posix())
        sc.addPyFile(name)
        _SHIPPED.add(sc.applicationId)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row, however often later steps name them."""
    kept = [c for c in df.columns if c not in columns]
    once = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    out = df.select(*kept, once.alias("__once__"))
    return out.select(*kept, *[F.col(f"__once__.{k}").alias(k) for k in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[sc.applicationId]


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and lost executors cost nothing."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def set_aside(df: DataFrame, results: list[str]) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """(rows with columns named by place, the new name of each column, columns that undo it).

    No name of the caller can then meet one of an operator's own.  Columns named as one of
    ``results``, in any case, are left out of what is given back.
    """
    names = {c: f"_caller{i}" for i, c in enumerate(df.columns)}
    taken = {r.lower() for r in results}
    back = [F.col(new).alias(c) for c, new in names.items() if c.lower() not in taken]
    return df.toDF(*names.values()), names, back


def running_totals(
    scratch: Scratch, df: DataFrame, by: list[str], order: list[str], totals: dict[str, Column], name: str
) -> DataFrame:
    """Add, for each total, the sum over the rows that come before within ``by`` in ``order``.

    The rows are range-partitioned by (by, order), so a group of any size is dealt over many
    tasks.  Sums within a partition and one row of sums for each (group, partition) then give
    the totals; no task ever holds a whole group.  ``order`` sorts nulls first.
    """
    n = partitions_of(scratch.spark)
    df = df.withColumns({f"_v_{k}": v for k, v in totals.items()})
    ranged = df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())
    saved = scratch.save(ranged, name)
    keys = [*by, "_part"]
    sums = saved.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals])
    carry = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{k}").over(carry), F.lit(0)).alias(f"_c_{k}") for k in totals],
    )
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = saved.withColumns({f"_r_{k}": F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)) for k in totals})
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(carried[f"_k_{k}"])
    kept = [c for c in df.columns if not c.startswith("_v_")]
    return rows.join(carried, cond).select(
        *[rows[c] for c in kept], *[(F.col(f"_r_{k}") + F.col(f"_c_{k}")).alias(k) for k in totals]
    )


#: Rows up to which a written table is broadcast; its rows must be short.
FEW_ROWS = 20_000


def broadcast_if_few(saved: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """Mark a written table for broadcast if a count shows at most ``limit`` rows; else leave it to be shuffled."""
    return F.broadcast(saved) if saved.limit(limit + 1).count() <= limit else saved


#: A key is hot from this share of all rows on; so there are at most as many hot keys as its inverse.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of many rows with one row for each key, of which ``count`` tells the rows.

    Keys with over 1/1000 of all rows are fewer than 1000, so they are broadcast and their rows
    stay where they are; all other keys are shuffled.  Neither way leaves rows out.
    """
    hot = F.broadcast(keyed.where(F.col(count) * HOT_SHARE > F.lit(total)))
    cold = keyed.where(F.col(count) * HOT_SHARE <= F.lit(total))
    near = rows.join(hot, keys)
    far = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def components(scratch: Scratch, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Alternates large-star and small-star steps until the links form stars.  Minima are taken by
    aggregates that combine before the shuffle; every round is a written table.
    """
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges, before, turn = scratch.save(edges, "edges0"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = scratch.save(small, f"edges{turn}")
        scratch.drop(f"edges{turn - 1}")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
