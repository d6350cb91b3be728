"""Landed payload pages and whole-feed snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.schemas import LANDED, NORMALISED, names


def read_landed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Fetched pages: (provider, board_token, extra, page, body)."""
    return spark.read.schema(LANDED).format(fmt).load(path)


def stream_landed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(LANDED).format(fmt).load(path)


def write_snapshot(feed: DataFrame, path: str, fmt: str = "parquet") -> None:
    feed.write.mode("overwrite").format(fmt).save(path)


def read_snapshot(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Vendor outputs in one table; a vendor may lack columns another has."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def postings_of(pages: DataFrame, provider: str, schema: str, path: str | None = None) -> DataFrame:
    """One row per posting of a vendor's JSON pages: board_token, extra, page, pos, j.

    ``schema`` describes the whole body; ``path`` is SQL for the array of postings
    inside it, which is named ``_b``.  Only the named fields are ever parsed.
    """
    body = F.from_json("body", schema)
    parsed = pages.where(F.col("provider") == provider).withColumn("_b", body)
    items = F.col("_b") if path is None else F.expr(path)
    return parsed.select(
        "board_token", "extra", "page", "body", F.posexplode(items).alias("pos", "j")
    ).where(F.col("j").isNotNull())


def normalised(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    """Select the normalised posting; columns a vendor does not state are NULL."""
    from pyspark.sql.types import StructType

    types = {f.name: f.dataType for f in StructType.fromDDL(NORMALISED)}
    given = {
        "provider": F.lit(provider), "board_token": F.col("board_token"),
        "page": F.col("page"), "pos": F.col("pos"), **columns,
    }
    unknown = set(given) - set(types)
    if unknown:
        raise ValueError(f"not a posting column: {sorted(unknown)}")
    return df.select(
        *[given.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names(NORMALISED)]
    )
