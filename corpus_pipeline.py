"""From documents to token ids: clean, dedup lines, dedup documents, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes
and rereads every stage's result in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardwalk.llm import bpe, linedup, mixing, quality, simjoin
from boardwalk.llm.common import WORD, Scratch, broadcast_if_few

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near duplicates of the pipeline: five-word shingles, four fifths of their union in common.
NEAR = simjoin.Join(words=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    kept = quality.judge(docs.select(*COLUMNS)).where("kept").withColumn("text", F.col("cleaned"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that had nothing else."""
    left = linedup.dedup(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest doc_id.

    Rows are told apart by doc_id and text, so a doc_id with several texts loses only those that have a
    near copy with a smaller doc_id (null comes last).  Rows equal in both are copies of each other; of
    them the one that comes first by the other columns stays.  Texts without words are nobody's copies.
    """
    rows = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    scratch = Scratch(spark, "near")
    groups = scratch.save(simjoin.similar(rows.select("_key", "text"), key="_key", spec=NEAR), "groups").where("n_shingles > 0")
    named = groups.groupBy("_key", "component_id").agg(F.count("*").alias("n"))
    large = named.groupBy("component_id").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where("n > 1")
    members = scratch.save(named.drop("n").join(large, "component_id"), "members")
    ids = rows.join(broadcast_if_few(members.select("_key")), "_key", "left_semi").select("_key", "doc_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    first = members.join(ids.distinct(), "_key").groupBy("component_id").agg(F.min_by("_key", order).alias("_key"))
    first = scratch.save(first.select("_key"), "first")
    single = rows.join(broadcast_if_few(members.select("_key")), "_key", "left_anti")
    chosen = rows.join(broadcast_if_few(first), "_key", "left_semi")
    copies = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")  # cut to one row before the shuffle
    chosen = chosen.withColumn("_n", F.row_number().over(copies)).where("_n = 1")
    return single.select(*COLUMNS).unionByName(chosen.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their digest, and the digest of the bytes decoded from them."""
    named = docs.select("doc_id", "lang", "source", "n_chars", "text")
    coded = bpe.encode(named, offsets=False, carry=["doc_id", "lang", "source", "n_chars"])
    ids_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    coded = coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(ids_text, 256)})
    return bpe.decode(coded, keep_ids=True).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't encode to token ids; tests hold ``run`` against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for turn, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{turn}")
        if turn:
            scratch.drop(f"stage{turn - 1}")
    return docs
