"""The postings table in buckets, of which a crawl reads and rewrites only those it concerns.

A row's bucket follows from its board, and each bucket keeps open and closed rows apart.  A version
is a manifest: for every (bucket, open or closed) the version that wrote its files, its number of
rows and its oldest closing.  A crawl rewrites the buckets of the boards that it read, and those with
rows to be purged; all others are only named again.  The manifest is written last, in one piece, and
is the commit: a crawl that died halfway left nothing that counts, one that is replayed finds its
version there.  The manifest has two rows for each bucket at most, so it is read on the driver.
A crawl's rows are written down once before the merge, as the steps that follow read them more than once.

Buckets share out boards; rows of a large board are dealt over many files by their key.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.operators.lifecycle import PURGE_AFTER_DAYS, merge_batch, purge_closed
from boardwalk.streaming.tables import VersionedTable

MANIFEST = "bucket int, closed boolean, wrote long, n long, oldest timestamp_ntz"
FACTS = "version long, at timestamp_ntz, scanned long, upserted long, inserted long, reopened long, closed long, purged long, buckets_read long, buckets_written long"
BOARD = ["provider", "board_token"]


@dataclass(frozen=True)
class Layout:
    """Number of buckets, fixed for the life of a table, and of files that a bucket's rows are dealt over."""

    buckets: int = 64
    files: int = 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*BOARD), F.lit(self.buckets)).cast("int")


class BucketedPostings:
    """Postings under ``root``; ``schema`` holds at least key, provider, board_token and the three state times."""

    def __init__(self, spark: SparkSession, root: str, schema: str, layout: Layout = Layout()):
        self.spark, self.root, self.schema, self.layout = spark, root.rstrip("/"), schema, layout
        self.manifests = VersionedTable(spark, f"{self.root}/manifest", MANIFEST)
        self.log = VersionedTable(spark, f"{self.root}/facts", FACTS)

    def manifest(self, version: int | None = None) -> list:
        """Rows of the manifest of a version, the newest by default."""
        df = self.manifests.latest() if version is None else self.manifests.before(version + 1)
        return df.collect()

    def _folder(self, wrote: int, closed: bool, bucket: int) -> str:
        return f"{self.root}/data/v={wrote:012d}/closed={str(closed).lower()}/bucket={bucket}"

    def _rows(self, parts: list) -> DataFrame:
        folders = [self._folder(p["wrote"], p["closed"], p["bucket"]) for p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, open_only: bool = False, version: int | None = None) -> DataFrame:
        """The table, or its open rows, whose readers never touch the files of closed ones."""
        return self._rows([p for p in self.manifest(version) if not (open_only and p["closed"])])

    def open_changes(self, since: int, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Open rows of the buckets rewritten after ``since``: as they were and as they are; and all other open rows."""
        was = [p for p in self.manifest(since) if not p["closed"]]
        now = [p for p in self.manifest(version) if not p["closed"]]
        same = {(p["bucket"], p["wrote"]) for p in was} & {(p["bucket"], p["wrote"]) for p in now}
        left = lambda parts: [p for p in parts if (p["bucket"], p["wrote"]) not in same]
        return self._rows(left(was)), self._rows(left(now)), self._rows([p for p in now if (p["bucket"], p["wrote"]) in same])

    def concerned(self, batch: DataFrame, healthy: DataFrame | None) -> set[int]:
        """Buckets of the batch's boards and of boards read healthily; none for an empty batch."""
        own = batch.select(self.layout.bucket().alias("bucket")).distinct()
        found = {r["bucket"] for r in own.collect()}  # as many rows as buckets at most
        if found and healthy is not None:
            found |= {r["bucket"] for r in healthy.select(self.layout.bucket().alias("bucket")).distinct().collect()}
        return found

    def apply(
        self, version: int, batch: DataFrame, healthy: DataFrame | None, now, purge: bool = False, days: int = PURGE_AFTER_DAYS,
    ) -> None:
        """One crawl: upsert ``batch`` (one row for each key), close what vanished from healthy boards, purge.

        ``now`` is the crawl's time.  The result is that of ``merge_batch`` and ``purge_closed`` on the
        whole table.  A version that exists is left as it is.
        """
        if self.manifests.has(version):
            return
        at = F.lit(now).cast("timestamp_ntz")
        before = self.manifests.before(version).collect()
        batch, healthy = self._landed(version, batch, healthy)
        touched = self.concerned(batch, healthy)
        if purge:
            limit = self.spark.range(1).select(at - F.make_dt_interval(days=F.lit(days))).first()[0]
            touched |= {p["bucket"] for p in before if p["oldest"] is not None and p["oldest"] < limit}
        read = [p for p in before if p["bucket"] in touched]
        kept = [p for p in before if p["bucket"] not in touched]
        merged = merge_batch(self._rows(read), batch, healthy, at)
        written = self._write(version, purge_closed(merged, at, days) if purge else merged, at)
        rows = [tuple(p) for p in kept] + [(w["bucket"], w["closed"], version, w["n"], w["oldest"]) for w in written]
        self._note(version, at, batch, read, written)
        self.manifests.write(version, self.spark.createDataFrame(rows, MANIFEST).coalesce(1))
        self._clear(self._landing(version))

    def _landing(self, version: int) -> str:
        return f"{self.root}/landed/v={version:012d}"

    def _clear(self, folder: str) -> None:
        self.manifests._fs.delete(self.manifests._path(folder), True)

    def _landed(self, version: int, batch: DataFrame, healthy: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The crawl's rows and its healthy boards as written tables, so that what made them runs once."""
        folder = self._landing(version)

        def land(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        state = ("first_seen_at", "last_seen_at", "closed_at")
        wanted = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in state]
        return land(batch.select(*wanted), "batch"), None if healthy is None else land(healthy.select(*BOARD).distinct(), "healthy")

    def _write(self, version: int, rows: DataFrame, at: Column) -> list:
        """Write a version's buckets; what their manifest rows say, and what the crawl at ``at`` did in them."""
        root = f"{self.root}/data/v={version:012d}"
        placed = rows.withColumns({"closed": F.col("closed_at").isNotNull(), "bucket": self.layout.bucket()})
        part = F.pmod(F.xxhash64("key"), F.lit(self.layout.files))
        placed.repartition("closed", "bucket", part).write.mode("overwrite").partitionBy("closed", "bucket").parquet(root)
        known = f"{self.schema}, closed boolean, bucket int"
        said = self.spark.read.schema(known).parquet(root).groupBy("bucket", "closed").agg(
            F.count("*").alias("n"), F.min("closed_at").alias("oldest"), F.count_if(F.col("last_seen_at") == at).alias("upserted"),
            F.count_if(F.col("first_seen_at") == at).alias("inserted"), F.count_if(F.col("closed_at") == at).alias("shut"),
        )
        return said.collect()  # two rows for each bucket at most

    def _note(self, version: int, at: Column, batch: DataFrame, read: list, written: list) -> None:
        """What the crawl did, counted in the tables that it read and wrote, as one row."""
        total = lambda name: sum(w[name] for w in written)
        shut = self._rows([p for p in read if p["closed"]]).select("key")
        again = shut.join(batch.select("key"), "key", "left_semi").agg(F.count("*").alias("reopened"))
        scanned = batch.agg(F.count("*").alias("scanned"))
        size = sum(p["n"] for p in read)
        counts = {
            "upserted": total("upserted"), "inserted": total("inserted"), "closed": total("shut"),
            "purged": size + total("inserted") - total("n"),
            "buckets_read": len({p["bucket"] for p in read}), "buckets_written": len({w["bucket"] for w in written}),
        }
        facts = one_row(again, scanned).select(
            F.lit(version).cast("long").alias("version"), at.alias("at"), "scanned", "reopened",
            *[F.lit(n).cast("long").alias(name) for name, n in counts.items()],
        )
        self.log.write(version, facts.select(*[c.split()[0] for c in FACTS.split(", ")]))

    def facts(self, version: int) -> DataFrame:
        """The row of what a version's crawl did."""
        return self.log.before(version + 1).where(F.col("version") == version)

    def forget_before(self, version: int, keep: int = 2) -> None:
        """Drop old manifests, and files that no manifest left names any more."""
        self.manifests.forget_before(version, keep)
        self.log.forget_before(version, keep)
        named = {
            self._folder(p["wrote"], p["closed"], p["bucket"]) for v in self.manifests.versions() for p in self.manifest(v)
        }
        fs, path = self.manifests._fs, self.manifests._path
        versions = [s.getPath().toString() for s in fs.listStatus(path(f"{self.root}/data"))]
        for v in versions:
            if int(v.rsplit("=", 1)[1]) >= version:
                continue
            for state in fs.listStatus(path(v)):
                if not state.isDirectory():
                    continue
                for bucket in fs.listStatus(state.getPath()):
                    tail = "/".join(bucket.getPath().toString().rsplit("/", 3)[1:])
                    if f"{self.root}/data/{tail}" not in named:
                        fs.delete(bucket.getPath(), True)


def one_row(*tables: DataFrame) -> DataFrame:
    """Tables of one row each side by side in one."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def run_log(outcomes: DataFrame, facts: DataFrame, started, finished) -> DataFrame:
    """One row of the run log from the crawl's outcomes and the facts of its write.

    A run that stored nothing must not look fresh: its row fails when it is read.
    """
    ok = F.col("error").isNull()
    boards = outcomes.agg(
        F.count("*").alias("boards_total"), F.count_if(ok).alias("boards_ok"), F.count_if(~ok).alias("boards_failed")
    )
    stored = F.when(F.col("upserted") > 0, F.col("upserted")).otherwise(
        F.raise_error("the crawl stored no postings; refusing to mark the corpus fresh").cast("bigint")
    )
    return one_row(boards, facts).select(
        F.lit(started).cast("timestamp_ntz").alias("started_at"), F.lit(finished).cast("timestamp_ntz").alias("finished_at"),
        "boards_total", "boards_ok", "boards_failed",
        F.col("scanned").alias("jobs_scanned"), stored.alias("jobs_upserted"), F.col("closed").alias("jobs_closed"),
    )
