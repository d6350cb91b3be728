"""Stored facet views that follow a bucketed postings table crawl by crawl."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.operators.facets import COUNTRY_UNKNOWN, snapshot, snapshot_change
from boardwalk.schemas import MAX_AGE_DAYS
from boardwalk.streaming.buckets import BucketedPostings
from boardwalk.streaming.tables import VersionedTable

VIEWS = "shape_key string, dim string, value string, n bigint, computed_at timestamp_ntz"


class StoredFacets:
    """Counts of ``shapes`` under ``root``; one version for each version of the postings that was asked for.

    A refresh reads the open rows of buckets rewritten since the last one, before and after, and of the
    others only what the age limit has passed since.  The first refresh, one after the shapes or the age
    limit changed, and one whose predecessor's postings are forgotten count the open rows as a whole.
    """

    def __init__(self, spark: SparkSession, root: str, shapes: list[tuple], max_age_days: int = MAX_AGE_DAYS):
        self.spark, self.shapes, self.max_age_days = spark, shapes, max_age_days
        # views of another age limit are another table
        self.table = VersionedTable(spark, f"{root.rstrip('/')}/days={max_age_days}", VIEWS)

    def _base(self, store: BucketedPostings, version: int) -> int | None:
        """The newest version that the next one can start from."""
        older = [v for v in self.table.versions() if v < version]
        if not older or not store.manifests.has(older[-1]):
            return None
        stated = self.table.before(version).where(F.col("dim") == COUNTRY_UNKNOWN).select("shape_key")
        known = {r["shape_key"] for r in stated.collect()}  # one row for each shape
        return older[-1] if known == {s[0] for s in self.shapes} else None

    def refresh(self, store: BucketedPostings, version: int, now: str) -> None:
        """Store the views of a version of the postings as of ``now``; nothing if they are there."""
        if self.table.has(version):
            return
        base = self._base(store, version)
        if base is None:
            fresh = snapshot(store.read(open_only=True, version=version), self.shapes, now, self.max_age_days)
            self.table.write(version, fresh.coalesce(1))
            return
        stored = self.table.before(version)
        then = str(stored.select("computed_at").first()[0])
        old, new, rest = store.open_changes(base, version)
        changed = snapshot_change(stored, old, new, rest, self.shapes, then, now, self.max_age_days)
        self.table.write(version, changed.coalesce(1))

    def latest(self) -> DataFrame:
        return self.table.latest()
