"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Records are dealt to shards by ranges of their key, sorted, and written one gzip member each; a
file is closed when its compressed size reaches the limit.  Shard edges come from exact counts and
every header from the record itself, so the same input gives the same bytes, whatever the cluster
does.  A file is written under a temporary name and renamed, and counts only once the manifest
names it; a task that runs again writes the same file.
"""

from __future__ import annotations

import base64
import hashlib

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, broadcast_if_few, computed, ship
from boardwalk.llm.registry import register, table

# The names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:boardwalk:warc")

RECORD = "key long, url string, payload binary, digest string, bytes long, refers_to long"
MANIFEST = "shard int, file string, records long, bytes long, sha1 string"

def with_revisits(df: DataFrame, key: str, payload: str, url: str, least: int = 1000) -> DataFrame:
    """Rows (key, url, payload, digest, bytes, refers_to) ready to be written.

    Of payloads with equal bytes and at least ``least`` of them the one with the largest key is
    stored; the others refer to it.  Null payloads are empty.  Rows with a null key are stored
    themselves.  Repeats are found by digest and length with counts that combine before the shuffle;
    the digests that occur twice are a table of their own, broadcast if it is short.  ``payload`` is
    null where a row refers to another, so copies are not shuffled.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = computed(df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")),
                    {"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    repeats = (
        rows.where((F.col("bytes") >= least) & F.col("key").isNotNull()).groupBy("digest", "bytes")
        .agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    repeats = broadcast_if_few(Scratch(df.sparkSession, "warc-repeats").save(repeats, "repeats"))
    joined = rows.join(repeats, ["digest", "bytes"], "left")
    refers = F.when(F.col("key") < F.col("kept"), F.col("kept"))
    return joined.withColumn("refers_to", refers).select(
        "key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "bytes", "refers_to"
    )

def shard_edges(rows: DataFrame, target_bytes: int, bins: int = 4096) -> list[int]:
    """Upper keys (exclusive) of all shards but the last, from exact byte counts of equal key bins.

    A fixed number of bins reaches the driver.  A bin is never split here; what is too much for one
    file is rolled by the writer.
    """
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    width = (high - low) // bins + 1
    counts = rows.where("key is not null").groupBy(F.floor((F.col("key") - F.lit(low)) / F.lit(width)).alias("bin"))
    edges, held = [], 0
    for r in counts.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).orderBy("bin").collect():
        weight = r.b + 600 * r.n
        if held and held + weight > target_bytes:
            edges.append(low + r.bin * width)
            held = 0
        held += weight
    return edges

def record_id(key: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}|{url}|{digest}')}>"

def _record(r: dict, date: str) -> bytes:
    """One record as a gzip member; only a stored payload is put in, a revisit keeps its headers."""
    payload = b"" if r["refers_to"] is not None else r["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["bytes"]
    block = http + payload
    b32 = lambda raw: "sha1:" + base64.b32encode(raw).decode()
    heads = [
        ("WARC-Type", "revisit" if r["refers_to"] is not None else "response"),
        ("WARC-Record-ID", record_id(r["key"], r["url"], r["digest"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(r["url"] or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", b32(bytes.fromhex(r["digest"]))),
        ("WARC-Block-Digest", b32(hashlib.sha1(block).digest())),
        ("X-Key", "" if r["key"] is None else str(r["key"])),
        ("X-Payload-Length", str(r["bytes"])),
    ]
    if r["refers_to"] is not None:
        heads += [("WARC-Profile", PROFILE), ("X-Refers-To-Key", str(r["refers_to"]))]
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()

class _Roll:
    """The open file of a shard, under its temporary name until closed."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, number: int):
        self.store, self.shard, self.name = store, shard, f"part-{shard:05d}-{number:05d}.warc.gz"
        self.final, self.temp = f"{folder}/{self.name}", f"{folder}/.{self.name}.{uuid.uuid4().hex}"
        self.out, self.sha, self.n, self.size = store.open_output_stream(self.temp, compression=None), hashlib.sha1(), 0, 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.n, self.size = self.n + 1, self.size + len(data)

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.temp, self.final)
        return self.shard, self.name, self.n, self.size, self.sha.hexdigest()

def write(records: DataFrame, folder: str, roll_bytes: int = 64 << 20, shard_bytes: int = 256 << 20,
          date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write rows of ``with_revisits`` as archives below ``folder``; returns the manifest.

    ``folder`` is a URI that all executors share.  Rows with a null key come first.  Files hold at
    most ``roll_bytes`` compressed, or one record.  Records of one key are ordered by digest and URL.
    The manifest is written as ``folder/manifest`` after all files, and is the commit.
    """
    spark = records.sparkSession
    ship(spark)
    edges = shard_edges(records, shard_bytes)
    shard = F.lit(0)
    for i, edge in enumerate(edges):
        shard = F.when(F.col("key") >= F.lit(edge), F.lit(i + 1)).otherwise(shard) if len(edges) <= 64 else shard
    if len(edges) > 64:  # a search in the sorted edges instead of a chain of tests
        shard = F.coalesce(
            F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("key"))), F.lit(0)
        )
    dealt = records.withColumn("shard", shard.cast("int")).repartitionByRange(len(edges) + 1, "shard")
    dealt = dealt.sortWithinPartitions("shard", "key", "digest", "url")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        roll, number, done = None, 0, []
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                data = _record(r, date)
                if roll and (roll.shard != r["shard"] or roll.size + len(data) > roll_bytes):
                    number = number + 1 if roll.shard == r["shard"] else 0
                    done.append(roll.close())
                    roll = None
                roll = roll or _Roll(store, root, r["shard"], number)
                roll.add(data)
        if roll:
            done.append(roll.close())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    manifest = f"{folder}/manifest"
    dealt.mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)

def _members(data: bytes) -> Iterator[bytes]:
    while data:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data) + unpack.flush()
        data = unpack.unused_data

def _parse(raw: bytes) -> dict:
    """Headers and payload of a record; raises where a length or digest doesn't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    _, _, payload = block.partition(b"\r\n\r\n")
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    stored = fields["WARC-Type"] == "response"
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n" or sha(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if stored and (sha(payload) != fields["WARC-Payload-Digest"] or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    to_key = lambda x: int(x) if x else None
    return {
        "key": to_key(fields["X-Key"]), "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
        "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex(),
        "refers_to": to_key(fields.get("X-Refers-To-Key")), "payload": payload if stored else None,
    }

_READ = pa.schema(
    [("key", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)

def read(spark, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the files that the manifest in ``folder`` names, each checked.

    A file that is missing, or whose bytes differ from the manifest, fails the job; files that the
    manifest doesn't name are not read.  Files come through Spark's binary reader, one to a row, so
    ``roll_bytes`` of the writer bounds what a task holds.
    """
    from pyspark.sql.types import BinaryType, LongType, StringType, StructType

    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = manifest.join(files, F.col("file") == F.col("name"), "left").select("file", "sha1", "content")
    kinds = {pa.int64(): LongType(), pa.string(): StringType(), pa.binary(): BinaryType()}
    schema = StructType()
    arrow = _READ if payloads else pa.schema([f for f in _READ if f.name != "payload"])
    for f in arrow:
        schema = schema.add(f.name, kinds[f.type])

    def work(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                name, sha, data = (batch.column(i)[at].as_py() for i in range(3))
                if data is None or hashlib.sha1(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                held, size = [], 0
                for raw in _members(data):
                    r = _parse(raw)
                    held.append({f.name: r[f.name] for f in arrow})
                    size += len(raw) if payloads else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, arrow)

    return named.mapInArrow(work, schema)

def archive(df: DataFrame, folder: str, key: str, payload: str, url: str, **options) -> DataFrame:
    """Write the rows of ``df`` to archives and return the manifest."""
    return write(with_revisits(df, key, payload, url), folder, **options)

@register(
    "op3_warc_archive",
    """
with d as (select page_id, coalesce(octet_length(encode(html)), 0)::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_bytes, payload_digest, max(page_id) as kept from d where payload_bytes >= 1000 group by all)
select page_id, d.payload_bytes, d.payload_digest,
  case when page_id < kept then 'revisit' else 'response' end as record_type,
  case when page_id < kept then kept end as refers_to
from d left join m on d.payload_bytes = m.payload_bytes and d.payload_digest = m.payload_digest""",
)
def op3_warc_archive(spark, sf_dir):
    folder = Scratch(spark, "warc").path("archive")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive(pages, folder, "page_id", "html", "url", roll_bytes=16 << 20, shard_bytes=16 << 20)
    return read(spark, folder, payloads=False).withColumnRenamed("key", "page_id").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
