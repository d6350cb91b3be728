"""Archives: round trip, revisits, equal bytes on reruns, damage."""

import hashlib
import os
import tempfile

import pytest

from boardwalk.llm import warc

BIG = "漢字 <p>" * 400
SCHEMA = "page_id long, url string, html string, key string, digest int"


def rows():
    out = [(i, f"https://h{i}.example.org/a b?x={i}", f"<p>{i} " * (i * 7), "k", 1) for i in range(60)]
    out += [(100 + i, "u", BIG, "k", 2) for i in range(30)] + [(200 + i, None, "short", None, 3) for i in range(5)]
    return out + [(300, "u\r\nX: y", None, None, None), (301, "", "", None, None), (None, "n", BIG, None, None), (7, "again", "x", None, None)]


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def files(uri):
    root = uri.removeprefix("file://")
    return {f: hashlib.sha1(open(f"{root}/{f}", "rb").read()).hexdigest() for f in os.listdir(root) if f.endswith(".gz")}


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = folder(), folder()
    manifest = warc.archive(df, a, "page_id", "html", "url", roll_bytes=3000, shard_bytes=20000).collect()
    warc.archive(df.repartition(7), b, "page_id", "html", "url", roll_bytes=3000, shard_bytes=20000)
    assert files(a) == files(b) == {m.file: m.sha1 for m in manifest} and len(manifest) > 4
    assert all(m.bytes <= 3000 or m.records == 1 for m in manifest) and len({m.shard for m in manifest}) > 2
    got = warc.read(spark, a).collect()
    want = sorted((k if k is not None else -1, hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h, _, _ in rows())
    assert sorted((r.key if r.key is not None else -1, r.payload_digest) for r in got) == want
    for r in got:
        copy = r.key is not None and 100 <= r.key < 129
        assert (r.record_type, r.refers_to) == (("revisit", 129) if copy else ("response", None))
        if not copy:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert len({r.record_id for r in got}) == len(got)


def test_damage_is_found(spark):
    a = folder()
    warc.archive(spark.createDataFrame(rows(), SCHEMA), a, "page_id", "html", "url")
    name = a.removeprefix("file://") + "/" + next(iter(files(a)))
    data = open(name, "rb").read()
    open(a.removeprefix("file://") + "/part-99999-00000.warc.gz", "wb").write(b"not named")
    assert warc.read(spark, a).count() == len(rows())
    for crc in os.listdir(os.path.dirname(name)):
        if crc.endswith(".crc"):
            os.remove(f"{os.path.dirname(name)}/{crc}")
    open(name, "wb").write(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="not what the manifest says"):
        warc.read(spark, a).collect()


def test_empty_table(spark):
    a = folder()
    assert warc.archive(spark.createDataFrame([], SCHEMA), a, "page_id", "html", "url").count() == 0
    assert warc.read(spark, a).count() == 0
