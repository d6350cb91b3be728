"""Encoding against the reference library for ranks, offsets and exact round trips."""

import base64
import hashlib

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from boardwalk.llm import bpe  # noqa: E402

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n\n  x", "a\x1cb\x85c\xa0d", "<|endoftext|> it's 12½ 漢字 👍🏽", "é​", "word" * 5000, "  \t tail  ",
]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(plain, text):
    ids = plain.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_digests_of_a_whole_table(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op9_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(plain, docs[r.doc_id])


def test_odd_texts_and_extra_columns(spark, plain):
    rows = [(i, t, "kept", [1]) for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, ids array<int>")
    got = bpe.encode(df).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r.text or "").encode()
        assert r.extra == "kept" and list(r.ids) == plain.encode_ordinary(r.text or "")
        parts = [plain.decode_single_token_bytes(i) for i in r.ids]
        assert list(r.byte_starts) == [sum(map(len, parts[:k])) for k in range(len(parts))] if len(parts) < 100 else True
        for at, char in zip(r.byte_starts, r.char_starts):
            while (raw[at] & 0xC0) == 0x80:
                at -= 1
            assert len(raw[:at].decode()) == char
    back = bpe.decode(bpe.encode(df, offsets=False)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for t in TEXTS * 2)


SPACED = [
    "a b", "a  b", "a   b", " a", "a ", "a  ", "  ", " ", "a\n b", "a \nb", "a\n\n b", "a\n ", "\n a", "a\u00a0 b", "a \u3000b", "it 's ' s don't", "a\u2003b c",
    "x\n\n\ny z.\n Q", "\t a\tb", " \n ", "w1 2w 'll  't", "tail\n", "tail \n", "İ ß ﬁ",
]


@pytest.mark.parametrize("remembered", [300_000, 3])
def test_units_are_cut_where_the_pattern_never_looks_across(plain, monkeypatch, remembered):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    own = bpe.Coder(bpe.vocabulary())
    for texts in (SPACED, SPACED[::-1], [a + b for a in SPACED for b in SPACED]):
        got = own.encode_all(pa.array(texts)).to_pylist()
        assert got == [plain.encode_ordinary(t) for t in texts]


def test_split_characters_and_empty_table(spark):
    ids = bpe.encode(spark.createDataFrame([(1, "漢")], "doc_id long, text string"), offsets=False).first().ids
    one = spark.createDataFrame([(k, [i]) for k, i in enumerate(ids)], "k long, ids array<int>")
    parts = [bytes(r.decoded) for r in bpe.decode(one).orderBy("k").collect()]
    assert len(ids) > 1 and b"".join(parts).decode() == "漢"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty)).count() == 0
    ids = spark.createDataFrame([(None,), ([64, None, 64],), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(ids).collect()] == [b"", b"aa", b""]
