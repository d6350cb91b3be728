"""Word BPE against the library on whole texts."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boardwalk.llm import wordbpe
from boardwalk.llm.bpe import vocabulary

SF = "/root/testdata/sf0.001"

HARD = [
    "", None, " ", "don't DON'T 'tis 's ''s ...'s x's'll", "İstanbul İ! ŉ ſ ẞ Σας ΟΔΟΣ ὈΔΥΣΣΕΎΣ.", "áé ́x J̌ ǰ",
    "e​f g h　i\u0085j\x1ck", "<|endoftext|>a<|STARTOFTEXT|><|endoftext|", "!!<|startoftext|>!!", "1234567890 3.14 ²½",
    "日本語 テスト 한국어 각 👍🏽 👨‍👩‍👧", "x" * 3000, "ab1!" * 2000, "ÀÉÎõü Łódź Žluťoučký", "tab\tline\nfeed\x0bvt\x0cff\rcr", "\x00\x01 \x7f",
    "K Å ﬁ ǅ Ⱥ", "same same same", "same same same",
]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(vocabulary(wordbpe.VOCABULARY))
    own.no_truncation()
    own.no_padding()
    return own


@pytest.mark.parametrize("spec", [wordbpe.Table(), wordbpe.Table(head=3, longest=8), wordbpe.Table(head=0)], ids=["all", "few", "none"])
def test_hard_texts(spark, library, spec):
    df = spark.createDataFrame([Row(n=i, text=t, ids="mine", row=7, hash="x", more=None, word="w") for i, t in enumerate(HARD)],
                               "n int, text string, ids string, row int, hash string, more string, word string")
    got = wordbpe.decode(wordbpe.encode(df, spec=spec), keep_ids=True)
    assert got.columns == ["n", "text", "row", "hash", "more", "word", "ids", "decoded"]
    rows = {r["n"]: r for r in got.collect()}
    assert len(rows) == len(HARD)
    for i, t in enumerate(HARD):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want, t
        assert rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert rows[i]["text"] == t and rows[i]["row"] == 7 and rows[i]["word"] == "w"


def test_whole_table(spark, library):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in wordbpe.op11_word_bpe(spark, SF).collect()}
    assert len(rows) == len(texts)
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [rows[doc]["n_tokens"], rows[doc]["ids_sha256"], rows[doc]["decoded_sha256"]] == [len(ids), *sha]


def test_words_are_encoded_once(spark):
    df = spark.createDataFrame([("Ab ab, ab",), ("ab",), (None,)], "text string")
    got = {r["word"]: r["n"] for r in wordbpe.word_table(df).collect()}
    assert got == {"ab": 4, ",": 1}


def test_empty_table_and_strange_ids(spark):
    df = spark.createDataFrame([], "text string, a int")
    assert wordbpe.decode(wordbpe.encode(df)).collect() == []
    ids = spark.createDataFrame([([320, -1, None, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in wordbpe.decode(ids).collect()] == ["a</w>", "", ""]
    lone = wordbpe.encode(spark.createDataFrame([("a b",)], "text string"), carry=[])
    assert lone.columns == ["ids"] and lone.select(F.size("ids")).first()[0] == 2
