"""BPE with word ends, by a table of distinct words; decoding by the pieces of the ids.

Tasks cut texts into words, Spark counts them, and each distinct word is encoded once, by the
``tokenizers`` library.  Its ids then go back to every place where the word stands:

* The most frequent words, ``Table.head`` of them at most and none longer than ``Table.longest``
  bytes, are sent to all tasks.  Their number does not grow with the corpus.
* All other words are joined: each document asks for the ones that it needs, the answers are
  gathered by document, and documents, packed as numbers of frequent words and a list of the others,
  meet them by a hash of the text.

A word is what the library encodes by itself, whatever stands around it: a run between ASCII white
space, or its letters, digits and punctuation apart where it has nothing but ASCII and plain
accented letters, which neither normalisation nor lower-casing changes in number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.llm.bpe import vocabulary
from boardwalk.llm.common import Scratch, ship
from boardwalk.llm.registry import register, table

VOCABULARY = "word_bpe_49k.json"

# Letters that are one code point in every form and have one lower-case letter among themselves.
_LETTERS = "À-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[!-~{_LETTERS}]*")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[a-z{_LETTERS}]+|[0-9]|[^0-9a-z{_LETTERS}]+")


@dataclass(frozen=True)
class Table:
    """Words sent to all tasks: how many at most, and of how many bytes; changes no result."""

    head: int = 1 << 19  # below 2 ** 24
    longest: int = 32


def words_of(run: str) -> list[str]:
    """Words of a run without white space; encoded one by one they give the ids of the run."""
    if "<|" in run or not _PLAIN.fullmatch(run):
        return [run]
    return _PARTS.findall(run.lower())


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """Piece of each id, null for ids without one."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [None] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return pa.array(out, pa.string())


def _slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of the column each; a longer value stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    begin = np.cumsum(sizes) - sizes
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(begin // limit)) + 1):
        if len(part):
            yield batch.slice(int(part[0]), len(part))


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


class _Split:
    """Texts as places of distinct words: ``runs`` index the distinct runs, whose words lie one after the other."""

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = cut.flatten().dictionary_encode()
        self.ends = np.asarray(cut.offsets)
        self.runs = np.asarray(coded.indices)
        parts = [words_of(run) for run in coded.dictionary.to_pylist()]
        self.run_ends = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        self.words = pa.array([w for p in parts for w in p], pa.string())


def _counted(texts: pa.Array) -> pa.RecordBatch:
    """(word, n): how often each word stands in the texts."""
    s = _Split(texts)
    of_run = np.bincount(s.runs, minlength=len(s.run_ends) - 1)
    n = np.repeat(of_run, np.diff(s.run_ends))
    return pa.RecordBatch.from_arrays([s.words, pa.array(n, pa.int64())], ["word", "n"])


class _Known:
    """Words with their ids, the most frequent first."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        self.words, self.ids = words, ids

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The words of all texts: number among the known words or among the others, where texts end, and the others.

        Others are numbered from ``len(self.words)`` on.
        """
        s = _Split(texts)
        number = np.asarray(pc.fill_null(pc.index_in(s.words, value_set=self.words), -1)).copy()
        other = np.flatnonzero(number < 0)
        number[other] = len(self.words) + np.arange(len(other))
        of_run = _lists(s.run_ends, pa.array(number, pa.int32())).take(pa.array(s.runs))
        ends = np.concatenate([[0], np.cumsum(np.diff(s.run_ends)[s.runs], dtype=np.int64)])[s.ends]
        return np.asarray(of_run.flatten()), ends, s.words.take(pa.array(other))

    def listed(self, number: np.ndarray, ends: np.ndarray, more: pa.ListArray | None = None) -> pa.ListArray:
        """Ids of texts from the numbers of their words; those of other words come from ``more``."""
        ids = (self.ids if more is None else pa.concat_arrays([self.ids, more])).take(pa.array(number))
        sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)), dtype=np.int64)])
        return _lists(sizes[ends], ids.flatten())


def _packed(number: np.ndarray, codec: pa.Codec) -> bytes:
    """Numbers below 2 ** 24 byte by byte: all low bytes, then the higher ones, which repeat more."""
    return codec.compress(number.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), asbytes=True)


def _unpacked(packed: pa.Buffer, size: int, codec: pa.Codec) -> np.ndarray:
    low, mid, high = np.frombuffer(codec.decompress(packed, 3 * size, asbytes=True), np.uint8).reshape(3, size).astype(np.int32)
    return low | mid << 8 | high << 16


def word_table(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n, ids) of every distinct word of the texts: how often it stands, and its ids."""
    path = path or vocabulary(VOCABULARY)
    ship(df.sparkSession)

    def count(batches):
        for whole in batches:
            for batch in _slices(whole, text):
                yield _counted(batch.column(text))
        pa.default_memory_pool().release_unused()

    def encode_words(batches):
        own = _tokenizer(path)  # not kept: workers also hold words and texts
        for batch in batches:
            got = own.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)
            ids = pa.array([g.ids for g in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], ["word", "n", "ids"])

    counted = df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode_words, "word string, n long, ids array<int>")


def _least(words: DataFrame, spec: Table) -> int:
    """The smallest count from which on at most ``spec.head`` words are as frequent or more so."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64).cast("long") + 1024)
    steps = words.where(F.octet_length("word") <= spec.longest).groupBy(step.alias("step")).agg(
        F.count("*").alias("words"), F.min("n").alias("n")
    )
    total, least = 0, 1 << 62
    for row in steps.orderBy(F.desc("step")).collect():  # some thousand steps at most
        total += row["words"]
        if total > spec.head:
            break
        least = row["n"]
    return least


def encode(
    df: DataFrame, text: str = "text", path: str | None = None, carry: list[str] | None = None, spec: Table = Table()
) -> DataFrame:
    """Add ``ids``, those that the library gives for the whole text without special tokens around it.

    A null or empty text has none.  Special tokens that a text spells out become their ids, as in
    the library.  Other columns (or those in ``carry``) pass unchanged, whatever their names, but for
    an existing ``ids``, which is replaced.  Repeated rows stay; an empty table gives an empty table.
    """
    path = path or vocabulary(VOCABULARY)
    spark = df.sparkSession
    scratch = Scratch(spark, "wordbpe")
    words = scratch.save(word_table(df, text, path), "words")
    frequent = (F.col("n") >= _least(words, spec)) & (F.octet_length("word") <= spec.longest)
    head = words.where(frequent).orderBy(F.desc("n"), "word").select("word", "ids").toArrow().combine_chunks()  # spec.head rows at most
    known = spark.sparkContext.broadcast(
        _Known(pa.array(head.column("word").to_pylist(), pa.string()), pa.array(head.column("ids").to_pylist(), pa.list_(pa.int32())))
    )
    kept = [c for c in (df.columns if carry is None else carry) if c != "ids"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    docs = df.select(row.alias("row"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    out = docs.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))

    def from_head(batches):
        for whole in batches:
            for batch in _slices(whole, "text"):
                number, ends, other = known.value.places(batch.column("text"))
                if len(other):
                    raise ValueError(f"no ids for the word {other[0]}")
                yield pa.RecordBatch.from_arrays([batch.column("row"), known.value.listed(number, ends)], ["row", "ids"])

    def ask(batches):
        for whole in batches:
            for batch in _slices(whole, "text"):
                number, ends, other = known.value.places(batch.column("text"))
                spots = np.flatnonzero(number >= len(known.value.words))
                text_of = np.searchsorted(ends, spots, side="right") - 1
                pairs = np.unique(text_of.astype(np.int64) << 32 | (number[spots] - len(known.value.words)))
                hashes, asked = batch.column("hash").take(pa.array(pairs >> 32)), other.take(pa.array(pairs & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([hashes, asked], ["hash", "word"])
        pa.default_memory_pool().release_unused()

    def pack(batches):
        codec = pa.Codec("zstd")
        for whole in batches:
            for batch in _slices(whole, "text"):
                number, ends, other = known.value.places(batch.column("text"))
                head = len(known.value.words)
                spots = np.flatnonzero(number >= head)
                rare = _lists(np.searchsorted(spots, ends), other.take(pa.array(number[spots] - head)))
                number = np.minimum(number, head)
                packed = [_packed(number[a:b], codec) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [batch.column("row"), batch.column("hash"), pa.array(packed, pa.binary()), pa.array(np.diff(ends), pa.int64()), rare]
                yield pa.RecordBatch.from_arrays(columns, ["row", "hash", "packed", "size", "rare"])
        pa.default_memory_pool().release_unused()

    def from_both(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            begin = np.cumsum(sizes) - sizes
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(begin >> 20)) + 1):
                if not len(part):
                    continue
                some = batch.slice(int(part[0]), len(part))
                number = [_unpacked(p.as_buffer(), n, codec) for p, n in zip(some.column("packed"), sizes[part].tolist(), strict=True)]
                number = np.concatenate(number)
                more, head = some.column("more").flatten(), len(known.value.words)
                at = pc.index_in(some.column("rare").flatten(), value_set=more.field("word"))
                if at.null_count:
                    raise ValueError("a word was not answered")
                number[number == head] = head + np.asarray(at)
                ids = known.value.listed(number, np.concatenate([[0], np.cumsum(sizes[part])]), more.field("ids"))
                yield pa.RecordBatch.from_arrays([some.column("row"), ids], ["row", "ids"])
        pa.default_memory_pool().release_unused()

    rare = words.where(~frequent).drop("n")
    if rare.limit(1).count():
        asked = docs.select("hash", "text").mapInArrow(ask, "hash long, word string")
        answers = asked.join(rare, "word").groupBy("hash").agg(F.collect_set(F.struct("word", "ids")).alias("more"))
        kind = docs.select("row", "hash").schema.add("packed", "binary").add("size", "long").add("rare", T.ArrayType(T.StringType()))
        packed = docs.mapInArrow(pack, kind)
        both = packed.join(answers, "hash", "left").select("row", "packed", "size", "rare", "more")
        coded = both.mapInArrow(from_both, out)
    else:
        coded = docs.mapInArrow(from_head, out)
    return coded.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "ids")


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Replace ``ids`` by ``decoded``, the pieces of the ids with a space between; with ``keep_ids`` both stay.

    That is the library's text with special tokens kept.  Each id meets its piece in the table of all
    pieces, which every task holds: the vocabulary bounds it.  Null ids give an empty text; an id
    without a piece and a null id are left out, as the library does.
    """
    path = path or vocabulary(VOCABULARY)
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != "decoded" and (keep_ids or c != ids)]
    out = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("decoded", T.StringType())

    def work(batches):
        pieces = _pieces(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lists = pc.fill_null(batch.column(ids), [])
                flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)])
                inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
                got = pieces.take(pc.if_else(inside, flat, None))
                there = np.asarray(got.is_valid().to_numpy(zero_copy_only=False))
                ends = np.concatenate([[0], np.cumsum(there, dtype=np.int64)])[ends]
                text = pc.binary_join(_lists(ends, got.drop_null()), " ")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text], [*kept, "decoded"])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, ids])]).mapInArrow(work, out)


@register("op11_word_bpe")
def op11_word_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, carry=["doc_id"]).withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        }
    )
    return decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
