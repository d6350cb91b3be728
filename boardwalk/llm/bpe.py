"""Byte-level BPE: encoding to ids with offsets, and decoding back to the bytes.

The vocabulary file is a parameter and must be readable on every executor.  Tasks work on Arrow
batches.  Texts are cut at single spaces into units; what the pattern matches never runs across such
a cut (``_ODD`` tells the texts that have other spaces, they are one unit).  Each distinct unit of a
batch is cut by the pattern and encoded by the ``tokenizers`` library, every piece on its own; ids of
texts are then taken from those of units without a Python step for each word.  Bytes are taken from
the table of ids the same way.  Units stay whole however long they are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.llm.common import ship
from boardwalk.llm.registry import register, table

#: Remembered units of a worker; a full memory is emptied, which changes no result.
REMEMBERED = 250_000

# Fixed value: white space as Unicode's White_Space has it.
_SPACE = r"\t-\r\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A space with white space after it, or after white space at the end: here the pattern looks beyond a unit.
_ODD = rf" [{_SPACE}]|[{_SPACE}] \z"


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, more = [], 0x100
    for b in range(256):
        letters.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return letters


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _pattern():
    import public_tokenizers
    import regex

    # \s as the vocabulary's own library reads it
    space = re.sub(r"\\x\{(\w+)\}", r"\\u\1", _SPACE)
    text = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{space}")
    return regex.compile(text.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


class Coder:
    """Encoder of one vocabulary; units met before are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.units, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def _learn(self, units: pa.Array) -> None:
        """Encode units and remember them."""
        cut = [_pattern().findall(u) for u in units.to_pylist()]
        pieces = pa.array([p for c in cut for p in c], pa.string()).dictionary_encode()
        got = []
        for start in range(0, len(pieces.dictionary), 4096):  # the library's results are large, so few at a time
            some = self.tokenizer.encode_batch_fast(pieces.dictionary[start : start + 4096].to_pylist(), add_special_tokens=False)
            got.append(pa.array([g.ids for g in some], pa.list_(pa.int32())))
        ids = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *got]).take(pieces.indices)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
        self.units = pa.concat_arrays([self.units, units])
        self.ids = pa.concat_arrays([self.ids, _joined(ids, ends)])

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text; a null has none."""
        texts = texts.fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(texts, " ")
        if odd.any():
            parts = pa.ListArray.from_arrays(*_instead(parts, texts, odd))
        ends = np.asarray(parts.offsets)
        coded = parts.flatten().dictionary_encode()
        first = np.zeros(len(coded), np.int64)
        first[ends[:-1]] = 1
        code, at = np.unique(np.asarray(coded.indices, np.int64) * 2 + first, return_inverse=True)
        words = coded.dictionary.take(pa.array(code // 2))
        units = pc.if_else(pa.array(code % 2 == 1), words, pc.binary_join_element_wise("", words, " "))
        new = units.filter(pc.is_null(pc.index_in(units, value_set=self.units)))
        if len(new) and len(new) + len(self.units) > REMEMBERED:
            self._forget()
            new = units
        if len(new):
            self._learn(new)
        known = self.ids.take(pc.index_in(units, value_set=self.units))
        return _joined(known.take(pa.array(at)), ends)

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit numbers."""
        return np.asarray(self.encode_all(pa.array([text], pa.string())).flatten()).tobytes()


def _joined(lists: pa.ListArray, ends: np.ndarray) -> pa.ListArray:
    """Lists joined to one list for each run of them that ``ends`` marks off."""
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(sizes[ends].astype(np.int32)), lists.flatten())


def _instead(parts: pa.ListArray, texts: pa.Array, odd: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of ``parts`` with an odd text whole in place of its parts."""
    sizes = np.diff(np.asarray(parts.offsets))
    number = np.repeat(np.arange(len(odd)), sizes)
    begin = np.asarray(parts.offsets)[:-1]
    values = pa.concat_arrays([parts.flatten(), texts])
    take = np.arange(len(number))
    take[begin[odd]] = len(number) + np.flatnonzero(odd)
    keep = ~odd[number]
    keep[begin[odd]] = True
    return pa.array(np.concatenate([[0], np.cumsum(np.where(odd, 1, sizes))]).astype(np.int32)), values.take(pa.array(take[keep]))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> pa.Array:
    """Bytes of each id: the letters of its token turned back, or a special token's own text."""
    back = {c: b for b, c in enumerate(byte_letters())}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
    return pa.array(out, pa.binary())


def _slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes (or list items) of the column each; a longer value stands alone."""
    length = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
    sizes = np.asarray(pc.fill_null(length(batch.column(column)), 0), np.int64)
    begin = np.cumsum(sizes) - sizes
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(begin // limit)) + 1):
        if len(part):
            yield batch.slice(int(part[0]), len(part))


def _starts(texts: pa.Array, ids: pa.ListArray, bytes_of: pa.Array) -> list[pa.ListArray]:
    """Where each id starts in its text, in bytes and in characters."""
    sizes = np.asarray(pc.binary_length(bytes_of), np.int64)[np.asarray(ids.flatten())]
    ends, at = np.asarray(ids.offsets), np.cumsum(sizes) - sizes  # in the texts one after the other
    lengths = np.asarray(pc.binary_length(texts), np.int64)
    begin = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)
    here = np.repeat(np.arange(len(texts)), np.diff(ends))
    before = np.concatenate([[0], chars])[begin]
    found = [at - begin[here], chars[at] - 1 - before[here] if len(at) else at]
    return [pa.ListArray.from_arrays(ids.offsets, pa.array(x.astype(np.int32))) for x in found]


def encode(
    df: DataFrame, text: str = "text", path: str | None = None, offsets: bool = True, carry: list[str] | None = None
) -> DataFrame:
    """Add ``ids``; with ``offsets`` also where each id starts, in bytes and in characters.

    ``byte_starts`` count UTF-8 bytes.  ``char_starts`` is the character that holds the id's first
    byte, so the ids of a character split among several share its number.  A null text counts as
    empty and has no ids.  Other columns (or those in ``carry``) pass unchanged; existing ones of
    these names are replaced.
    """
    path = path or vocabulary()
    ship(df.sparkSession)
    added = ["ids", *(["byte_starts", "char_starts"] if offsets else [])]
    kept = [c for c in (df.columns if carry is None else carry) if c not in added]
    out = df.select(*kept).schema
    for c in added:
        out = out.add(c, T.ArrayType(T.IntegerType()))

    def work(batches):
        own = coder(path)
        for whole in batches:
            for batch in _slices(whole, text):
                ids = own.encode_all(batch.column(text))
                columns = [*(batch.column(c) for c in kept), ids]
                if offsets:
                    columns += _starts(batch.column(text).fill_null(""), ids, byte_table(path))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *added])
        pa.default_memory_pool().release_unused()

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(work, out)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Replace ``ids`` by ``decoded``, the exact bytes; with ``keep_ids`` both stay.

    Ids may end within a character, so the result is binary; ``decode(decoded, 'UTF-8')`` gives
    the text of a whole sequence.  A null list gives empty bytes, a null in it none; an id outside the
    vocabulary fails.
    """
    path = path or vocabulary()
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != "decoded" and (keep_ids or c != ids)]
    out = df.select(*kept).schema.add("decoded", T.BinaryType())

    def work(batches):
        bytes_of = byte_table(path)
        for whole in batches:
            for batch in _slices(whole, ids, 1 << 20):
                lists = batch.column(ids)
                ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), dtype=np.int64)])
                got = bytes_of.take(lists.flatten()).fill_null(b"")
                starts = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1, got.offset * 4) if len(got) else np.zeros(1, np.int32)
                text = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(starts[ends].astype(np.int32)), got.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text], [*kept, "decoded"])

    return df.select(*dict.fromkeys([*kept, ids])).mapInArrow(work, out)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode and digest both: n_tokens, ids_sha256 and decoded_sha256 of every row."""
    carry = [c for c in df.columns if c != "text"]
    coded = encode(df, "text", path, offsets=False, carry=carry).withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        }
    )
    return decode(coded, "ids", path).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


@register("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
