"""Fill-in-middle rewriting: cuts found by rank queries on a wavelet matrix of character classes.

Every byte of a text has a class: the later bytes of a character, a line feed, a blank, the first
character of a word, or any other.  A wavelet matrix over the classes of many texts answers how
many bytes of a class stand before a place.  Units are sums of such ranks: characters are all classes
but the first, words the word beginnings, lines the line feeds.  The place of the k-th unit of a text
is found by bisection on these sums, for all texts of a batch at once.

Two cuts divide a text into prefix, middle and suffix.  Which cuts, and which form the text takes,
follows from a hash of the row's key, so reruns and other layouts give the same.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import ship
from boardwalk.llm.registry import register, table

# Classes of bytes, and the classes whose ranks add up to each unit's count.
LATER, OTHER, BLANK, FEED, BEGIN = range(5)
UNITS = {"chars": (OTHER, BLANK, FEED, BEGIN), "words": (BEGIN,), "lines": (FEED,)}
LEVELS = 3
MARKS = (b"<P>", b"<S>", b"<M>")


@dataclass(frozen=True)
class Plan:
    """Seed of the hashes, percent of texts left plain, percent of the rest in suffix-first form, and the unit of cuts."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    unit: str = "chars"


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of texts that lie one after the other and begin at ``starts``."""
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    fresh = np.concatenate([[True], blank[:-1]])[: len(raw)]
    fresh[starts[starts < len(raw)]] = True
    out = np.where(fresh, BEGIN, OTHER).astype(np.uint8)
    out[blank] = BLANK
    out[raw == 0x0A] = FEED
    out[(raw & 0xC0) == 0x80] = LATER
    return out


class Wavelet:
    """Wavelet matrix: for each bit of a symbol, highest first, a row of bits with counts before each 64."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.size, self.levels = len(symbols), []
        for level in reversed(range(levels)):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            packed[: (self.size + 7) // 8] = np.packbits(bits, bitorder="little")
            words = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((level, words, before, self.size - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for level, words, before, zeros in self.levels:
            low, high = (self._ones(words, before, x) for x in (low, high)) if symbol >> level & 1 else (
                x - self._ones(words, before, x) for x in (low, high)
            )
            if symbol >> level & 1:
                low, high = low + zeros, high + zeros
        return high - low

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(inside)

    def units(self, unit: str, at: np.ndarray) -> np.ndarray:
        """How many units begin before each place (for lines: end)."""
        return sum(self.rank(c, at) for c in UNITS[unit])

    def place(self, unit: str, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """End of the first k units from ``low`` on: where the next begins (for lines: after the feed), ``high`` at most."""
        base, low, end = self.units(unit, low), low.copy(), high.copy()
        if unit == "lines":  # the first place with k feeds before it
            goal, high = base + k, high.copy()
            while (open_ := low < high).any():
                mid = (low + high) // 2
                less = self.units(unit, mid) < goal
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
            return low
        goal, high = base + k + 1, high + 1  # the last place before unit k + 1 begins
        while (open_ := high - low > 1).any():
            mid = (low + high) // 2
            less = self.units(unit, np.minimum(mid, end)) < goal
            low, high = np.where(open_ & less, mid, low), np.where(open_ & ~less, mid, high)
        return np.minimum(low, end)


def hashes(key, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from ``seed:key``; a null key counts as empty."""
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(hexed[i : i + 8], 16) for i in range(0, 32, 8))


def shuffled(form: str, parts: tuple[bytes, bytes, bytes]) -> bytes:
    """The text in its form, from prefix, middle and suffix."""
    prefix, middle, suffix = parts
    p, s, m = MARKS
    if form == "psm":
        return p + prefix + s + suffix + m + middle
    return s + suffix + p + prefix + m + middle if form == "spm" else prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text that was rewritten; marks stand in no rewritten text, so they are found one by one."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _cut(keys: list, texts: list[bytes], plan: Plan) -> dict[str, list]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    matrix = Wavelet(classes(raw, ends[:-1]))
    low, high = ends[:-1], ends[1:]
    counts = {u: matrix.units(u, high) - matrix.units(u, low) for u in {"chars", plan.unit}}
    n = counts[plan.unit]
    drawn = np.array([hashes(k, plan.seed) for k in keys], np.int64).reshape(-1, 4)
    one, two = (drawn[:, i] % (n + 1) for i in (0, 1))
    first, second = (matrix.place(plan.unit, low, high, k) for k in (np.minimum(one, two), np.maximum(one, two)))
    out = {"n": n, "form": [], "prefix": [], "middle": [], "output": []}
    for i, text in enumerate(texts):
        plain = not text or drawn[i, 2] % 100 >= 100 - plan.plain or any(m in text for m in MARKS)
        form = "plain" if plain else "spm" if drawn[i, 3] % 100 < plan.spm else "psm"
        a, b = first[i] - low[i], second[i] - low[i]
        out["form"].append(form)
        out["output"].append(shuffled(form, (text[:a], text[a:b], text[b:])))
    at = [matrix.units("chars", x) for x in (low, first, second)]
    plain = np.array([f == "plain" for f in out["form"]], bool)
    out["prefix"], out["middle"] = (pa.array(x, pa.int64(), mask=plain) for x in (at[1] - at[0], at[2] - at[1]))
    return out


def rewrite(
    df: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan(), check: bool = False, carry: list[str] | None = None,
    digest: bool = False,
) -> DataFrame:
    """Add (n, form, prefix_chars, middle_chars, output): the text rewritten for filling in its middle.

    ``n`` counts the text's units.  ``form`` is plain for an empty text, for one that spells out a mark
    and for ``plan.plain`` percent of the others; their numbers of characters are null and the output is
    the text.  ``psm`` puts prefix, suffix, middle after their marks, ``spm`` suffix, prefix, middle.
    The cuts end after whole units; words carry the blanks after them, and what stands before the first.
    A null text counts as empty, a null key as an empty one; rows with equal key and text become equal.
    Other columns (or those in ``carry``) pass unchanged unless they have one of the added names.  With
    ``check`` the column ``restored`` holds the text rebuilt from output and form.  With ``digest`` both
    are replaced by their SHA-256 in lower-case hex, ``output_sha256`` and ``restored_sha256``.
    """
    ship(df.sparkSession)
    texts = ["output", *(["restored"] if check else [])]
    named = [f"{c}_sha256" if digest else c for c in texts]
    added = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", **dict.fromkeys(named, "string")}
    kept = [c for c in (df.columns if carry is None else carry) if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    docs = df.select(row.alias("row"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = docs.select("row").schema
    for name, kind in added.items():
        out = out.add(name, kind)

    def work(batches):
        for whole in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in whole.column("text")]
            begin = np.cumsum(sizes, dtype=np.int64) - sizes
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(begin // (4 << 20))) + 1):
                if not len(part):
                    continue
                batch = whole.slice(int(part[0]), len(part))
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")]
                got = _cut(batch.column("key").to_pylist(), raw, plan)
                long = {"output": got["output"]}
                if check:
                    long["restored"] = [restored(f, o) for f, o in zip(got["form"], got["output"], strict=True)]
                if digest:
                    long = {c: [hashlib.sha256(x).hexdigest() for x in v] for c, v in long.items()}
                columns = [pa.array(got["n"], pa.int64()), pa.array(got["form"], pa.string()), got["prefix"], got["middle"]]
                columns += [pa.array(v, pa.string()) for v in long.values()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *added])

    done = docs.mapInArrow(work, out)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *added)


SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || cast(doc_id as varchar)) as h from documents),
u as (select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
  cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


@register("op13_fill_in_middle", SQL)
def op13_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rewrite(docs, check=True, digest=True, carry=["doc_id"])
