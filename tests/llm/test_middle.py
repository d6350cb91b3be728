"""Fill-in-middle rewriting against plain slicing, and its wavelet matrix against counting."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardwalk.llm import middle
from boardwalk.llm.middle import Plan, Wavelet

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "\n", "é👍 ab\ncd  ef\n\n", "has <S> in it", "<", "x" * 40_000 + " ü\n" * 3000, "  lead and trail  ", "tie", "tie"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=400))
def test_ranks(symbols):
    own = Wavelet(np.array(symbols, np.uint8))
    at = np.arange(len(symbols) + 1)
    for c in range(5):
        assert own.rank(c, at).tolist() == [symbols[:i].count(c) for i in at]


def plain_cut(key, text, plan):
    """The same by slicing characters."""
    if plan.unit == "chars":
        ends = list(range(1, len(text) + 1))
    elif plan.unit == "words":
        begins = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        ends = [*begins[1:], len(text)] if begins else []
    else:
        ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    nothing = re.match(r"[\x20\x09-\x0D]*", text).end() if plan.unit == "words" else 0
    n, (h1, h2, h3, h4) = len(ends), middle.hashes(key, plan.seed)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else nothing for k in (a, b))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plan.plain
    form = "plain" if plain else "spm" if h4 % 100 < plan.spm else "psm"
    pre, mid, suf = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    return n, form, None if plain else len(pre), None if plain else len(mid), out, text


@pytest.mark.parametrize("plan", [Plan(), Plan(unit="words", plain=0, spm=50), Plan(unit="lines", seed=5, plain=0)], ids=lambda p: p.unit)
def test_against_slices(spark, plan):
    rows = [(k, t, "kept", 3) for k in (1, 2, 3, 4, None) for t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, key int")
    got = middle.rewrite(df, plan=plan, check=True)
    assert got.columns == ["doc_id", "text", "row", "key", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = got.collect()
    assert len(got) == len(rows) and {(r["row"], r["key"]) for r in got} == {("kept", 3)}
    for r in got:
        assert tuple(r)[4:] == plain_cut(r["doc_id"], r["text"] or "", plan)


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = middle.rewrite(spark.read.parquet(f"{SF}/documents.parquet"), check=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["restored"] == (texts[r["doc_id"]] or "")
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) == plain_cut(r["doc_id"], texts[r["doc_id"]] or "", Plan())


def test_empty_table(spark):
    assert middle.rewrite(spark.createDataFrame([], "doc_id long, text string"), check=True, digest=True).collect() == []
