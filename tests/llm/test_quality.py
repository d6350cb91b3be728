"""Quality rules against a plain Python count."""

import re
from collections import Counter

import duckdb
import pytest

from boardwalk.llm import quality

PROSE = "A plain sentence of some length stands here, and it ends well."


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x\x0by\x0cz\r\nx", "x y\n\nx y\n x y",
    "😀 😀 é # <b> | 漢字 漢字 漢字", " ".join(f"w{i % 7}" for i in range(300)), " ".join(f"w{i}" for i in range(30000)),
    " ".join(f"w{i % 14999}" for i in range(30000)), "\n".join([PROSE] * 12),
]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, extra string")
    got = quality.judge(df).collect()
    assert len(got) == len(rows) and "extra" in got[0]
    for r in got:
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert have == brute(r.text), r.doc_id


@pytest.mark.parametrize(
    "line",
    ["HOME!! NOW!! GO!!", "a%%% b$$$ c&&&", "Home | News | Sport | Shop", "We use cookies here.", "Copyright, all rights reserved."],
)
def test_bad_lines_go_and_documents_of_them_too(spark, line):
    good = "\n".join(" ".join(f"word{k}x{j}" for j in range(11)) + "." for k in range(6))
    rows = [(1, f"{good}\n{line}"), (2, "\n".join(f"{line} v{k} u{k * 3}!! t{k}!!" for k in range(20)))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].cleaned == good
    assert not got[2].kept


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_clean_lines_may_mention_page_furniture(spark):
    phrases = [
        "all rights reserved", "we use cookies", "accept all cookies", "privacy policy", "terms of service", "terms of use",
        "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "click here to", "lorem ipsum",
    ]
    prose = " ".join(f"word{j}" for j in range(500))
    rows = [(i, f"{prose} {p} {prose[::-1]}") for i, p in enumerate(phrases)]
    rows += [(100 + i, f"{prose}\n{p} now") for i, p in enumerate(phrases)]  # alone in a line it goes
    for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.kept and (r.lost_words, r.cleaned) == ((0, r.text) if r.doc_id < 100 else (r.n_words - 500, prose)), r.doc_id


def test_sql_states_the_rules_of_the_code(spark):
    long = " ".join(f"word{j}" for j in range(151))
    lines = [
        "privacy policy", "see our privacy policy", "read the privacy policy now", f"{long} privacy policy", "click here to click here to go",
        "Home | News | Sport | Shop", "HOME!! NOW!! GO!!", "a | b", "we use cookies; all rights reserved", "no words of that kind here",
    ]
    good = " ".join(f"plain{j}" for j in range(60))
    rows = [(i, "\n".join([good] + [f"{line} " for line in lines[i % 10 :]] * (1 + i // 10))) for i in range(40)]
    rows += [(100 + i, line) for i, line in enumerate(lines)] + [(200, None), (201, "")]
    rows += [(300 + i, f"{good}\n" + "\n".join(f"{line} {k}" for k in range(9))) for i, line in enumerate(lines)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(f"select {', '.join(columns)} from ({quality.sql()}) order by doc_id").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got) == want
    assert {r.doc_id for r in got if r.kept} >= {103} and any(not r.kept for r in got if r.doc_id >= 300)


def test_columns_of_any_name_pass(spark):
    names = ["_words", "_lines", "_again", "_caller0", "n words.x", "KEPT"]
    df = spark.createDataFrame([(1, "a b", *names)], ["doc_id", "text", *names])
    row = quality.judge(df).first().asDict()
    assert [row[c] for c in names[:-1]] == names[:-1] and row["kept"] is False and "KEPT" not in row
