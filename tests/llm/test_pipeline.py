"""The pipeline, stage by stage, against plain Python; and that each planted case is caught."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as pipeline  # noqa: E402
import test_linedup  # noqa: E402
import test_mixing  # noqa: E402
import test_quality  # noqa: E402
import test_simjoin  # noqa: E402
from boardwalk.llm import bpe, quality  # noqa: E402

WORDS = r"[^\x20\x09-\x0D]+"
COUNT = lambda t: len(re.findall(WORDS, t or ""))


def clean(text):
    """(kept, cleaned) by a plain reading of the rules."""
    lines, lost, good = text.split("\n"), 0, []
    for x in lines:
        n = COUNT(x)
        separators = len(re.findall(quality.SEPARATOR_WORD, x))
        bad = len(re.findall(quality.PUNCTUATION_RUN, x)) > 0.2 * n or (separators >= 2 and separators > 0.25 * n) or re.search(quality.BOILERPLATE, x)
        lost += n if bad else 0
        good += [] if bad else [x]
    n_words, *_, base = test_quality.brute(text)
    return not base and lost <= 0.3 * n_words, "\n".join(good)


def plain(docs):
    docs = {k: (clean(t)[1], s) for k, (t, s) in docs.items() if clean(t)[0]}
    cut = test_linedup.brute([(k, t) for k, (t, _) in docs.items()], 50)
    left = {k: (cut[k, t], s) for k, (t, s) in docs.items()}
    docs = {k: v for k, v in left.items() if v[0] == docs[k][0] or COUNT(v[0])}
    groups = test_simjoin.brute([(k, t) for k, (t, _) in docs.items()], 5, 80)
    docs = {k: v for k, v in docs.items() if groups[k][1] == k}
    size = defaultdict(int)
    for t, s in docs.values():
        size[s] += COUNT(t)
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    goal = test_mixing.brute_targets(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out, before = Counter(), defaultdict(int)
    for k, (t, s) in sorted(docs.items(), key=lambda d: md5(f"mix-1:{d[0]}:{md5(d[1][0])}")):
        whole = min(2, int(goal[s] // size[s])) if size[s] else 0
        out[k] = whole + (before[s] + COUNT(t) / 2 < goal[s] - whole * size[s])
        before[s] += COUNT(t)
    coder, rows = bpe.coder(bpe.vocabulary()), Counter()
    for k, n in out.items():
        raw = docs[k][0].encode()
        rows[k, docs[k][1], len(coder.encode(docs[k][0])) // 4, hashlib.sha256(raw).hexdigest()] += n
    return +rows


def test_run_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.decoded_sha256) for r in got) == plain(docs)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_planted_cases_and_columns(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)) + "."
    passage, base = line(60), "\n".join(line(20) for _ in range(8))
    near = "\n".join(" ".join([*x.split()[:-1], f"new{i}."]) if i == 3 else x for i, x in enumerate(base.split("\n")))
    one = " ".join(base.split())  # one line, so that line dedup can't see it
    docs = {1: base, 2: base, 3: one, 4: near, 5: f"{line(30)}\n{passage}\n{line(30)}", 6: f"{line(40)}\n{passage}\n{line(40)}", 7: "!! ## " * 60, 8: None, 9: ""}
    docs |= {100 + i: "\n".join(line(25) for _ in range(4)) for i in range(20)}
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    held = []
    for _, stage in pipeline.STAGES[:4]:
        df = stage(spark, df, "").cache()
        assert df.columns == pipeline.COLUMNS
        held.append({r.doc_id: r.text for r in df.collect()})
    cleaned, cut, single, mixed = held
    assert {7, 8, 9}.isdisjoint(cleaned) and {*docs} - {7, 8, 9} == {*cleaned}
    assert 2 not in cut and passage in cut[5] and passage not in cut[6] and COUNT(cut[6]) == 80
    assert 1 in single and 3 not in single and {100 + i for i in range(20)} <= {*single}
    assert {*mixed} <= {*single}
    for _, stage in pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], df.schema), "")
        assert empty.count() == 0


def test_near_duplicates_are_decided_by_row(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(120))
    a, b, c = text(), text(), text()
    near = " ".join([*a.split()[:-1], "other"])
    rows = [
        (1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, c, "en", "z", 1), (7, c, "en", "t", 1), (7, c, "en", "t", 1),
        (None, near, "en", "s", 1), (None, b, "en", "s", 1), (8, None, "en", "s", 1), (8, None, "en", "s", 1), (9, "", "en", "s", 0), (3, near, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in pipeline.near_duplicates(spark, docs, "").collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted([rows[0], rows[2], rows[4], rows[8], rows[9], rows[10]], key=key)
    assert pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []
