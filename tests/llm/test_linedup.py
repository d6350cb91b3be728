"""Line dedup against all runs of all documents."""

import random
import re

from boardwalk.llm import linedup

SCHEMA = "doc_id long, text string, gone string, n_lines int, at int"


def brute(rows, least):
    docs, seen, gone = {}, {}, {}
    for k, t in sorted({(k, t) for k, t in rows if k is not None and t is not None}):
        lines = t.split("\n")
        docs[k, t] = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    hits = []
    for (k, t), full in docs.items():
        lines = t.split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) for i in full]
        for a in range(len(full)):
            for b in range(a, len(full)):
                if sum(words[a : b + 1]) >= least:
                    run = tuple(lines[i] for i in full[a : b + 1])
                    if run in seen:
                        hits.append(((k, t), full[a : b + 1]))
                    else:
                        seen[run] = (k, a)
    for d, part in hits:
        gone.setdefault(d, set()).update(part)
    return {(k, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((k, t), ())) for k, t in docs}


def planted(seed=2):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 5, 12, 30]))) for _ in range(40)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            lines += rng.choice(runs) if rng.random() < 0.5 else [rng.choice(pool), "", f"own {i} {rng.random()}"]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, "\n".join(["a b"] * 60)), (204, "word " * 4000), (205, "word " * 4000)]
    return rows + [(None, rows[3][1]), (None, rows[3][1]), rows[5], rows[5]]


def test_against_all_runs(spark):
    rows = planted()
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA).repartition(3)
    for least in (1, 10, 50):
        got = linedup.dedup(df, min_words=least).collect()
        want = brute(rows, least)
        assert len(got) == len(rows) and got[0].gone == "x"
        texts = dict(rows)
        for r in got:
            assert r.text == (want[r.doc_id, texts[r.doc_id]] if r.doc_id is not None and texts[r.doc_id] is not None else texts.get(r.doc_id, rows[3][1]))
            if r.text is not None and r.doc_id is not None:
                assert r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.n_lines != r.n_removed else 0)


def test_nothing_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    assert sorted(r.text for r in linedup.dedup(df).collect()) == ["a\nb", "c"]
    assert linedup.dedup(df.where("false")).count() == 0
