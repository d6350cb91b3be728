"""Dictionaries as tables: every pattern against every text, by plain ``re``."""

import re

import pytest

from boardwalk.operators import classify, dictionary

PATTERNS = [
    r"\baws\b", r"\b(aws|amazon web services)\b", "kube", r"\bkube\w*\b", r"python[23]?\b", r"\b(foo|bar)(s|es)\b", r"c\+\+", r"\bc#",
    r"a|b", r"(foo|)", r"\d{4}", r".*", r"^data", r"data$", r"\bnode\.?js\b", r"go+gle", r"\bre?act\b", r"(?:big )?data", r"(big )+data",
    r"\b((data|ml) (engineer|scientist))\b", r"(?!x)spark", r"spark(?! sql)", r"(?<=apache )spark", r"\bsql server\b", r"[ck]loud", r"\bKuberNetes\b",
    r"a\\b", r"x{2}y", r"ab{0,2}c", r"\bmachine[- ]learning\b", r"((a(b|c)d|ef)g|hi)j", r"\s+etl\s+", r"\bü\b", "café", r"(?i)ETL", r"\bb\b",
    r"x_y", r"\w+ops\b", r"(dev|ml|data)-?ops", r"etl|elt|\d+ tb", r"\(aws\)", r"t[o\]]p", r"(data)?base", r"spark|(flink|beam)s?", r"\bBI\b|power ?bi",
]
TEXTS = [
    "AWS and Kubernetes", "amazon web services", "kube", "minikube kubectl", "python3 python", "foos bares foo", "C++ and C# and c", "", " ", None,
    "data", "big data", "bigdata base database", "node.js nodejs NodeJS", "gooogle ggle", "react rect ract", "data engineer", "ml scientist", "spark sql",
    "apache spark", "sql  server", "sql server", "cloud kloud", "a\\b", "xxy xy", "ac abc abbc abbbc", "machine learning machine-learning", "abdgj efgj hij acdgj",
    "an etl job", "ü", "café caf", "année 2024 ü", "x_y x y", "devops data-ops mlops ops", "12 tb elt", "(aws)", "t]p top", "flinks beam", "BI powerbi power bi",
    "1999", "b", "kubernetes" * 50, "·", "Kelvin K", "etl\nelt",
]


def plain(pattern, text):
    folded = "".join(c if ord(c) < 128 else "·" for c in text).lower()
    accented = any(ord(c) > 127 for c in pattern)
    return re.search(pattern[:-1] + r"\Z" if pattern.endswith("$") else pattern, folded, re.I if accented else re.I | re.A) is not None


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(f"f{i % 3}", p, f"n{i // 2}", i) for i, p in enumerate(PATTERNS)] + [("f0", None, "none", 9)]
    return spark.createDataFrame(rows, "family string, pattern string, canonical string, weight long")


def test_every_pattern_on_every_text(spark, rules):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string")
    got = {(r.id, r.pattern) for r in dictionary.matches(df, rules, "id", "body").collect()}
    want = {(i, p) for i, t in enumerate(TEXTS) if t is not None for p in PATTERNS if plain(p, t)}
    assert got == want


def test_patterns_read_against_every_text_are_few(spark, rules):
    words = spark.createDataFrame([(w, 1) for t in TEXTS if t for w in set(re.findall("[a-z0-9_]+", t.lower()))], "token string, n long")
    _, opened = dictionary.anchors(rules.where("pattern is not null").select("pattern").distinct(), words.groupBy("token").sum("n").toDF("token", "n"))
    opened = {r.pattern for r in opened.collect()}
    assert {"a|b", "(foo|)", r"\d{4}", ".*", r"x{2}y", "(?i)ETL"} <= opened and len(opened) < len(PATTERNS) / 2
    assert not opened & {
        r"\baws\b", r"\b(aws|amazon web services)\b", "kube", r"\bkube\w*\b", r"python[23]?\b", "^data", r"(?:big )?data", r"spark(?! sql)",
        r"\bsql server\b", r"[ck]loud", r"\bKuberNetes\b", r"\bmachine[- ]learning\b", r"\bb\b", "x_y", r"\w+ops\b", r"\bnode\.?js\b",
    }


def test_scores_of_shared_and_null_keys(spark, rules):
    rows = [(1, "aws"), (1, "amazon web services kube"), (None, "aws"), (None, "aws"), (2, None), (3, "nothing here")]
    df = spark.createDataFrame(rows, "id long, body string").selectExpr("*", "'x' as family", "'y' as pattern")
    got = {(r.id, r.family, r.score, r.skills) for r in classify.match_dictionary(df, rules, "id", "body").collect()}
    def want(texts):
        best = {}
        for i, p in enumerate(PATTERNS):
            if any(plain(p, t) for t in texts):
                best[f"f{i % 3}", f"n{i // 2}"] = max(i, best.get((f"f{i % 3}", f"n{i // 2}"), 0))
        families = {f for f, _ in best}
        return {(f, sum(w for (g, _), w in best.items() if g == f), sum(g == f for g, _ in best)) for f in families}
    for key, texts in {1: ["aws", "amazon web services kube"], None: ["aws"], 3: ["nothing here"]}.items():
        assert {(f, s, n) for k, f, s, n in got if k == key} == want(texts)
    assert not [g for g in got if g[0] == 2]


def test_empty_tables(spark, rules):
    none = spark.createDataFrame([], "id long, body string")
    assert dictionary.scores(none, rules, "id", "body").count() == 0
    some = spark.createDataFrame([(1, "aws")], "id long, body string")
    assert dictionary.scores(some, rules.limit(0), "id", "body").count() == 0


def test_no_rule_passes_through_the_driver(spark):
    rules = spark.range(50_000).selectExpr("'f' as family", r"concat('\\bw', id, '\\b') as pattern", "string(id) as canonical", "1 as weight")
    df = spark.range(200).selectExpr("id", "concat('w', id * 7, ' and w', id, ' x w', id + 49900) as body")
    got = {r.id: r.skills for r in classify.match_dictionary(df, rules, "id", "body").collect()}
    assert got == {i: len({x for x in (i * 7, i, i + 49900) if x < 50_000}) for i in range(200)}


def test_patterns_inside_one_word_are_settled_on_words(spark):
    """Texts are not read again for them, however many words hold the piece."""
    patterns = [r"\bkube\w*\b", r"\bkube\w*s\b", "kube", r"\bkube(s|ctl)?\b", r"kube\w* x", r"\bkub(?=e)"]
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    words = spark.createDataFrame([(w, 1) for w in ("kube", "kubes", "kubectl", "minikube", "x")], "token string, n long")
    found, _ = dictionary.anchors(table, words)
    got = {(r.pattern, r.token) for r in found.where("sure").collect()}
    assert got == {
        *((patterns[0], w) for w in ("kube", "kubes", "kubectl")), (patterns[1], "kubes"),
        *(("kube", w) for w in ("kube", "kubes", "kubectl", "minikube")), *((patterns[3], w) for w in ("kube", "kubes", "kubectl")),
    }
    assert {r.pattern for r in found.where("not sure").collect()} == {r"kube\w* x", r"\bkub(?=e)"}


def test_long_pieces_share_their_beginning(spark):
    table = spark.createDataFrame([(r"\binfrastructures?\b",), (r"\binfrastructural\w+\b",)], "pattern string")
    words = spark.createDataFrame([("infrastructure", 1), ("infrastructurally", 1), ("infrastr", 1)], "token string, n long")
    found, _ = dictionary.anchors(table, words)
    assert {(r.pattern, r.token, r.sure) for r in found.collect()} == {
        (r"\binfrastructures?\b", "infrastructure", True), (r"\binfrastructural\w+\b", "infrastructurally", True)
    }


def test_words_are_those_of_folded_texts(spark):
    from pyspark.sql import functions as F

    from boardwalk.functions.match import folded

    df = spark.createDataFrame([(t,) for t in [*TEXTS, "Kelvin İstanbul A–B a c A_1 a_1", "É1é"]], "body string")
    rows = df.select(F.sort_array(dictionary.tokens(folded(F.col("body")))), F.sort_array(dictionary._plain_tokens(F.col("body")))).collect()
    assert all(a == b for a, b in rows)
