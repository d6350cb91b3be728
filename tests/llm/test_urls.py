"""Hosts, paths and rules against plain Python; the model on held-back URLs and on one label."""

from pyspark.sql import functions as F

from boardwalk.llm import urls

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/A?x#y", "https://example.com/en/", "http://example.com/en", "http://badexample.com/en/x",
    "http://a.b.net/es/1", "http://net/fr/", "ftp://x.com?q=/en/", "x://y://z/es/", "http://EXÄMPLE.net/es/é", "//example.com/en/", "http://x.net/es\n/", "http://x.org#a",
]


def plain(url, rules=urls.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in rules:
        name, rest = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == name or host.endswith("." + name)) and path.startswith(rest) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def agree(rows, rules=urls.RULES):
    for r in rows:
        host, path, rule, verdict = plain(r["url"], rules)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_whole_table_and_odd_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-i, u) for i, u in enumerate(ODD)] * 2, "page_id long, url string")
    both = pages.unionByName(odd)
    got = urls.judge(both).collect()
    assert len(got) == pages.count() + 2 * len(ODD)
    agree(got)
    ruled = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.op7_url_filter(spark, SF).collect()}
    assert ruled == {p: plain(u)[:3] for p, u in pages.collect()}


def test_longest_rule_wins_and_ties_go_to_the_later_text(spark):
    rules = [("block", "a.com/"), ("allow", "a.com/x/"), ("block", "x.a.com/"), ("allow", "b.a.com/"), ("block", "com/xy/")]
    df = spark.createDataFrame([(u,) for u in ("http://x.a.com/x/1", "http://b.a.com/x/", "http://a.com/xy/", "http://c.com/xy/z")], "url string")
    got = urls.judge(df, rules=rules).collect()
    agree(got, rules)
    assert got[0]["rule"] == max("a.com/x/", "x.a.com/")


def test_model_on_held_back_urls(spark):
    rows = [(f"http://{'spam' if i % 2 else 'news'}{i}.org/{'casino' if i % 2 else 'story'}/{i * 7}", i % 2 == 1) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, block boolean")
    got = urls.judge(df.where(F.col("block").isNotNull()).drop("block").limit(400), labelled=df.limit(200)).collect()
    truth = dict(rows)
    assert sum((r["verdict"] == "block") == truth[r["url"]] for r in got) >= 0.95 * len(got)


def test_one_label_no_label_and_no_rows(spark):
    df = spark.createDataFrame([("http://q.org/a",), (None,)], "url string")
    one = spark.createDataFrame([("http://z.org/", True), ("http://y.org/", True)], "url string, block boolean")
    assert {r["verdict"] for r in urls.judge(df, labelled=one).collect()} == {"block"}
    assert {r["block_probability"] for r in urls.judge(df, labelled=one.limit(0)).collect()} == {0.5}
    assert urls.judge(df.limit(0)).collect() == []


def test_columns_of_any_name_pass(spark):
    names = ["_grams", "_hashed", "_probability", "_raw", "_prediction", "_rule", "_host", "label", "Verdict"]
    rows = [(u, *names) for u in ("http://a.net/es/x", "http://b.com/x", "http://c.org/y", None)]
    got = urls.judge(spark.createDataFrame(rows, "link string, " + ", ".join(f"{n} string" for n in names)), url="link").collect()
    assert len(got) == 4 and all([r[n] for n in names[:-1]] == names[:-1] and r["verdict"] in ("allow", "block") for r in got)
