"""Nothing is cut unless asked for; trees of any depth; pages behind a row."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardwalk.functions import geo, text
from boardwalk.operators import audit, feed
from boardwalk.schemas import FeedQuery
from boardwalk.sources import discovery, vendors


def one(spark, raw, fn):
    return spark.createDataFrame([(raw,)], "raw string").select(fn(F.col("raw"))).first()[0]


def test_long_values_stay_whole(spark):
    assert one(spark, "lever/a: " + "r" * 900, text.failure_reason) == "r" * 900
    assert one(spark, "lever/a: " + "r" * 900, lambda c: text.failure_reason(c, 300)) == "r" * 300
    assert one(spark, "Engineer " * 40, text.audit_title) == ("engineer " * 40).strip()
    assert one(spark, "Engineer " * 40, lambda c: text.audit_title(c, 10)) == "engineer e"
    place = "Llanfair " * 30
    assert one(spark, place, geo.clean_location) == place.strip()
    assert one(spark, place, lambda c: geo.clean_location(c, 8)) == "Llanfair"
    name = "Long Company " * 20
    assert one(spark, f"<title>Job listings at {name}</title>", vendors.icims_company) == name.strip()


def test_titles_that_differ_late_are_counted_apart(spark):
    head = "engineer " * 20
    rows = [(None, None, f"{head}{end}", "c", i) for i, end in enumerate(["one", "two", "two"])]
    df = spark.createDataFrame(rows, "family string, excluded_reason string, title string, company string, pos int")
    got = {r["title"][-3:]: r["n"] for r in audit.exclusion_tally(df, "pos").collect()}
    assert got == {"one": 1, "two": 2}


def test_long_icims_fields(spark):
    title, place, kind = "T" * 500, "Place " * 60, "Kind " * 90
    card = (
        f'<li class="iCIMS_JobCardItem"><a href="https://x.icims.com/jobs/12/a/job"><h3> {title} </h3></a>'
        f'<span class="field-label">Job Locations</span> <span class="v">{place}</span>'
        f'<dl><dt class="iCIMS_JobHeaderField">Category</dt><dd class="d">{kind}</dd></dl><div class="description">{"w " * 4000}</div></li>'
    )
    schema = "provider string, board_token string, extra map<string,string>, page int, body string"
    pages = spark.createDataFrame([("icims", "x", None, 1, f"<ul>{card}</ul>")], schema)
    row = vendors.icims(pages).first()
    assert row["title"] == title and row["location"].startswith(place.strip())
    assert place.strip() in row["location"]


def test_all_hiring_threads(spark):
    rows = [(i, "Ask HN: Who is hiring? (May)", 60, datetime(2020, 1, 1 + i % 28)) for i in range(60)] + [(99, "Ask HN: Who is hiring?", 3, None)]
    df = spark.createDataFrame(rows, "story_id int, title string, num_comments int, created_at timestamp")
    assert discovery.hiring_threads(df).count() == 60
    assert discovery.hiring_threads(df, limit=24).count() == 24


def test_nested_comments_to_any_depth(spark):
    item = {"text": "d14", "children": []}
    for i in reversed(range(14)):
        item = {"text": f"d{i}", "children": [item, {"text": f"leaf{i}"}]}
    rows = [("t", json.dumps(item)), ("empty", "{}"), ("none", None), ("junk", "no json"), ("null", '{"text": "n", "children": null}')]
    got = discovery.flatten_comments(spark.createDataFrame(rows, "thread string, body string")).collect()
    assert sorted((r["level"], r["text"]) for r in got if r["thread"] == "t") == sorted(
        [(i, f"d{i}") for i in range(15)] + [(i + 1, f"leaf{i}") for i in range(14)]
    )
    assert sorted((r["thread"], r["text"]) for r in got if r["thread"] != "t") == [("empty", None), ("junk", None), ("none", None), ("null", "n")]
    assert discovery.flatten_comments(spark.createDataFrame([], "thread string, body string")).collect() == []


def test_thread_tree(spark):
    rng = random.Random(2)
    parent = {i: i - 1 for i in range(1, 201)} | {0: None}  # a chain of 200 replies
    parent |= {1000: None, **{1000 + i: 1000 + rng.randrange(i) for i in range(1, 150)}}
    parent |= {3000 + i: 1000 for i in range(300)}  # one item that very many answer
    parent |= {5000: 77777, 5001: 5000}  # an unknown parent
    parent |= {6000: 6001, 6001: 6002, 6002: 6000, 6003: 6002, 6010: 6010}  # circles

    def walk(i):
        seen, depth = {i}, 0
        while parent[i] in parent and parent[i] is not None:
            i, depth = parent[i], depth + 1
            if i in seen:
                return None, None
            seen.add(i)
        return i, depth

    rows = [(i, p, "x", "mine") for i, p in parent.items()] + [(None, 0, "x", "mine"), (5, 4, "again", "mine")]
    df = spark.createDataFrame(rows, "id long, parent long, text string, _up string")
    got = discovery.thread_tree(df)
    assert got.columns == ["id", "parent", "text", "_up", "root", "depth"]
    got = got.collect()
    assert len(got) == len(rows) and {r["_up"] for r in got} == {"mine"}
    for r in got:
        assert (r["root"], r["depth"]) == (walk(r["id"]) if r["id"] is not None else (None, None))
    assert max(r["depth"] or 0 for r in got) == 200
    assert discovery.thread_tree(df.limit(0)).collect() == []


@pytest.mark.parametrize("sort", ["newest", "salary", "score", "fit"])
def test_every_page_behind_a_row_is_the_page_at_its_offset(spark, sort):
    from checks import fixtures as fx
    from checks.feed import postings

    sf = "/root/testdata/sf0.001"
    p = postings(spark, sf).withColumn("competition_score", F.when(F.col("ord") % 4 > 0, F.col("ord") % 5))
    p = p.withColumn("posted_at", F.when(F.col("ord") % 5 > 0, F.date_trunc("month", "posted_at").cast("timestamp_ntz")))
    p = spark.createDataFrame(p.collect(), p.schema)
    kw = {"now": fx.NOW, "max_age_days": 3000, "sort": sort, "limit": 150, "skills": ("Python", "AWS") if sort == "fit" else ()}
    f, after, n = FeedQuery(**kw), None, 0
    while True:
        rows = feed.page_after(p, f, after).collect()
        want = feed.page(p, FeedQuery(**kw, offset=n)).collect()
        assert [r["key"] for r in rows] == [r["key"] for r in want]
        if not rows:
            break
        after, n = (rows[-1]["sort_value"], rows[-1]["key"]), n + len(rows)
    assert n == feed.filtered(p, f).count() > 300
