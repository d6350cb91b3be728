"""Plans: what reaches the scan, and what one crawl produces."""

from datetime import datetime

from pyspark.sql import functions as F

from boardwalk.operators import facets, feed
from boardwalk.plans.enrich import crawl, stored_rows
from boardwalk.schemas import LANDED, POSTINGS, FeedQuery
from boardwalk.sources import landed, vendors



def now():
    return F.lit("2026-01-10 00:00:00").cast("timestamp_ntz")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def postings_file(spark, tmp_path):
    df = spark.range(200).selectExpr(
        "concat('k', id) as key", "'lever' as provider", "'b' as board_token", "'C' as company", "'T' as title",
        "'L' as location", "'US' as country", "'WA' as region", "'hybrid' as remote_type", "'senior' as seniority",
        "'x' as employment_type", "'d' as department", "1.0D as salary_min", "2.0D as salary_max", "'USD' as salary_currency",
        "timestamp_ntz'2026-01-09 00:00:00' as posted_at", "'u' as apply_url", "if(id % 2 = 0, 'cloud', 'data') as family",
        "false as adjacent", "cast(null as string) as sector", "cast(null as string) as specialization",
        "cast(null as string) as specialization_reason", "'v' as classification_version", "false as ai", "true as quiet",
        "array('Python') as matched_skills", "1 as skill_score", "0.1D as ghost_risk", "2.0D as salary_usd",
        "timestamp_ntz'2026-01-09 00:00:00' as first_seen_at", "timestamp_ntz'2026-01-09 00:00:00' as last_seen_at",
        "cast(null as timestamp_ntz) as closed_at",
    )
    path = str(tmp_path / "postings")
    df.write.parquet(path)
    return spark.read.schema(POSTINGS).parquet(path)


def test_filters_reach_the_scan_and_columns_are_pruned(spark, tmp_path):
    df = postings_file(spark, tmp_path)
    f = FeedQuery(now="2026-01-10 00:00:00", family="cloud")
    text = plan(feed.page(df, f).select("key", "posted_at"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    full = feed.page(df, f).select("key", "posted_at")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "IsNull(closed_at)" in full and "EqualTo(family,cloud)" in full
    assert "apply_url" not in full.split("ReadSchema")[1]


def test_facets_are_one_scan(spark, tmp_path):
    df = postings_file(spark, tmp_path)
    text = plan(facets.facets(df, FeedQuery(now="2026-01-10 00:00:00", family="cloud", country="US")))
    assert text.count("FileScan") == 1
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_snapshot_is_one_scan_per_reading(spark, tmp_path):
    df = postings_file(spark, tmp_path)
    shapes = facets.default_shapes(["cloud", "data"], ["US"])
    text = plan(facets.snapshot(df, shapes, "2026-01-10 00:00:00", 21))
    assert text.count("FileScan") == 1
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_facets_equal_filtered_counts(spark, tmp_path):
    df = postings_file(spark, tmp_path)
    f = FeedQuery(now="2026-01-10 00:00:00", family="cloud")
    by_family = {r["value"]: r["n"] for r in facets.facets(df, f).where("dim = 'family'").collect()}
    for family, n in by_family.items():
        same = FeedQuery(now="2026-01-10 00:00:00", family=family)
        assert feed.counts(df, same).first()["total"] == n


PAGE = (
    '{"jobs":[{"id":7,"title":"Senior DevOps Engineer","first_published":"2026-01-08T00:00:00Z",'
    '"location":{"name":"Seattle, WA"},"content":"&lt;p&gt;Run Kubernetes, Terraform and AWS. '
    'The salary range is $150,000 - $190,000.&lt;/p&gt;","absolute_url":"https://x/7"},'
    '{"id":8,"title":"Registered Nurse","location":{"name":"Boston"}},'
    '{"id":9,"title":"Old DevOps Engineer","first_published":"2025-01-01T00:00:00Z"}]}'
)


def test_crawl_end_to_end(spark):
    pages = spark.createDataFrame([("greenhouse", "acme", {}, 1, PAGE)], LANDED)
    companies = spark.createDataFrame([("greenhouse", "acme", "Acme")], "provider string, board_token string, company string")
    out = crawl(pages, companies, None, now(), ["greenhouse", "workday", "personio"]).cache()
    assert out.count() == 2  # the old posting is outside the window
    stored = stored_rows(out)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in stored.schema] == POSTINGS.split(", ")
    row = stored.first()
    assert row["key"] == "greenhouse:acme:7" and row["company"] == "Acme"
    assert (row["family"], row["specialization"]) == ("cloud", "devops_sre")
    assert (row["country"], row["region"], row["remote_type"]) == ("US", "WA", "on_site")
    assert (row["salary_min"], row["salary_max"], row["salary_usd"]) == (150000.0, 190000.0, 190000.0)
    assert row["seniority"] == "senior" and "Kubernetes" in row["matched_skills"]
    nurse = out.where("title = 'Registered Nurse'").first()
    assert (nurse["family"], nurse["excluded_reason"]) == (None, "clinical")


def test_landed_files_and_snapshot(spark, tmp_path):
    pages = spark.createDataFrame([("greenhouse", "acme", {"site": "s"}, 1, PAGE)], LANDED)
    pages.write.json(str(tmp_path / "in"))
    read = landed.read_landed(spark, str(tmp_path / "in"))
    rows = vendors.read_all(read, now())
    assert rows.count() == 3
    landed.write_snapshot(rows.select("external_id", "title"), str(tmp_path / "snap"), "json")
    again = landed.read_snapshot(spark, str(tmp_path / "snap"), "external_id string, title string", "json")
    assert sorted(r["external_id"] for r in again.collect()) == ["7", "8", "9"]


def test_workday_needs_a_site(spark):
    body = '{"jobPostings":[{"title":"A","postedOn":"Posted Today"}]}'
    rows = [("workday", "t", {"site": "Ext"}, 1, body), ("workday", "u", {}, 1, body)]
    out = vendors.workday(spark.createDataFrame(rows, LANDED), now())
    assert [(r["board_token"], r["posted_at"]) for r in out.collect()] == [("t", datetime(2026, 1, 10))]


def test_csv_company_lists(spark, tmp_path):
    from boardwalk.sources.discovery import dataset_boards, read_company_csv

    (tmp_path / "h.csv").write_text('name,slug,url\n"Acme, Inc.",acme,\n,,https://jobs.lever.co/beta\n')
    got = dataset_boards(read_company_csv(spark, str(tmp_path / "h.csv")), "lever")
    assert sorted(tuple(r) for r in got.select("token", "company").collect()) == [("acme", "Acme, Inc."), ("beta", "Beta")]
    (tmp_path / "n.csv").write_text('"Say ""Hi""",https://jobs.lever.co/hi\n')
    bare = read_company_csv(spark, str(tmp_path / "n.csv"), header=False)
    assert bare.first()["name"] == 'Say "Hi"'
