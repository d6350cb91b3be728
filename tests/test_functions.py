"""Golden values of single functions."""

import pytest
from pyspark.sql import functions as F

from boardwalk.functions import dates, geo, labels, pay, slugs, text, urls
from boardwalk.functions.literals import required_literals
from boardwalk.sources import vendors


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("&amp;lt;p&amp;gt;Hi&amp;lt;/p&amp;gt;", "Hi"),
        ("C&lt;T&gt; is fine", "C<T> is fine"),
        ("<p>a<br>b</p><script>x()</script>c", "a\nb\n c"),
        ("caf&eacute; &#233; &#x1F600;", "café é \U0001F600"),
        ("<style>p{}</style>", None),
        ("a &unknown; b & c", "a &unknown; b & c"),
        (None, None),
    ],
)
def test_strip_html(spark, raw, want):
    assert one(spark, raw, text.strip_html) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("The salary range is $150,000 - $190,000 per year.", (150000, 190000, "USD")),
        ("Base pay between $62.50 and $75 per hour.", (130000, 156000, "USD")),
        ("We raised $50M. Compensation: 120k to 150k USD.", (120000, 150000, "USD")),
        ("Annual compensation of £70,000.", (70000, 70000, "GBP")),
        ("Pay: €4,500 to €6,000 per month", (54000, 72000, "EUR")),
        ("Our revenue is $10,000,000 a year.", None),
        ("Salary: $12 - $900,000. Salary $90,000.", None),
        ("401(k) match and $5,000 signing bonus", None),
        ("no figures at all", None),
        (None, None),
    ],
)
def test_salary(spark, raw, want):
    got = one(spark, raw, pay.salary_from_text)
    assert (None if got is None else tuple(got)) == want


def test_salary_window_reaches_back_to_the_sentence(spark):
    far = "Pay is good. " + "x" * 200 + " between 100,000 and 120,000 units"
    assert one(spark, far, pay.salary_from_text) is None


@pytest.mark.parametrize(
    "raw, country, state",
    [
        ("Seattle, WA", "US", "WA"),
        ("Washington, D.C.", "US", "DC"),
        ("US-DC-Washington", "US", "DC"),
        ("Washington, United Kingdom", "GB", None),
        ("Pune, IN", "IN", None),
        ("Albuquerque, New Mexico", "US", "NM"),
        ("Mexico City", "MX", None),
        ("New Mexico or Mexico", "MX", None),
        ("Vienna, Virginia, United States", "US", "VA"),
        ("Panamá City", None, None),
        ("Zürich", "CH", None),
        ("Tacoma", None, "WA"),
        ("Charleston, West Virginia", "US", "WV"),
        ("", None, None),
    ],
)
def test_places(spark, raw, country, state):
    row = spark.createDataFrame([(raw,)], "v string").select(
        geo.country("v").alias("c"), geo.us_state("v").alias("s")
    ).first()
    assert (row["c"], row["s"]) == (country, state)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A; B; C; D", "A, B +2 more"),
        ("7000 Target Pkwy N,NCD-0375 Brooklyn Park,MN 55445", "Brooklyn Park, MN"),
        ("Bengaluru, Karnataka 560103", "Bengaluru, Karnataka"),
        ("  ", None),
    ],
)
def test_clean_location(spark, raw, want):
    assert one(spark, raw, geo.clean_location) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Remote/Hybrid - Berlin", "hybrid"),
        ("fully remote; occasional hybrid meetups", "fully_remote"),
        ("no remote work", "on_site"),
        ("in-office", "on_site"),
        ("Berlin", None),
    ],
)
def test_remote(spark, raw, want):
    assert one(spark, raw, lambda c: labels.remote_type(None, c)) == want


def test_false_flag_is_final(spark):
    got = one(spark, "Remote", lambda c: labels.remote_type(None, c, flag=F.lit(False)))
    assert got is None


@pytest.mark.parametrize(
    "raw, want",
    [("Founded over 25 years ago", None), ("5+ years of experience", "senior"), ("at least 3 years", "mid"),
     ("8-10 years experience, minimum 2 years", "mid")],
)
def test_years(spark, raw, want):
    assert one(spark, raw, labels.seniority_from_text) == want


def test_slugs(spark):
    assert one(spark, "JPMorgan Chase", slugs.slug_candidates)[:3] == ["jpmc", "jpmorganchase", "chase"]
    assert one(spark, "Acme Technologies, Inc.", slugs.slug_candidates)[0] == "acmetechnologiesinc"


def test_resolve(spark):
    got = one(spark, "https://hccz.fa.em3.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/1", urls.resolve_url)
    assert (got["status"], got["provider"], got["token"], got["extra"]["site"]) == ("supported", "oracle", "hccz", "CX")


def test_dates(spark):
    assert str(one(spark, "January 5, 2026", dates.from_text)) == "2026-01-05 00:00:00"
    assert str(one(spark, "2026-08-24T00:00:00.000", dates.from_text)) == "2026-08-24 00:00:00"
    assert one(spark, "soon", dates.from_text) is None


@pytest.mark.parametrize(
    "title, want",
    [("Careers at Acme", "Acme"), ("Page not found", None), ("Acme Careers", "Acme"),
     ("Acme &amp; Co | Job Search", "Acme & Co"), ("Careers", None)],
)
def test_company_from_title(spark, title, want):
    assert one(spark, f"<html><title>{title}</title></html>", vendors.company_from_title) == want


def test_icims_company(spark):
    html = "<title>Job Listings | Job Listings at Acme Health</title>"
    assert one(spark, html, vendors.icims_company) == "Acme Health"
    assert one(spark, "Page 1 of 7", vendors.icims_page_count, "string") == 7


def test_literals_are_required():
    assert required_literals(r"\b(aws|amazon web services)\b") == ("amazon web services", "aws")
    assert required_literals(r"[a-z]{3}") is None
    assert required_literals(r"x?") is None
