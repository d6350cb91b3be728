"""Board names from landed pages, and which rows get their details."""

from pyspark.sql import functions as F

from boardwalk.operators import lifecycle
from boardwalk.plans.names import name_boards


def test_only_placeholders_are_renamed(spark):
    boards = spark.createDataFrame(
        [("oracle", "Acme", None), ("oracle", "beta", "Beta Holding"), ("icims", "gamma", "Gamma"), ("lever", "delta", ""), ("lever", "none", None),
         ("eightfold", "eps", "eps"), ("oracle", "code", None)],
        "provider string, token string, company string",
    )
    facet = '{"items":[{"organizationsFacet":[{"Name":"%s"}]}]}'
    pages = spark.createDataFrame(
        [("oracle", "ACME", 2, facet % "Second"), ("oracle", "acme", 1, facet % " Acme Ltd "), ("oracle", "beta", 1, facet % "Other"),
         ("icims", "gamma", 1, "<title>Careers - Job Listings at Gamma &amp; Sons</title>"), ("lever", "delta", 1, '{"company":{"name":"Delta"}}'),
         ("lever", "delta", 0, None), ("eightfold", "eps", 1, '{"branding":{"companyName":"Epsilon"}}'), ("oracle", "code", 1, facet % "300 - Unit")],
        "provider string, board_token string, page int, body string",
    )
    got = {r.token: r.company for r in name_boards(boards, pages).collect()}
    assert got == {
        "Acme": "Acme Ltd", "beta": "Beta Holding", "gamma": "Gamma & Sons", "delta": "", "none": None, "eps": "Epsilon", "code": None,
    }
    assert name_boards(boards, pages.limit(0)).count() == 7


def test_a_row_is_a_candidate_once(spark):
    rows = spark.createDataFrame(
        [("p", "b", "1", "data", "unsorted"), ("p", "b", "2", None, "unsorted"), ("p", "b", "3", None, "unsorted"), ("p", "b", "4", None, None),
         ("p", "c", "5", None, "unsorted")],
        "provider string, board_token string, external_id string, core_family string, family string",
    )
    ids = lambda cap: sorted(r.external_id for r in lifecycle.backfill_candidates(rows, [F.col("external_id")], cap).collect())
    assert ids(None) == ["1", "2", "3", "5"] and ids(1) == ["1", "2", "5"]
