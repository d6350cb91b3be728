"""Copies of sites among boards found by discovery."""

import pytest
from pyspark.sql import functions as F

from boardwalk.operators import registry

IDS = "tenant string, site string, id string"


def guard(spark, new, old, **kw):
    rows = lambda sites: spark.createDataFrame(
        [(t, s, None if i is None else str(i)) for (t, s), ids in sites.items() for i in ids], IDS
    )
    return {tuple(r) for r in registry.alias_guard(rows(new), rows(old), **kw).collect()}


@pytest.mark.parametrize(
    ("new", "old", "want"),
    [
        ({("eofh", "CX"): [1, 2]}, {("eofh", "CX_3001"): [2, 1]}, {("eofh", "CX", "CX_3001")}),
        ({("eofh", "Named"): [1, 2]}, {("EOFH", "CX"): [2, 1, 1]}, {("eofh", "Named", "CX")}),
        ({("emit", "CX_2001"): [1, 2]}, {("emit", "CX"): [1, 2, 3]}, set()),
        ({("newt", "CX"): [5, 6], ("newt", "CX_1"): [5, 6]}, {}, {("newt", "CX", "CX_1")}),
        ({("a", "CX"): [1], ("a", "S2"): [1], ("a", "S1"): [1]}, {}, {("a", "CX", "S1"), ("a", "S2", "S1")}),
        ({("a", "X"): [1], ("a", "Y"): [1]}, {("a", "Z"): [1], ("a", "CX"): [1]}, {("a", "X", "Z"), ("a", "Y", "Z")}),
        ({("a", "X"): [1]}, {("b", "Z"): [1]}, set()),
        ({("a", "X"): [None], ("a", "Y"): [None]}, {("a", "Z"): [None]}, set()),
        ({}, {("a", "X"): [1], ("a", "Y"): [1]}, set()),
        ({}, {}, set()),
    ],
)
def test_who_goes(spark, new, old, want):
    assert guard(spark, new, old) == want


def test_ids_are_compared_when_prints_agree(spark):
    new = spark.createDataFrame([("a", "X", "1")], IDS)
    old = spark.createDataFrame([("a", "Y", "2")], IDS)
    forged = registry.site_prints(new).withColumn("site", F.lit("Y"))
    assert registry.alias_guard(new, old, forged).count() == 0


def test_a_large_site_is_compared_without_lists(spark):
    old = spark.range(100_000).selectExpr("'a' as tenant", "'S' as site", "string(id) as id")
    new = old.withColumn("site", F.lit("CX")).unionByName(old.where("id <> '77'").withColumn("site", F.lit("T")))
    out = registry.alias_guard(new, old)
    assert [tuple(r) for r in out.collect()] == [("a", "CX", "S")]
    assert "collect_" not in out._jdf.queryExecution().toString()
