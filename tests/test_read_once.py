"""What landed pages and site lists come from is read once."""

from pyspark.sql import functions as F

from boardwalk.operators import registry
from boardwalk.sources import vendors


def counted(spark, df):
    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return made, df.mapInArrow(tell, df.schema)


def test_icims_cards_are_read_once_and_the_first_page_wins(spark):
    card = '<li class="iCIMS_JobCardItem"><a href="https://x.icims.com/jobs/{0}/a/job"><h3>T{0}</h3></a></li>'
    rows = [("icims", "b", {}, p, "".join(card.format(i) for i in ids)) for p, ids in ((1, (1, 2)), (2, (2, 3)), (3, (3,)))]
    rows.append(("icims", None, {}, 1, card.format(9)))
    made, pages = counted(spark, spark.createDataFrame(rows, "provider string, board_token string, extra map<string,string>, page int, body string"))
    got = sorted((r.external_id, r.title) for r in vendors.icims(pages).collect())
    assert got == [("1", "T1"), ("2", "T2"), ("3", "T3")]
    assert made.value == len(rows)


def test_site_ids_are_read_once(spark):
    ids = [("t1", s, str(i)) for s in ("S0", "S1", "S2") for i in range(4 if s == "S2" else 3)]
    made, site_ids = counted(spark, spark.createDataFrame(ids, "tenant string, site string, id string"))
    sites = site_ids.sparkSession.createDataFrame([("S0",), ("S1",), ("S2",)], "site string")
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    held = sites.where("site = 'S0'").select(
        F.lit("oracle").alias("provider"), F.lit("t1").alias("token"), F.lit("c").alias("company"), F.create_map(F.lit("site"), "site").alias("extra"),
        F.lit(True).alias("active"), F.lit("m").alias("source"), F.lit(None).cast("string").alias("domain"), F.lit(1).alias("job_count"),
        F.lit(0).alias("consecutive_failures"), F.lit(None).cast("string").alias("last_error"), now.alias("last_ok_at"),
        now.alias("last_crawled_at"), now.alias("verified_at"))
    found = sites.where("site <> 'S0'").select(
        F.lit("oracle").alias("provider"), F.lit("t1").alias("token"), F.lit("c").alias("company"), F.create_map(F.lit("site"), "site").alias("extra"),
        F.lit("live").alias("verdict"))
    refused = spark.sql("select 'lever' as provider, 'x' as token, 'spam' as reason")
    out = registry.store_discovered(held, found, site_ids, refused, F.col("token"), now)
    assert sorted(r.extra["site"] for r in out.collect()) == ["S0", "S2"]  # S1 lists what S0 lists
    assert made.value == len(ids)
