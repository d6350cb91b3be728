"""Rules are worked out once for each distinct text, and rows get all of it back."""

from pyspark.sql import functions as F

from boardwalk.functions.steps import per_value
from boardwalk.operators import classify

ROWS = [("Data Engineer", "SQL and Spark"), ("Data Engineer", None), (None, "Workday"), (None, None), ("", ""), ("Nurse", "Linux")]


def test_work_is_done_once_for_each_value(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def size(text):
        seen.add(1)
        return None if text is None else len(text)

    df = spark.range(2000).selectExpr("id", "case id % 4 when 0 then 'a' when 1 then 'bb' when 2 then '' end as text")
    got = per_value(df, ["text"], lambda values: values.withColumn("n", size("text")))
    assert got.columns == ["id", "text", "n"]
    assert {(r.id, r.n) for r in got.collect()} == {(i, (1, 2, 0, None)[i % 4]) for i in range(2000)}
    assert seen.value <= 8


def test_verdicts_of_repeated_rows_are_those_of_single_rows(spark):
    df = spark.createDataFrame([(i, *ROWS[i % 6]) for i in range(60)], "id long, title string, description string")
    single = classify.verdicts(df).drop("title", "description")
    names = sorted(single.columns)
    assert sorted(classify.classify_postings(df).select(*names).collect(), key=str) == sorted(single.select(*names).collect(), key=str)


def test_pay_of_repeated_texts(spark):
    from boardwalk.functions import pay

    texts = ["The salary range is $150,000 - $190,000 per year.", None, "", "We bake bread."]
    df = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "id long, body string")
    got = {r.id: r.parsed_pay for r in pay.with_salary(df, "body").collect()}
    want = {r.id: r.p for r in df.select("id", pay.salary_from_text(F.col("body")).alias("p")).collect()}
    assert got == want and got[0].min == 150000
