"""Users: marks, profiles, the admin roll-up and years of experience."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_marks(marks: DataFrame, order: Column) -> DataFrame:
    """One row per (user, posting): the last mark wins, and may clear ``applied``."""
    return marks.groupBy("user_id", "job_key").agg(
        F.max_by(F.struct("seen", "applied", "at"), order).alias("_mark")
    ).select("user_id", "job_key", "_mark.seen", "_mark.applied", "_mark.at")


def merge_marks(table: DataFrame, marks: DataFrame, order: Column) -> DataFrame:
    """Upsert marks: an incoming mark replaces the stored one."""
    new = latest_marks(marks, order)
    kept = table.join(new, ["user_id", "job_key"], "left_anti")
    return kept.select(*new.columns).unionByName(new)


def merge_profiles(table: DataFrame, profiles: DataFrame) -> DataFrame:
    """Upsert profiles by user; the newest ``updated_at`` of a batch wins."""
    rest = [c for c in table.columns if c != "user_id"]
    new = profiles.groupBy("user_id").agg(F.max_by(F.struct(*rest), "updated_at").alias("_profile"))
    kept = table.join(new, "user_id", "left_anti")
    return kept.unionByName(new.select("user_id", "_profile.*").select(*table.columns))


def user_tally(marks: DataFrame) -> DataFrame:
    return marks.groupBy("user_id").agg(
        F.count_if("applied").alias("applied"), F.count_if("seen").alias("seen")
    )


def admin_rollup(seats: DataFrame, profiles: DataFrame, marks: DataFrame) -> DataFrame:
    """Seat, profile and mark counts per user, most applications first."""
    keyed = seats.withColumn("_key", F.concat(F.lit("u:"), "user_id"))
    states = profiles.select(
        F.col("user_id").alias("_key"), "first_name", "last_name",
        F.size("skills").alias("_skills"), "resume_chars", "updated_at",
    )
    tally = user_tally(marks).withColumnRenamed("user_id", "_key")
    return (
        keyed.join(states, "_key", "left")
        .join(tally, "_key", "left")
        .select(
            "email", "first_name", "last_name",
            F.coalesce("applied", F.lit(0)).alias("applied"),
            F.coalesce("seen", F.lit(0)).alias("seen"),
            F.greatest(F.coalesce("_skills", F.lit(0)), F.lit(0)).alias("skills"),
            F.coalesce("resume_chars", F.lit(0)).alias("resume_chars"),
            F.col("updated_at").alias("last_active"),
            F.col("created_at").alias("joined"),
        )
        .orderBy(F.col("applied").desc(), "email")
    )


def experience(spans: DataFrame, person: str, start: str, end: str) -> DataFrame:
    """(person, months, years, from_month): overlapping spans counted once.

    Months are whole numbers, so the union of the spans is the number of distinct
    months they cover.  Spans with the same start are reduced to the longest first;
    what is then expanded and counted is bounded by a person's working life, however
    many spans they have.
    """
    def month_index(c: Column) -> Column:
        return F.year(c) * 12 + F.month(c) - 1

    indexed = spans.select(
        person, month_index(F.col(start)).alias("s"), month_index(F.col(end)).alias("e")
    ).where(F.col("e") > F.col("s"))
    longest = indexed.groupBy(person, "s").agg(F.max("e").alias("e"))
    months = longest.select(person, F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("m"))
    out = months.distinct().groupBy(person).agg(
        F.count("*").alias("months"), F.min("m").alias("_first")
    )
    return out.select(
        person, "months", F.floor(F.col("months") / 12).alias("years"),
        F.make_date(F.floor(F.col("_first") / 12).cast("int"), (F.col("_first") % 12 + 1).cast("int"), F.lit(1))
        .alias("from_month"),
    )
