"""Line dedup: runs of lines that occur again are deleted wherever they come later.

Each document is a sequence of line ids.  A suffix array over all sequences is built by prefix
doubling: the rank of a suffix by its first 2k lines is the rank of its pair of ranks by k lines, at
its start and k lines further on.  Suffixes with one rank form an interval whose longest common
prefix is at least that long.  A suffix whose prefix is unique can't repeat and leaves at once, so
lines that occur once are never sorted, and a level holds repeated runs only.

A run counts from ``min_words`` words on.  Every line of such a run lies in a shortest run of that
many words that starts or ends within it, so those shortest runs are looked up: two ranks, from
their two ends, say which interval a run of any length is in, and all but the first of an interval
are deleted.  Together they are exactly the later copies of all maximal runs.  As a line has a word
at least, ``log2(min_words)`` doublings are enough, however long documents are.

Everything is built-in column work.  Tables after the first hold ids and positions only.  Hot lines
and runs are counted before they are shuffled, and ranks of hot ones are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.llm.common import WORD, Scratch, computed, join_counted, running_totals
from boardwalk.llm.registry import register, table

MIN_WORDS = 50
DOC = ["key", "text_hash"]


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line with a word: its document, place among such lines, line number, id, words."""
    lines = F.transform(F.split(F.col("text"), "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    cut = docs.select("key", F.xxhash64("text").alias("text_hash"), F.posexplode(F.filter(lines, lambda s: s["x"].rlike(WORD))).alias("at", "s"))
    return cut.select(
        *DOC, "at", "s.line", F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(1), "s.x").alias("h2"),
        F.regexp_count("s.x", F.lit(WORD)).alias("words"),
    ).distinct()


def _ranked(scratch: Scratch, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose ``keys`` occur again, with ``rank`` in the order of the keys."""
    total = rows.count()
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    ranks = running_totals(scratch, again, [], keys, {"rank": F.lit(1)}, f"{name}-keys")
    ranks = scratch.save(ranks, f"{name}-ranks")
    out = scratch.save(join_counted(rows, ranks, keys, "n", total).drop("n", *keys), name)
    scratch.drop(f"{name}-keys", f"{name}-ranks")
    return out


def _shortest(level: DataFrame, least: int) -> DataFrame:
    """(document, a, b): for each place the shortest run of enough words that starts, or ends, there.

    Only repeated lines stand in ``level``; runs don't reach over a gap in their places.
    """
    by = Window.partitionBy(*DOC).orderBy("at")
    own = level.withColumn("island", F.col("at") - F.row_number().over(by))
    island = [*DOC, "island"]
    own = own.withColumn("upto", F.sum("words").over(Window.partitionBy(*island).orderBy("at")))
    spots = own.select(*island, "at", "upto", (F.col("upto") - F.col("words")).alias("before"))
    # on a line of word counts, a start looks ahead for the end that completes it, an end looks back
    events = spots.select(
        *island, F.explode(F.array(
            F.struct((F.col("before") + least).alias("v"), F.lit(0).alias("t"), F.col("at").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(True).alias("ahead")),
            F.struct(F.col("upto").alias("v"), F.lit(1).alias("t"), F.lit(None).cast("int").alias("a"), F.col("at").alias("b"), F.lit(True).alias("ahead")),
            F.struct(F.col("before").alias("v"), F.lit(0).alias("t"), F.col("at").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(False).alias("ahead")),
            F.struct((F.col("upto") - least).alias("v"), F.lit(1).alias("t"), F.lit(None).cast("int").alias("a"), F.col("at").alias("b"), F.lit(False).alias("ahead")),
        )).alias("e")
    ).select(*island, "e.*")
    order = Window.partitionBy(*island, "ahead").orderBy("v", "t", F.coalesce("a", "b"))
    end = F.first("b", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    start = F.last("a", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = events.withColumns({"end": end, "start": start})
    ahead = found.where("ahead and a is not null and end is not null").select(*DOC, "a", F.col("end").alias("b"))
    back = found.where("not ahead and b is not null and start is not null").select(*DOC, F.col("start").alias("a"), "b")
    return ahead.unionByName(back).distinct()


def deletions(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, text_hash, gone): the numbers of the lines to delete, for documents that lose any."""
    scratch = Scratch(df.sparkSession, "linedup")
    lines = scratch.save(_lines(df, key, text), "lines")
    level = _ranked(scratch, lines, ["h1", "h2"], "level0")
    runs = _shortest(level.select(*DOC, "at", "words"), min_words)
    length = F.col("b") - F.col("a") + 1
    runs = scratch.save(runs.withColumn("k", F.floor(F.log2(length.cast("double") + 0.5)).cast("int")), "runs")
    deepest = runs.agg(F.max("k")).first()[0]
    found = None
    for k in range(0, (deepest if deepest is not None else -1) + 1):
        if k:
            half = 1 << (k - 1)
            ahead = level.select(*DOC, (F.col("at") - half).alias("at"), F.col("rank").alias("next"))
            pairs = level.select(*DOC, "at", F.col("rank").alias("first")).join(ahead, [*DOC, "at"])
            level = _ranked(scratch, scratch.save(pairs, f"pairs{k}"), ["first", "next"], f"level{k}")
            scratch.drop(f"pairs{k}")
        ends = level.select(*DOC, F.col("at").alias("c"), F.col("rank").alias("right"))
        at_ends = (
            runs.where(F.col("k") == k).withColumn("c", F.col("b") - (1 << k) + 1)
            .join(level.select(*DOC, F.col("at").alias("a"), F.col("rank").alias("left")), [*DOC, "a"]).join(ends, [*DOC, "c"])
            .select(*DOC, "a", "b", (F.col("b") - F.col("a")).alias("more"), "left", "right")
        )
        found = at_ends if found is None else found.unionByName(at_ends)
    if found is None:
        return lines.select(*DOC, F.array("line").alias("gone")).where("false")
    found = scratch.save(found, "found")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "text_hash", "a")
    run = ["more", "left", "right"]
    first = found.groupBy(*run).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_counted(found, scratch.save(first, "first"), run, "n", found.count()).where(place != F.col("first"))
    gone = later.select(*DOC, F.explode(F.sequence("a", "b")).alias("at")).distinct()
    numbered = gone.join(lines.select(*DOC, "at", "line"), [*DOC, "at"])
    return scratch.save(numbered.groupBy(*DOC).agg(F.collect_set("line").alias("gone")), "gone")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``df`` with ``text`` after deletion, ``n_lines`` and ``n_removed``.

    Lines are cut at \\n and compared as they are; lines without a word are no part of runs and
    stay.  A run is consecutive lines, blank ones aside, with ``min_words`` words or more; its first
    occurrence by (key, place) stays, where occurrences may overlap.  ``key`` must not be null for
    rows to lose lines: rows with a null key keep all.  Rows equal in key and text are one document
    and are treated alike; a null text stays null.  Columns named ``n_lines`` or ``n_removed`` are
    replaced, all others pass.
    """
    named = df.where(F.col(key).isNotNull())
    # texts are always shuffled once: documents that lose lines grow with the input like all others
    gone = deletions(named, key, text, min_words).withColumnRenamed("key", "_key").hint("merge")
    others = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*others).alias("_row"), F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"))
    joined = rows.join(gone, (F.col("_id") == F.col("_key")) & (F.col("_hash") == F.col("text_hash")), "left")
    lines = computed(joined.select("_row", "gone"), {"_lines": F.split(F.col(f"_row.{text}"), "\n", -1)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    return lines.select(
        *[(F.when(F.col("gone").isNull(), F.col(f"_row.{c}")).otherwise(left) if c == text else F.col(f"_row.{c}")).alias(c) for c in others],
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def _sql(least: int = MIN_WORDS) -> str:
    return f"""
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
e as (select doc_id, i, ls[i] as x, len(regexp_extract_all(ls[i], '{WORD}')) as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l)),
p as (select *, row_number() over w as pos, sum(n) over w as upto from e where n > 0 window w as (partition by doc_id order by i)),
s as (select doc_id, list(x order by pos) as xs from p group by doc_id),
r as (select a.doc_id, a.pos as a, b.pos as b, list_slice(xs, a.pos, b.pos)::varchar as run from p a join p b using (doc_id) join s using (doc_id)
  where b.pos >= a.pos and b.upto - a.upto + a.n >= {least} and (b.upto - b.n - a.upto + a.n < {least} or b.upto - a.upto < {least})),
f as (select doc_id, a, b, min((doc_id, a)) over (partition by run) as first from r),
g as (select distinct doc_id, unnest(range(a, b + 1)) as pos from f where (doc_id, a) <> first),
d as (select doc_id, i from g join p using (doc_id, pos)),
k as (select e.doc_id, string_agg(x, chr(10) order by e.i) as text, count(*) as n from e left join d using (doc_id, i) where d.i is null group by e.doc_id)
select l.doc_id, case when l.text is not null then coalesce(k.text, '') end as text, coalesce(len(ls), 0)::bigint as n_lines,
  (coalesce(len(ls), 0) - coalesce(k.n, 0))::bigint as n_removed
from l left join k using (doc_id)"""


@register("op4_line_dedup", _sql())
def op4_line_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
