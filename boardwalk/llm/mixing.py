"""Mixing sources to target weights: capped water-filling, then seeded whole and part repetitions.

A source is clamped where its share would repeat it more than the allowed number of epochs; what
it can't take goes to the others by weight until none is above its cap.  The clamped sources are
those with the smallest cap per weight, so one running total over the sources, sorted by that
ratio, finds them: no loop, and no limit to the number of sources.

Documents are then repeated whole: each ``floor(target / size)`` times, and the first ones of a
seeded order once more until the rest of the target is used up.  That order is cut by running
totals too, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, broadcast_if_few, running_totals, word_count
from boardwalk.llm.registry import register, table

# The weights of the contract, dealt to the sources in order of their names.
WEIGHTS = (3, 1, 2)
EPOCHS = 2.0
SHARE = 1.5
SEED = "mix-1"


def targets(scratch: Scratch, sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Target size of every source from its ``source_size`` and ``weight`` (above 0).

    All targets add up to ``share`` times all sizes, or to all caps if these are less.  With the
    sources sorted by cap / weight, a source is clamped exactly if the level that is left without
    it and all before it, (total - their caps) / other weights, is at least its own ratio.
    """
    cap = F.col("source_size") * F.lit(epochs)
    rated = sources.withColumns({"_cap": cap, "_ratio": cap / F.col("weight")})
    sums = rated.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("_all"), F.coalesce(F.sum("weight"), F.lit(0)).alias("_weights")
    )
    before = running_totals(
        scratch, rated, [], ["_ratio", "source"], {"_caps": F.col("_cap"), "_gone": F.col("weight")}, "ratios"
    ).crossJoin(F.broadcast(sums))
    level = (F.col("_all") * F.lit(share) - F.col("_caps")) / (F.col("_weights") - F.col("_gone"))
    levelled = scratch.save(before.withColumns({"_level": level, "_clamped": level >= F.col("_ratio")}), "levels")
    # the first source that is not clamped sets the level of all that follow
    water = levelled.where(~F.col("_clamped")).agg(F.min_by("_level", F.struct("_ratio", "source")).alias("_water"))
    return levelled.crossJoin(F.broadcast(water)).select(
        "source", "source_size", "weight",
        F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("weight") * F.col("_water")).alias("target"),
    )


def cycle_weights(scratch: Scratch, sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Add ``weight``: the given weights in turn by name (code points, null last)."""
    named = sources.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = running_totals(scratch, named, [], ["_null", "source"], {"_rank": F.lit(1)}, "names")
    turn = F.array(*[F.lit(w) for w in weights])
    return ranked.withColumn("weight", F.get(turn, F.pmod("_rank", F.lit(len(weights))).cast("int"))).drop("_null", "_rank")


def seeded(key: Column, text: Column, seed: str) -> Column:
    """Place of a row in the seeded order, from its key and text; nulls have one too."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(seed + ":"), part(key), F.lit(":"), part(F.md5(text))))


def quotas(
    scratch: Scratch, rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS
) -> DataFrame:
    """(source, source_size, target, whole, cutoff) from rows (source, size, place).

    Each row of a source is taken ``whole`` times, and once more if its place is at most ``cutoff``:
    the last place of which over half the row lies before the rest of the target.  So a source
    misses its target by half a row at most; rows with one place are taken alike.
    """
    sources = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_named"), "weight")
        weighed = sources.join(given, F.col("source").eqNullSafe(F.col("_named"))).drop("_named").where("weight > 0")
    else:
        weighed = cycle_weights(scratch, sources, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = targets(scratch, weighed, share, epochs).withColumn("whole", F.least(whole.cast("int"), F.lit(int(epochs))))
    goals = scratch.save(goals, "goals")
    ordered = running_totals(scratch, rows, ["source"], ["place", "size"], {"_before": F.col("size")}, "order")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    last = on_source(ordered, goals).where(F.col("_before") + F.col("size") / 2 < rest)
    last = last.groupBy("source").agg(F.max("place").alias("cutoff")).withColumnRenamed("source", "_of")
    joined = goals.join(last, F.col("source").eqNullSafe(F.col("_of")), "left")
    return scratch.save(joined.select("source", "source_size", "target", "whole", "cutoff"), "quotas")


def on_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with a written table of sources, which is broadcast if it is short."""
    of = broadcast_if_few(sources).withColumnRenamed("source", "_of")
    return rows.join(of, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def plan(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **options
) -> DataFrame:
    """One row for each row of ``docs``: key, source, size, source_size, target, times, taken.

    ``options`` are those of ``quotas``.  ``weights`` is a sequence dealt to the sources in order, or
    a DataFrame (source, weight) with each source once; a source without a weight takes nothing.
    Size is the number of words, 0 for null.  A null source is a source of its own; null keys and
    repeated rows count row by row.  A source of size 0 has target 0.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        seeded(F.col(key), F.col(text), seed).alias("place"),
    )
    rows = scratch.save(rows, "sizes")
    joined = on_source(rows, quotas(scratch, rows.drop("key"), **options), "left")
    times = F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce((F.col("place") <= F.col("cutoff")).cast("int"), F.lit(0))
    return joined.withColumn("times", times).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "times",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **options
) -> DataFrame:
    """The mixed rows: every row of ``docs`` as often as its plan says, with its own columns only.

    Texts stay where they are: a row needs nothing but its source's quota, and only sizes and
    places are shuffled to find that.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    place = seeded(F.col(key), F.col(text), seed)
    rows = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), place.alias("place"))
    found = quotas(scratch, rows, **options).select(F.col("source"), "whole", "cutoff")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("source"), place.alias("place"))
    times = F.col("whole") + F.coalesce((F.col("place") <= F.col("cutoff")).cast("int"), F.lit(0))
    taken = on_source(packed, found).withColumn("times", times).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _sql() -> str:
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('{SEED}:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(md5(text), 'null')) as place from documents),
n as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
s as (select *, {list(WEIGHTS)}[k % {len(WEIGHTS)} + 1] as weight, source_size * {EPOCHS:.1f}::double as cap from n),
r as (select *, cap / weight as ratio,
    sum(source_size) over () * {SHARE}::double as total, sum(weight) over () as weights,
    coalesce(sum(cap) over w, 0) as caps, coalesce(sum(weight) over w, 0) as gone
  from s window w as (order by cap / weight, source nulls first rows between unbounded preceding and 1 preceding)),
l as (select *, (total - caps) / (weights - gone) as lev from r),
g as (select source, source_size, case when lev >= ratio then cap
    else weight * (select min_by(lev, (ratio, coalesce(k, 0))) from l where lev < ratio) end as target from l),
h as (select *, case when source_size > 0 then least(floor(target / source_size), {int(EPOCHS)})::int else 0 end as whole from g),
o as (select d.*, h.source_size, target, whole, coalesce(sum(size) over
    (partition by d.source order by place, size rows between unbounded preceding and 1 preceding), 0) as before
  from d join h on d.source is not distinct from h.source),
c as (select source, max(place) as cutoff from o where before + size / 2 < target - whole * source_size group by source)
select doc_id, size, source_size, target,
  (size * (whole + coalesce(place <= cutoff, false)::int))::bigint as taken
from o left join c on o.source is not distinct from c.source"""


@register("op1_mix_sources", _sql())
def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
