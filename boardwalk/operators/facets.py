"""Facet counts.  Each facet applies every active filter except its own."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.operators.classify import stack_of
from boardwalk.operators.feed import (
    GHOST_LIMIT,
    before,
    contains_any,
    dated_since,
    institution_filter,
    predicates,
    quiet_filter,
    state_filter,
    ts,
)
from boardwalk.schemas import UNKNOWN, FeedQuery

# facet -> the filter it ignores.  'unsorted' stays visible in the family facet only.
OWN_FILTER = {
    "family": ("family", "not_unsorted"),
    "country": ("country",),
    "remote": ("remote",),
    "provider": ("provider",),
    "seniority": ("seniority",),
    "stack": ("stack",),
    "specialization": ("specialization",),
    # This one also passes over the pay and employment filters.
    "adjacent": ("adjacent", "has_salary", "min_salary", "employment"),
}
COUNTRY_UNKNOWN = "country_unknown"


def facet_values() -> dict[str, Column]:
    """The value each facet counts; NULL values are not counted."""
    return {
        "family": F.col("family"),
        "country": F.col("country"),
        "remote": F.col("remote_type"),
        "provider": F.col("provider"),
        "seniority": F.col("seniority"),
        "stack": stack_of(F.col("matched_skills")),
        "specialization": F.coalesce("specialization", F.lit(UNKNOWN)),
        "adjacent": F.when(F.coalesce("adjacent", F.lit(False)), "adjacent").otherwise("core"),
    }


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def facets(postings: DataFrame, f: FeedQuery) -> DataFrame:
    """(dim, value, n) for all eight facets from one scan and one small shuffle.

    Filters no facet ignores are applied first, so they reach the scan.  The rest
    become one flag each; a row then contributes to a facet when all the flags other
    than the facet's own are up.
    """
    active = predicates(f)
    own = {name for names in OWN_FILTER.values() for name in names}
    shared = [cond for name, cond in active.items() if name not in own]
    flags = {name: cond for name, cond in active.items() if name in own}
    base = postings.where(_all(shared)).select(
        *[_flag(cond).alias(f"_p_{name}") for name, cond in flags.items()],
        *[value.alias(f"_v_{dim}") for dim, value in facet_values().items()],
    )

    def passes(dim: str) -> Column:
        return _all(F.col(f"_p_{n}") for n in flags if n not in OWN_FILTER[dim])

    entries = [
        F.when(passes(dim) & F.col(f"_v_{dim}").isNotNull(), _entry(dim, F.col(f"_v_{dim}")))
        for dim in OWN_FILTER
    ]
    entries.append(
        F.when(
            passes("country") & F.col("_v_country").isNull(), _entry(COUNTRY_UNKNOWN, F.lit(""))
        )
    )
    counted = (
        base.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.dim").alias("dim"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return _with_zero(counted)


def _entry(dim: str, value: Column) -> Column:
    return F.struct(F.lit(dim).alias("dim"), value.alias("value"))


def _with_zero(counted: DataFrame, shape_keys: list[str] | None = None) -> DataFrame:
    """The unknown-country count is stated even when it is zero, for every given shape."""
    zero, keys = counted.sparkSession.range(1), []
    if shape_keys is not None:
        keys = ["shape_key"]
        zero = zero.select(F.explode(F.array(*map(F.lit, shape_keys))).alias("shape_key"))
    zero = zero.select(
        *keys, F.lit(COUNTRY_UNKNOWN).alias("dim"), F.lit("").alias("value"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        counted.unionByName(zero).groupBy(*keys, "dim", "value").agg(F.sum("n").alias("n"))
    )


def simple_facets(postings: DataFrame) -> DataFrame:
    """Counts over a finished result: family, provider, remote and country."""
    entries = F.array_compact(
        F.array(
            F.when(F.col("family").isNotNull(), _entry("family", F.col("family"))),
            _entry("provider", F.col("provider")),
            _entry("remote", F.coalesce("remote_type", F.lit("unknown"))),
            _entry("country", F.coalesce("country", F.lit("unknown"))),
        )
    )
    return (
        postings.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.dim").alias("dim"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


# --------------------------------------------------------------------------- snapshots


def shape_key(family: str | None, country: str | None, hide_ghosts: bool) -> str:
    return f"{family or '*'}|{country or '*'}|{'g1' if hide_ghosts else 'g0'}"


def default_shapes(families: list[str], countries: list[str]) -> list[tuple]:
    """(shape_key, family, country, hide_ghosts) of every precomputed view."""
    return [
        (shape_key(f, c, g), f, c, g)
        for g in (False, True)
        for c in (None, *countries)
        for f in (None, *families)
    ]


CELL = [f"_v_{d}" for d in OWN_FILTER]


def in_scope(now: str, max_age_days: int) -> Column:
    """Rows that stored views count."""
    return F.col("closed_at").isNull() & F.col("family").isNotNull() & dated_since(before(now, max_age_days))


def cells(postings: DataFrame, weight: Column | None = None) -> DataFrame:
    """Postings reduced to distinct combinations of the counted values; ``c`` sums their weights (1 each)."""
    values = {f"_v_{d}": v for d, v in facet_values().items()}
    solid = F.coalesce("ghost_risk", F.lit(0.0)) < GHOST_LIMIT
    one = F.lit(1) if weight is None else weight
    return (
        postings.select(*[v.alias(n) for n, v in values.items()], solid.alias("_solid"), one.cast("bigint").alias("_w"))
        .groupBy(*CELL, "_solid")
        .agg(F.sum("_w").alias("c"))
    )


def _entries(cell_counts: DataFrame) -> DataFrame:
    """(dim, value, its own family, country, _solid, _sorted, _core, c): what cells add to each facet value.

    A cell gives one row for each facet, summed in the task; there are only as many sums as values
    with families, countries and three flags, however many cells.
    """
    core = F.col("_v_adjacent") == "core"
    entries = []
    for d in OWN_FILTER:
        counted = F.col(f"_v_{d}").isNotNull()
        entries.append(F.when(counted if d == "adjacent" else counted & core, _entry(d, F.col(f"_v_{d}"))))
    entries.append(F.when(F.col("_v_country").isNull(), _entry(COUNTRY_UNKNOWN, F.lit(""))))
    return (
        cell_counts.select(
            F.col("_v_family").alias("_family"), F.col("_v_country").alias("_country"), "_solid",
            _flag(F.col("_v_family") != "unsorted").alias("_sorted"), _flag(core).alias("_core"), "c",
            F.explode(F.array_compact(F.array(*entries))).alias("e"),
        )
        .groupBy(*ENTRY, F.col("e.dim").alias("dim"), F.col("e.value").alias("value"))
        .agg(F.sum("c").alias("c"))
    )


ENTRY = ["_family", "_country", "_solid", "_sorted", "_core"]


def _reached(cell_counts: DataFrame) -> DataFrame:
    """(kind, family, country, ghosts, dim, value, n): each cell in the views it can be in, at most 16.

    A view's family facet ignores its family and its country facet its country, so these are counted
    once for all views that differ in nothing else (kinds 'family' and 'country'; 'rest' are the others).
    Cells are summed by facet value first, and only these sums are placed.
    """
    family_in, country_in, none = F.col("_family"), F.col("_country"), F.lit(None).cast("string")
    kinds = {d: F.col("dim") == d for d in ("family", "country")}
    unknown = F.col("dim") == COUNTRY_UNKNOWN
    rest = ~kinds["family"] & ~kinds["country"] & ~unknown
    by_country = kinds["country"] | unknown
    spots = []
    for ghosts in (False, True):
        for family in (none, family_in):
            for country, there in ((none, F.lit(True)), (country_in, country_in.isNotNull())):
                spots.append(F.when(rest & F.col("_sorted") & there, F.struct(*_spot("rest", family, country, ghosts))))
            spots.append(F.when(by_country & F.col("_sorted") & F.col("_core"), F.struct(*_spot("country", family, none, ghosts))))
        for country, there in ((none, F.lit(True)), (country_in, country_in.isNotNull())):
            spots.append(F.when(kinds["family"] & F.col("_core") & there, F.struct(*_spot("family", none, country, ghosts))))
    placed = _entries(cell_counts).withColumn("s", F.explode(F.array_compact(F.array(*spots)))).where(
        ~F.col("s.ghosts") | F.col("_solid")
    )
    return placed.groupBy(*[F.col(f"s.{name}").alias(name) for name in SPOT], "dim", "value").agg(F.sum("c").alias("n"))


SPOT = ["kind", "family", "country", "ghosts"]


def _spot(kind: str, family: Column, country: Column, ghosts: bool) -> list[Column]:
    return [F.lit(kind).alias("kind"), family.alias("family"), country.alias("country"), F.lit(ghosts).alias("ghosts")]


def view_counts(cell_counts: DataFrame, shapes: list[tuple]) -> DataFrame:
    """(shape_key, dim, value, n) of every shape from cells, whose counts may be negative.

    Cells never meet the shapes: their sums, one for each view and value, do.
    """
    text = lambda x: F.lit(x).cast("string")
    views = [
        F.struct(F.lit(key).alias("shape_key"), *_spot(kind, text(f), text(c), ghosts))
        for key, family, country, ghosts in shapes
        for kind, f, c in (("rest", family, country), ("family", None, country), ("country", family, None))
    ]
    one = cell_counts.sparkSession.range(1)
    listed = F.broadcast(one.select(F.inline(F.array(*views))))  # three rows for each given shape
    found = _reached(cell_counts)
    same = [found[name].eqNullSafe(listed[name]) for name in SPOT]
    joined = found.join(listed, reduce(lambda a, b: a & b, same))
    return joined.groupBy("shape_key", "dim", "value").agg(F.sum("n").alias("n"))


def snapshot(postings: DataFrame, shapes: list[tuple], now: str, max_age_days: int) -> DataFrame:
    """Facets of every default shape: (shape_key, dim, value, n, computed_at).

    Postings are first reduced to distinct combinations of the counted values, and each of
    those goes only to the views it is in.
    """
    counted = view_counts(cells(postings.where(in_scope(now, max_age_days))), shapes)
    return _with_zero(counted, [s[0] for s in shapes]).withColumn("computed_at", ts(now))


def snapshot_change(
    stored: DataFrame, old: DataFrame, new: DataFrame, rest: DataFrame, shapes: list[tuple],
    then: str, now: str, max_age_days: int,
) -> DataFrame:
    """The snapshot at ``now`` from the one at ``then``, without counting the table again.

    ``old`` and ``new`` are the changed part of the table as it was and as it is, ``rest`` is what did not
    change; of that only rows between the two age limits are read, as time alone moves them in or out.
    Equal to ``snapshot`` of ``new`` and ``rest`` at ``now``.  Values that no row has any more go, but for
    the count of unknown countries.  ``stored`` must hold the same shapes.
    """
    was, is_in = _flag(in_scope(then, max_age_days)), _flag(in_scope(now, max_age_days))
    first = F.least(before(then, max_age_days), before(now, max_age_days))
    last = F.greatest(before(then, max_age_days), before(now, max_age_days))
    dated = F.col("posted_at")
    seen = F.col("first_seen_at")
    between = ((dated >= first) & (dated < last)) | (dated.isNull() & (seen >= first) & (seen < last))
    sign = is_in.cast("int") - was.cast("int")
    needed = ["family", "country", "remote_type", "provider", "seniority", "matched_skills", "specialization", "adjacent", "ghost_risk"]
    parts = [
        old.where(was).select(*needed, F.lit(-1).alias("_sign")),
        new.where(is_in).select(*needed, F.lit(1).alias("_sign")),
        rest.where(F.col("closed_at").isNull() & between).select(*needed, sign.alias("_sign")).where("_sign <> 0"),
    ]
    moved = cells(parts[0].unionByName(parts[1]).unionByName(parts[2]), F.col("_sign")).where("c <> 0")
    delta = view_counts(moved, shapes)
    merged = (
        stored.select("shape_key", "dim", "value", "n").unionByName(delta)
        .groupBy("shape_key", "dim", "value").agg(F.sum("n").alias("n"))
    )
    kept = merged.where((F.col("n") != 0) | (F.col("dim") == COUNTRY_UNKNOWN))
    return kept.withColumn("computed_at", ts(now))


def snapshot_key(f: FeedQuery, families: list[str], countries: list[str]) -> str | None:
    """Key of the stored view that answers the query, or None."""
    if not f.is_default_except("family", "country", "hide_ghosts"):
        return None
    if f.family and f.family not in families or f.country and f.country not in countries:
        return None
    return shape_key(f.family, f.country, f.hide_ghosts)


def routed_facets(
    postings: DataFrame, stored: DataFrame, f: FeedQuery,
    families: list[str], countries: list[str], max_age_hours: int = 24,
) -> DataFrame:
    """Stored counts when a fresh snapshot holds the shape, else counted live."""
    key = snapshot_key(f, families, countries)
    if key is None:
        return facets(postings, f)
    age_limit = ts(f.now) - F.make_dt_interval(hours=F.lit(max_age_hours))
    fresh = stored.where(
        (F.col("shape_key") == key)
        & (F.col("computed_at") > age_limit)
        & (F.col("computed_at") <= ts(f.now))
    ).select("dim", "value", "n")
    return facets(postings, f) if fresh.isEmpty() else fresh


def as_maps(counted: DataFrame, *keys: str) -> DataFrame:
    """Presentation form: one map per facet.  Facets hold few distinct values."""
    return counted.groupBy(*keys, "dim").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts")
    )


# ------------------------------------------------------------------------------- pages


def quiet_facets(
    postings: DataFrame, family: str | None, families: list[str], now: str, max_age_days: int, **options
) -> DataFrame:
    """(dim, value, n): families, then countries within the chosen family."""
    rows = postings.where(
        quiet_filter(now, max_age_days, **options) & F.col("family").isin(families)
    )
    chosen = F.col("family") == F.lit(family).cast("string")
    entries = F.array_compact(
        F.array(
            _entry("family", F.col("family")),
            F.when(chosen & F.col("country").isNotNull(), _entry("country", F.col("country"))),
            F.when(chosen & F.col("country").isNull(), _entry(COUNTRY_UNKNOWN, F.lit(""))),
        )
    )
    return _count_entries(rows, entries)


def institution_facets(
    postings: DataFrame, now: str, max_age_days: int, sector: str | None = None,
    specialization: str | None = None, q: str | None = None, **options,
) -> DataFrame:
    """(dim, value, n): sectors, countries, and specializations of the whole sector."""
    rows = postings.where(institution_filter(now, max_age_days, **options))
    hit = F.lit(True)
    if specialization:
        hit = hit & _flag(F.col("specialization") == specialization)
    if q:
        hit = hit & contains_any(q, "title", "company")
    in_sector = F.lit(True) if sector is None else F.col("sector") == sector
    entries = F.array_compact(
        F.array(
            F.when(hit, _entry("sector", F.col("sector"))),
            F.when(hit & in_sector & F.col("country").isNotNull(), _entry("country", F.col("country"))),
            F.when(hit & in_sector & F.col("country").isNull(), _entry(COUNTRY_UNKNOWN, F.lit(""))),
            F.when(
                in_sector & F.col("specialization").isNotNull(),
                _entry("specialization", F.col("specialization")),
            ),
        )
    )
    return _count_entries(rows, entries)


def _count_entries(rows: DataFrame, entries: Column) -> DataFrame:
    counted = (
        rows.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.dim").alias("dim"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return _with_zero(counted)


def state_counts(
    postings: DataFrame, region: str, families: list[str], now: str, max_age_days: int, **options
) -> DataFrame:
    """Postings per family in one state, zero where there are none."""
    found = (
        postings.where(state_filter(region, now, max_age_days, **options))
        .where(F.col("family").isin(families))
        .groupBy("family")
        .agg(F.count("*").alias("n"))
    )
    listed = postings.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, families))).alias("family")
    )
    return listed.join(found, "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))
