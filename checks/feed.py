"""Feed pages, filters and facet counts."""

from pyspark.sql import functions as F

from boardwalk.functions.pay import salary_usd
from boardwalk.operators import facets as facet_ops
from boardwalk.operators import feed
from boardwalk.schemas import FeedQuery
from checks import fixtures as fx
from checks.registry import register
from checks.sqltext import case, quote
from boardwalk.rules.currency import PER_USD

N = f"timestamp '{fx.NOW}'"
SHOWN = "key, title, company, location, country, remote_type, seniority, posted_at, family"
RATE = case(
    ((f"upper(trim(coalesce(salary_currency, 'USD'))) = '{k}'", repr(v)) for k, v in PER_USD.items()),
    "1.0e0",
)
USD = f"(coalesce(salary_max, salary_min) / cast({RATE} as double))"
STACK = (
    "case when list_has_any(matched_skills, ['Python','Python Web','Python Tooling','Python Data',"
    "'LLM Tooling','ML Frameworks','MLOps']) then 'python' when list_has_any(matched_skills, "
    "['JS/TS','Frontend FW','Java','Other Backend','Web UI']) then 'other' else 'unknown' end"
)


def query(**kw) -> FeedQuery:
    kw.setdefault("max_age_days", fx.WIDE_DAYS)
    return FeedQuery(now=fx.NOW, **kw)


def heavy_postings(spark, sf_dir):
    """Postings spread over all cores, for queries whose cost is in per-row rules."""
    return postings(spark, sf_dir, spread_first=True)


def postings(spark, sf_dir, spread_first=False):
    df = fx.postings(spark, sf_dir, spread_first)
    return df.withColumn("salary_usd", salary_usd(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency")))


def since(days: int, undated: str = "true") -> str:
    at = f"{N} - interval '{days}' day"
    return f"(posted_at >= {at} or (posted_at is null and {undated} and first_seen_at >= {at}))"


WINDOW = since(fx.WIDE_DAYS)
CORE = "not coalesce(adjacent, false)"
SORTED = "coalesce(family, '') <> 'unsorted'"
BASE = f"closed_at is null and family is not null and {WINDOW}"
DEFAULT = f"{BASE} and {SORTED} and {CORE}"
NEWEST = "order by posted_at desc nulls last, key"


def page_check(name: str, where: str, order: str = NEWEST, limit: int = 50, offset: int = 0, **kw):
    """A page query and the same page in SQL."""
    f = query(limit=limit, offset=offset, **kw)

    @register(
        name,
        fx.with_postings(
            f"select {SHOWN} from postings where {where} {order} limit {limit} offset {offset}"
        ),
    )
    def run(spark, sf_dir):
        return feed.page(postings(spark, sf_dir), f).select(*SHOWN.split(", "))


page_check("feed_page_newest", DEFAULT)
page_check("feed_page_offset", DEFAULT, offset=100, limit=25)


@register("feed_page_after", fx.with_postings(f"select {SHOWN} from postings where {DEFAULT} {NEWEST} limit 200"))
def feed_page_after(spark, sf_dir):
    """Four pages, each behind the last row of the one before."""
    p, f, after, pages = postings(spark, sf_dir), query(limit=50), None, []
    for _ in range(4):
        pages.append(feed.page_after(p, f, after))
        last = pages[-1].select("sort_value", "key").tail(1)
        if not last:
            break
        after = tuple(last[0])
    both = pages[0]
    for page in pages[1:]:
        both = both.unionByName(page)
    return both.select(*SHOWN.split(", "))


page_check("feed_page_salary", DEFAULT, order=f"order by coalesce({USD}, -1) desc, key", sort="salary")
page_check("feed_filter_family", f"{DEFAULT} and family = 'cloud'", family="cloud")
page_check("feed_filter_unsorted", f"{BASE} and {CORE} and family = 'unsorted'", family="unsorted")
page_check("feed_filter_out_of_scope", f"closed_at is null and {WINDOW} and {SORTED} and {CORE}", in_scope=False)
page_check("feed_filter_country", f"{DEFAULT} and country = 'US'", country="US")
page_check("feed_filter_unknown_country", f"{DEFAULT} and country is null", country="__unknown__")
page_check("feed_filter_provider", f"{DEFAULT} and provider = 'lever'", provider="lever")
page_check("feed_filter_stack", f"{DEFAULT} and {STACK} = 'python'", stack="python")
page_check(
    "feed_filter_specialization",
    f"{DEFAULT} and family = 'data' and specialization = 'data_science'",
    family="data", specialization="data_science",
)
page_check(
    "feed_filter_specialization_unknown", f"{DEFAULT} and specialization is null",
    specialization="__unknown__",
)
page_check(
    "feed_filter_remote_keep_unknown",
    f"{DEFAULT} and (remote_type = 'hybrid' or remote_type is null)", remote="hybrid",
)
page_check(
    "feed_filter_remote_strict", f"{DEFAULT} and remote_type = 'hybrid'",
    remote="hybrid", keep_unknown=False,
)
page_check(
    "feed_filter_seniority", f"{DEFAULT} and (seniority = 'senior' or seniority is null)",
    seniority="senior",
)
page_check(
    "feed_filter_employment",
    f"{DEFAULT} and (lower(regexp_replace(coalesce(employment_type, ''), '[^a-zA-Z]', '', 'g')) "
    "like '%parttime%' or employment_type is null)",
    employment="Part-Time",
)
page_check(
    "feed_filter_has_salary", f"{DEFAULT} and (salary_min is not null or salary_max is not null)",
    has_salary=True,
)
page_check(
    "feed_filter_salary_min", f"{DEFAULT} and coalesce(salary_max, salary_min, 0) >= 300000",
    min_salary=300000.0,
)
page_check(
    "feed_filter_salary_min_usd",
    f"{DEFAULT} and coalesce(salary_max, salary_min, 0) / cast({RATE} as double) >= 200000",
    min_salary=200000.0, min_salary_in_usd=True,
)
page_check("feed_filter_within_days", f"{DEFAULT} and {since(90)}", within_days=90)
page_check(
    "feed_filter_within_days_dated", f"{DEFAULT} and {since(90, 'false')}",
    within_days=90, keep_unknown=False,
)
page_check("feed_filter_adjacent_only", f"{BASE} and {SORTED} and coalesce(adjacent, false)", adjacent="only")
page_check("feed_filter_adjacent_include", f"{BASE} and {SORTED}", adjacent="include")
page_check("feed_filter_ai", f"{DEFAULT} and ai", ai=True)
page_check("feed_hide_ghosts", f"{DEFAULT} and coalesce(ghost_risk, 0) < 0.4", hide_ghosts=True)
page_check(
    "feed_text_search",
    f"{DEFAULT} and (title ilike '%data%sci%' or company ilike '%data%sci%' or "
    "coalesce(location, '') ilike '%data%sci%')",
    q="data%sci",
)


@register(
    "feed_totals",
    fx.with_postings(
        f"select count(*) as total, count(*) filter (where posted_at is null) as undated "
        f"from postings where {DEFAULT}"
    ),
)
def feed_totals(spark, sf_dir):
    return feed.counts(postings(spark, sf_dir), query())


@register(
    "feed_has_more",
    fx.with_postings(
        f"select key, posted_at, (select count(*) > 20 from postings where {DEFAULT} and family = 'data') "
        f"as has_more from postings where {DEFAULT} and family = 'data' {NEWEST} limit 20"
    ),
)
def feed_has_more(spark, sf_dir):
    rows = feed.page_with_more(postings(spark, sf_dir), query(family="data", limit=20))
    return rows.select("key", "posted_at", "has_more")


@register(
    "feed_late_page",
    fx.with_postings(f"select {SHOWN} from postings where {DEFAULT} {NEWEST} limit 50"),
)
def feed_late_page(spark, sf_dir):
    return feed.late_page(postings(spark, sf_dir), query(), SHOWN.split(", "))


@register(
    "feed_unknowns",
    fx.with_postings_cte(
        f"page as (select * from postings where {DEFAULT} and (remote_type = 'hybrid' or remote_type is null) "
        f"and (seniority = 'senior' or seniority is null) {NEWEST} limit 50)",
        "select cast(0 as bigint) as country, count(*) filter (where seniority is null) as seniority, "
        "count(*) filter (where remote_type is null) as remote, cast(0 as bigint) as employment, "
        "cast(0 as bigint) as posted_within from page",
    ),
)
def feed_unknowns(spark, sf_dir):
    f = query(remote="hybrid", seniority="senior")
    return feed.unknowns(feed.page(postings(spark, sf_dir), f), f)


@register(
    "feed_row_projection",
    fx.with_postings(
        f"select key, coalesce(adjacent, false) as adjacent, coalesce(ghost_risk, 0) as ghost_risk, "
        f"cast(floor((epoch({N}) - epoch(posted_at)) / 86400) as bigint) as age_days, "
        "family is not null as in_scope from postings"
    ),
)
def feed_row_projection(spark, sf_dir):
    df = postings(spark, sf_dir).selectExpr(
        "*", "cast(null as string) department", "cast(null as string) apply_url", "cast(null as int) skill_score"
    )
    return feed.to_feed_row(df, fx.NOW).select("key", "adjacent", "ghost_risk", "age_days", "in_scope")


@register(
    "in_scope_total", fx.with_postings(f"select count(*) as in_scope from postings where {BASE}")
)
def in_scope_total(spark, sf_dir):
    return feed.in_scope_total(postings(spark, sf_dir), query())




@register(
    "refresh_window_sum",
    f"with runs as (select max(ts) as finished_at, cast(sum(floor(value)) as bigint) as jobs_scanned "
    "from events group by event_id // 5) "
    "select max(finished_at) as refreshed_at, cast(coalesce(sum(jobs_scanned) filter (where finished_at > "
    "(select max(finished_at) from runs) - interval '30' minute), 0) as bigint) as scanned from runs",
)
def refresh_window_sum(spark, sf_dir):
    runs = fx.from_sql(
        spark, sf_dir,
        "select max(ts) as finished_at, cast(sum(floor(value)) as bigint) as jobs_scanned "
        "from events group by event_id div 5",
        "events",
    )
    return feed.refresh_window(runs)


# ----------------------------------------------------------------------------- facets


def facet_sql(skip_dim_filters: dict, hide: str = "true", base: str = BASE) -> str:
    """Counts per facet, each under every condition but its own."""
    c = {"family": "true", "not_unsorted": SORTED, "country": "true", "remote": "true", "provider": "true",
         "seniority": "true", "stack": "true", "specialization": "true", "adjacent": CORE, "pay": "true"}
    c.update(skip_dim_filters)
    value = {
        "family": "family", "country": "country", "remote": "remote_type", "provider": "provider",
        "seniority": "seniority", "stack": STACK, "specialization": "coalesce(specialization, '__unknown__')",
        "adjacent": "case when coalesce(adjacent, false) then 'adjacent' else 'core' end",
    }
    own = {"family": {"family", "not_unsorted"}, "adjacent": {"adjacent", "pay"}}
    parts = []
    for dim, v in value.items():
        skip = own.get(dim, {dim})
        cond = " and ".join(f"({x})" for k, x in c.items() if k not in skip)
        parts.append(
            f"select '{dim}' as dim, {v} as value, count(*) as n from postings where {base} and {hide} "
            f"and {cond} and {v} is not null group by 2"
        )
    cond = " and ".join(f"({x})" for k, x in c.items() if k != "country")
    parts.append(
        f"select 'country_unknown' as dim, '' as value, count(*) as n from postings where {base} and {hide} "
        f"and {cond} and country is null"
    )
    return "\nunion all\n".join(parts)


def facet_check(name: str, conditions: dict, hide: str = "true", **kw):
    f = query(**kw)

    @register(name, fx.with_postings(facet_sql(conditions, hide)))
    def run(spark, sf_dir):
        return facet_ops.facets(postings(spark, sf_dir), f)


facet_check("facets_default", {})
facet_check("facets_family", {"family": "family = 'cloud'"}, family="cloud")
facet_check(
    "facets_family_country", {"family": "family = 'software'", "country": "country = 'US'"},
    family="software", country="US",
)
facet_check(
    "facets_many_filters",
    {"remote": "remote_type = 'hybrid' or remote_type is null", "provider": "provider = 'lever'",
     "seniority": "seniority = 'senior' or seniority is null", "stack": f"{STACK} = 'python'"},
    hide="coalesce(ghost_risk, 0) < 0.4",
    remote="hybrid", provider="lever", seniority="senior", stack="python", hide_ghosts=True,
)
facet_check(
    "facets_adjacent_quirk",
    {"pay": "(salary_min is not null or salary_max is not null) and coalesce(salary_max, salary_min, 0) >= 200000 "
     "and (lower(regexp_replace(coalesce(employment_type, ''), '[^a-zA-Z]', '', 'g')) like '%contract%' "
     "or employment_type is null)",
     "specialization": "specialization is null"},
    has_salary=True, min_salary=200000.0, employment="contract", specialization="__unknown__",
)


@register(
    "facets_simple",
    fx.with_postings(
        f"select 'family' as dim, family as value, count(*) as n from postings where {DEFAULT} group by 2 "
        f"union all select 'provider', provider, count(*) from postings where {DEFAULT} group by 2 "
        f"union all select 'remote', coalesce(remote_type, 'unknown'), count(*) from postings where {DEFAULT} group by 2 "
        f"union all select 'country', coalesce(country, 'unknown'), count(*) from postings where {DEFAULT} group by 2"
    ),
)
def facets_simple(spark, sf_dir):
    return facet_ops.simple_facets(feed.filtered(postings(spark, sf_dir), query()))


SHAPES = facet_ops.default_shapes(fx.SNAPSHOT_FAMILIES, fx.SNAPSHOT_COUNTRIES)


def snapshot_sql() -> str:
    parts = []
    for key, family, country, ghosts in SHAPES:
        cond = {}
        if family:
            cond["family"] = f"family = '{family}'"
        if country:
            cond["country"] = f"country = '{country}'"
        hide = "coalesce(ghost_risk, 0) < 0.4" if ghosts else "true"
        parts.append(f"select {quote(key)} as shape_key, * from ({facet_sql(cond, hide)})")
    return "\nunion all\n".join(parts)


@register("snapshot_shapes", fx.with_postings(snapshot_sql()))
def snapshot_shapes(spark, sf_dir):
    stored = facet_ops.snapshot(postings(spark, sf_dir), SHAPES, fx.NOW, fx.WIDE_DAYS)
    return stored.drop("computed_at")


@register("snapshot_route", fx.with_postings(facet_sql({"family": "family = 'data'"})))
def snapshot_route(spark, sf_dir):
    df = postings(spark, sf_dir)
    stored = facet_ops.snapshot(df, SHAPES, fx.NOW, fx.WIDE_DAYS)
    return facet_ops.routed_facets(
        df, stored, query(family="data"), fx.SNAPSHOT_FAMILIES, fx.SNAPSHOT_COUNTRIES
    )


# ------------------------------------------------------------------------------- pages

QUIET = f"closed_at is null and quiet and adjacent = false and {WINDOW}"
QUIET_ON = f"{QUIET} and remote_type <> 'fully_remote' and seniority <> 'entry' and provider not in ('greenhouse','lever','ashby')"
QUIET_SCORE = (
    "greatest(0, least(100, 40 + case remote_type when 'on_site' then 25 when 'hybrid' then 15 "
    "when 'fully_remote' then -15 else 0 end + case when provider in ('greenhouse','lever','ashby') then 0 else 15 end "
    "+ case when provider in ('workday','ukg') then 10 else 0 end + case when seniority = 'entry' then -20 "
    "when seniority in ('staff','principal','lead') then 10 else 0 end))"
)


@register(
    "quiet_page",
    fx.with_postings(f"select {SHOWN} from postings where {QUIET_ON} and family = 'cloud' {NEWEST} limit 50"),
)
def quiet_page(spark, sf_dir):
    rows = feed.quiet_page(
        postings(spark, sf_dir), "cloud", fx.NOW, fx.WIDE_DAYS, on_site=True, no_entry=True, mid_market=True
    )
    return rows.select(*SHOWN.split(", "))


@register(
    "quiet_rerank",
    fx.with_postings_cte(
        f"pool as (select * from postings where {QUIET} and family = 'software' )",
        f"select key, {QUIET_SCORE} as quiet_score from pool order by quiet_score desc, key limit 50",
    ),
)
def quiet_rerank(spark, sf_dir):
    rows = feed.quiet_page(postings(spark, sf_dir), "software", fx.NOW, fx.WIDE_DAYS, ranked=True)
    return rows.select("key", "quiet_score")


@register(
    "quiet_score", fx.with_postings(f"select key, {QUIET_SCORE} as quiet_score from postings")
)
def quiet_score(spark, sf_dir):
    from boardwalk.operators.score import quiet_score as score

    df = postings(spark, sf_dir)
    return df.select("key", score(F.col("provider"), F.col("remote_type"), F.col("seniority")).alias("quiet_score"))


@register(
    "quiet_facets",
    fx.with_postings_cte(
        f"m as (select family, country from postings where {QUIET_ON} and salary_min is not null "
        "and family in ('cloud','software','data','hris'))",
        "select 'family' as dim, family as value, count(*) as n from m group by 2 union all "
        "select 'country', country, count(*) from m where family = 'cloud' and country is not null group by 2 union all "
        "select 'country_unknown', '', count(*) from m where family = 'cloud' and country is null",
    ),
)
def quiet_facets(spark, sf_dir):
    return facet_ops.quiet_facets(
        postings(spark, sf_dir), "cloud", ["cloud", "software", "data", "hris"], fx.NOW, fx.WIDE_DAYS,
        on_site=True, no_entry=True, mid_market=True, paid_only=True,
    )


INST = f"closed_at is null and sector is not null and family is not null and adjacent = false and {WINDOW}"


@register(
    "institution_page",
    fx.with_postings(
        f"select {SHOWN} from postings where {INST} and sector = 'health' and quiet {NEWEST} limit 50"
    ),
)
def institution_page(spark, sf_dir):
    rows = feed.institution_page(postings(spark, sf_dir), fx.NOW, fx.WIDE_DAYS, sector="health", quiet=True)
    return rows.select(*SHOWN.split(", "))


@register(
    "institution_facets",
    fx.with_postings_cte(
        f"m as (select sector, country, specialization, (title ilike '%engineer%' or company ilike '%engineer%') as hit "
        f"from postings where {INST})",
        "select 'sector' as dim, sector as value, count(*) as n from m where hit group by 2 union all "
        "select 'country', country, count(*) from m where hit and country is not null and sector = 'health' group by 2 union all "
        "select 'country_unknown', '', count(*) from m where hit and country is null and sector = 'health' union all "
        "select 'specialization', specialization, count(*) from m where specialization is not null and sector = 'health' group by 2",
    ),
)
def institution_facets(spark, sf_dir):
    return facet_ops.institution_facets(
        postings(spark, sf_dir), fx.NOW, fx.WIDE_DAYS, sector="health", q="engineer"
    )


STATE = f"closed_at is null and region = 'WA' and family is not null and {WINDOW} and remote_type = 'on_site'"


@register(
    "state_page",
    fx.with_postings(
        f"select {SHOWN} from postings where {STATE} and family in "
        f"('cloud','software','data','hris','testing','networking') {NEWEST} limit 50"
    ),
)
def state_page(spark, sf_dir):
    rows = feed.state_page(
        postings(spark, sf_dir), "WA", fx.SNAPSHOT_FAMILIES, fx.NOW, fx.WIDE_DAYS, workplace="on_site"
    )
    return rows.select(*SHOWN.split(", "))


@register(
    "state_counts",
    fx.with_postings(
        "select f.family, count(p.key) as n from (values ('cloud'),('software'),('data'),('hris'),('testing'),"
        f"('networking'),('unsorted')) as f(family) left join (select * from postings where {STATE}) p "
        "on p.family = f.family group by 1"
    ),
)
def state_counts(spark, sf_dir):
    return facet_ops.state_counts(
        postings(spark, sf_dir), "WA", [*fx.SNAPSHOT_FAMILIES, "unsorted"], fx.NOW, fx.WIDE_DAYS,
        workplace="on_site",
    )


@register(
    "posting_by_key",
    fx.with_postings(f"select {SHOWN} from postings where key = 'lever:c49:7'"
                     .replace("'lever:c49:7'", "(select max(key) from postings)")),
)
def posting_by_key(spark, sf_dir):
    df = postings(spark, sf_dir)
    last = df.agg(F.max("key")).first()[0]
    return feed.posting_by_key(df, last).select(*SHOWN.split(", "))
