"""Scalar normalisation: one row per posting or page, whole tables."""

from pyspark.sql import functions as F

from boardwalk.functions import dates, geo, labels, pay, slugs, text, urls
from boardwalk.operators import classify
from boardwalk.operators.score import with_fit
from boardwalk.rules import currency as currency_rules
from boardwalk.rules import geo as geo_rules
from boardwalk.rules import labels as label_rules
from boardwalk.rules import slugs as slug_rules
from boardwalk.rules import urls as url_rules
from checks import fixtures as fx
from checks.feed import RATE, STACK, USD
from checks.feed import heavy_postings as postings
from checks.registry import register
from checks.sqltext import case, first_label, hit, in_list, quote, re2, replace, trim_all


def literal_rows(values, table="orders", key="o_orderkey") -> str:
    """SQL: every row of a table with one of the literals, by remainder."""
    rows = fx._values([(v,) for v in values])
    return (
        f"select {key} as id, v.raw as raw from {table} "
        f"join (values {rows}) as v(i, raw) on v.i = {key} % {len(values)}"
    )


def scalar(name: str, values, spark_column, sql_expr: str, out: str = "value"):
    """One scalar function over literal values spread on ``orders``."""
    source = literal_rows(values)

    @register(name, f"with src as ({source}) select id, {sql_expr} as {out} from src")
    def run(spark, sf_dir):
        df = fx.from_sql(spark, sf_dir, source, "orders")
        return df.select("id", spark_column(F.col("raw")).alias(out))


LEVELS = [
    "Mid-Senior level", "Experienced (Non-Manager)", "Not Applicable", "N/A", "Internship", "intern",
    "Entry level", "Associate", "Director", "VP of Sales", "Staff", "Principal Fellow", "Senior", "Manager",
    "Head of Data", "Intermediate", "", "  Senior  ", "émérite", None,
]
scalar(
    "level_canonical", LEVELS, labels.canonical_level,
    f"nullif({first_label(trim_all('lower(raw)'), labels.LEVELS)}, '')",
)
EMPLOYMENT = [
    "Full-time", "FullTime", "full_time", "Permanent", "Regular", "Part time", "parttime", "CONTRACT",
    "Fixed-term", "Internship", "International", "Volunteer", "B2B", "temp", "", None, "Freelance (m/f/d)",
]
scalar(
    "employment_canonical", EMPLOYMENT, labels.canonical_employment,
    first_label("lower(raw)", labels.EMPLOYMENT),
)
scalar(
    "failure_reason",
    ["lever/acme: HTTP 404", "  ", None, "workday/a.b:c: timeout", "plain message", "x" * 350, "icims/q: "],
    text.failure_reason,
    "coalesce(nullif(" + replace(trim_all("coalesce(raw, '')"), r"^[a-z]+/[A-Za-z0-9_.:@+-]+:\s*")
    + ", ''), 'failed')",
)
TOKENS = ["acme-corp_uk", "bigCo", "the.north.face", "a", "--", "ibm", "Open_AI-labs", "x.y.z", "greatPlacesToWork"]
scalar(
    "token_title", TOKENS, text.titleise,
    "array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(raw, '[-_.]+', ' ', 'g'), '\\s+'), "
    "lambda w: length(w) > 0), lambda w: case when length(w) <= 3 then w else upper(w[1]) || w[2:] end), ' ')",
)
scalar(
    "token_prettify", TOKENS, text.prettify_token,
    "array_to_string(list_transform(regexp_split_to_array(trim(regexp_replace(regexp_replace(raw, '[._-]+', ' ', 'g'), "
    "'([a-z])([A-Z])', '\\1 \\2', 'g')), '\\s+'), lambda w: case when length(w) <= 3 then upper(w) else upper(w[1]) || w[2:] end), ' ')",
)
scalar(
    "token_guard",
    ["acme", "embed", "robots.txt", "0a1b2c3d-0000-1111-2222-333344445555", "y" * 101, "jobs", "en-US", "job-shop"],
    lambda c: text.looks_like_id(c) | F.coalesce(c.rlike("(?i)" + url_rules.NOT_A_TOKEN[:-1] + r"\z"), F.lit(False)),
    f"length(raw) > 100 or {hit('raw', url_rules.BARE_UUID)} or {hit('raw', url_rules.NOT_A_TOKEN)}",
)
RAW_PAYLOADS = [
    '{"company_name": " Acme "}', '{"company": "Beta"}', '{"company": {"name": "Gamma"}}',
    '{"company_name": "", "company": {"name": " Delta "}}', '{"company": {}}', "{}", None,
]
scalar(
    "company_from_raw", RAW_PAYLOADS, text.company_from_raw,
    "coalesce(nullif(trim(json_extract_string(raw, '$.company_name')), ''), "
    "case when json_type(raw, '$.company') = 'VARCHAR' then nullif(trim(json_extract_string(raw, '$.company')), '') end, "
    "nullif(trim(json_extract_string(raw, '$.company.name')), ''))",
)


@register(
    "failure_kind",
    "select event_id, case when floor(value) % 7 = 0 then 'gone' when floor(value) % 7 = 1 then 'gone' "
    "else 'refused' end as kind from events",
)
def failure_kind(spark, sf_dir):
    n = F.floor("value") % 7
    status = F.when(n == 0, 404).when(n == 1, 410).when(n == 2, 429)
    return fx.read(spark, sf_dir, "events").select("event_id", text.failure_kind(status).alias("kind"))


# ------------------------------------------------------------------------ postings text


@register(
    "title_normalise",
    fx.with_postings(
        "select key, trim(regexp_replace(regexp_replace(lower(title), "
        + quote(r"\((remote|hybrid|on[- ]?site|m/f/d|f/m/d|w/m/d)\)")
        + ", ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as title_key, "
        "coalesce(trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g')), '') as location_key, "
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), "
        + quote(r"[(\[{][^)\]}]*[)\]}]")
        + ", ' ', 'g'), " + quote("\\s+[-–—]\\s+[^-–—]{1,40}$") + ", ''), "
        + quote("[^a-z0-9+#/&. ]+") + ", ' ', 'g'), '\\s+', ' ', 'g')) as audit_title from postings"
    ),
)
def title_normalise(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "key",
        text.title_key(F.col("title")).alias("title_key"),
        text.location_key(F.col("location")).alias("location_key"),
        text.audit_title(F.col("title")).alias("audit_title"),
    )


_S = "array_to_string(parts, '; ')"
for _pattern, _by, _flags in (
    (r"^\d+\s+[^,]*,\s*", "", ""), (r"\b[A-Z]{2,4}-\d{3,}\b,?\s*", "", "g"), (r"\s+", " ", "g")
):
    _S = f"regexp_replace({_S}, {quote(_pattern)}, {quote(_by)}, {quote(_flags)})"
_S = f"trim({_S})"
for _pattern in (r"\s*\d{6}$", r"\s*\d{5}(-\d{4})?$", r",\s*$"):
    _S = f"regexp_replace({_S}, {quote(_pattern)}, '')"
_S = f"nullif(trim(regexp_replace(regexp_replace(trim({_S}), ',(\\S)', ', \\1', 'g'), ',(\\S)', ', \\1', 'g')), '')"


@register(
    "location_clean",
    fx.with_postings_cte(
        "split as (select key, location, list_filter(regexp_split_to_array(trim(location), '\\s*;\\s*'), "
        "lambda p: length(p) > 0) as parts from postings)",
        "select key, case when location is null then null when len(parts) > 2 then parts[1] || ', ' || parts[2] || ' +' || "
        f"cast(len(parts) - 2 as varchar) || ' more' else {_S} end as shown from split",
    ),
)
def location_clean(spark, sf_dir):
    return postings(spark, sf_dir).select("key", geo.clean_location(F.col("location")).alias("shown"))


def _tokens_sql(expr: str, splitter: str) -> str:
    return f"regexp_split_to_array({expr}, {quote(splitter)})"


_CODES = in_list(geo_rules.US_STATE_CODES)
_LOC = trim_all("location")
_CITY = first_label(_LOC, geo_rules.CITY_COUNTRY)
_CODE = (
    f"list_filter(list_transform({_tokens_sql(_LOC, '[,|;–-]')}, "
    f"lambda p: upper(regexp_split_to_array(trim(p), '\\s+')[1])), lambda t: t in {_CODES})[1]"
)
COUNTRY_SQL = (
    f"coalesce({first_label(_LOC, geo_rules.COUNTRY_NAMES)}, "
    f"case when {hit(_LOC, geo_rules.US_MARKERS)} then 'US' end, "
    f"case when {_CODE} is not null then case when {_CITY} = {_CODE} then {_CITY} else 'US' end end, "
    f"case when {hit(_LOC, geo_rules.US_STATE_NAMES)} then 'US' end, {_CITY}, "
    f"case when {hit(_LOC, geo_rules.US_CITIES)} then 'US' end)"
)
_SEGMENTS = _tokens_sql(_LOC, "[,|/;]|\\s[–-]\\s")
_SEG_FIRST = "upper(regexp_split_to_array(trim(p), '\\s+')[1])"
_SEG_LAST = "upper(regexp_split_to_array(trim(p), '\\s+')[-1])"
_STATE_CODE = (
    f"list_filter(list_transform({_SEGMENTS}, lambda p: case when {_SEG_FIRST} in {_CODES} then {_SEG_FIRST} "
    f"when {_SEG_LAST} in {_CODES} then {_SEG_LAST} end), lambda c: c is not null)[1]"
)
STATE_SQL = (
    f"case when coalesce({COUNTRY_SQL}, 'US') = 'US' then coalesce("
    f"case when {' or '.join(hit(_LOC, p) for p in geo_rules.DC_FORMS)} then 'DC' end, {_STATE_CODE}, "
    f"{first_label(_LOC, geo_rules.US_STATE_NAME_TO_CODE)}, {first_label(_LOC, geo_rules.CITY_STATE_US)}) end"
)


@register("country_infer", fx.with_postings(f"select key, {COUNTRY_SQL} as found from postings"))
def country_infer(spark, sf_dir):
    return postings(spark, sf_dir).select("key", geo.country("location").alias("found"))


@register("us_state", fx.with_postings(f"select key, {STATE_SQL} as found from postings"))
def us_state(spark, sf_dir):
    return postings(spark, sf_dir).select("key", geo.us_state("location").alias("found"))


EXPLICIT = ["US", "UK", "CA", "XX", "Deutschland", "United States of America", "New Mexico", "mexico", "España", "", " FR ", None]
scalar(
    "country_explicit", EXPLICIT, lambda c: geo.explicit_country("raw"),
    "case when trim(raw) = 'UK' then 'GB' when trim(raw) in " + in_list(geo_rules.COUNTRY_LABELS) + " then trim(raw) else "
    f"coalesce({first_label('trim(raw)', geo_rules.COUNTRY_NAMES)}, case when {hit('trim(raw)', geo_rules.US_MARKERS)} then 'US' end) end",
)

R = label_rules
_FULLY = r"\b(fully|100%|completely|entirely)[\s-]*remote\b"


def remote_sql(expr: str) -> str:
    return case(
        [
            (f"{hit(expr, R.HYBRID_WORDS)} and not {hit(expr, _FULLY)}", "'hybrid'"),
            (hit(expr, R.NEGATED_REMOTE), "'on_site'"),
            (hit(expr, R.REMOTE_WORDS), "'fully_remote'"),
            (hit(expr, R.ONSITE_WORDS), "'on_site'"),
        ]
    )


def physical_sql(expr: str) -> str:
    t = trim_all(expr)
    return (
        f"(coalesce(length({t}) >= 3, false) and not {hit(t, R.VAGUE_LOCATION)} and not {hit(t, R.BARE_COUNTRY)} "
        f"and not {hit(t, r'\b(remote|hybrid|virtual|work from home|wfh)\b')} and {hit(t, r'[a-z]{3}')})"
    )


_EXPLICIT_REMOTE = (
    "case when replace(replace(lower(employment_type), ' ', ''), '-', '') in ('remote', 'fullyremote') then 'fully_remote' end"
)


@register(
    "remote_type",
    fx.with_postings(
        f"select key, {remote_sql('title || chr(32) || coalesce(description, chr(32))')} as from_text, "
        f"coalesce({_EXPLICIT_REMOTE}, {remote_sql('coalesce(location, chr(32)) || chr(32) || title')}, "
        f"case when {physical_sql('location')} then 'on_site' end) as resolved, "
        f"{physical_sql('location')} as physical, case when adjacent then 'fully_remote' end as flagged from postings"
    ),
)
def remote_type(spark, sf_dir):
    c = F.col
    return postings(spark, sf_dir).select(
        "key",
        labels.remote_type(None, c("title"), c("description")).alias("from_text"),
        labels.resolved_remote_type(c("employment_type"), c("location"), c("title")).alias("resolved"),
        labels.looks_physical(c("location")).alias("physical"),
        labels.remote_type(None, c("title"), flag=c("adjacent")).alias("flagged"),
    )


_SENIOR_TITLE = first_label("title", R.SENIORITY_RULES)


@register(
    "seniority_title",
    fx.with_postings(
        f"select key, {_SENIOR_TITLE} as by_title, coalesce(nullif({first_label('trim(seniority)', R.EXPLICIT_SENIORITY)}, ''), "
        f"{_SENIOR_TITLE}) as by_label from postings"
    ),
)
def seniority_title(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "key",
        labels.seniority(F.col("title")).alias("by_title"),
        labels.seniority(F.col("title"), F.col("seniority")).alias("by_label"),
    )


_D4 = "description"
_YEARS = (
    "list_filter(list_transform(list_concat(regexp_extract_all({d}, {a}, 1), regexp_extract_all({d}, {b}, 1)), "
    "lambda y: cast(y as int)), lambda y: y <= 25)[1]"
).format(d=_D4, a=re2(labels._MINIMUM_YEARS), b=re2(labels._YEARS_OF))


@register(
    "seniority_from_text",
    fx.with_postings(
        f"select key, case when description is null then null when {hit(_D4, labels._ENTRY_TEXT)} then 'entry' "
        f"when {_YEARS} >= 10 then 'principal' when {_YEARS} >= 8 then 'staff' when {_YEARS} >= 5 then 'senior' "
        f"when {_YEARS} >= 2 then 'mid' when {_YEARS} >= 0 then 'entry' end as level from postings"
    ),
)
def seniority_from_text(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "key", labels.seniority_from_text(F.col("description")).alias("level")
    )


# --------------------------------------------------------------------------------- pay


@register("salary_usd", fx.with_postings(f"select key, {USD} as usd from postings"))
def usd(spark, sf_dir):
    return postings(spark, sf_dir).select("key", F.col("salary_usd").alias("usd"))


_V = "(salary_min / case ord % 4 when 0 then 1 when 1 then 2000 when 2 then 100000 else 0.01 end)"


def _plausible(v: str) -> str:
    return f"({v} > 0 and {v} / cast({RATE} as double) between {currency_rules.MIN_ANNUAL_USD} and {currency_rules.MAX_ANNUAL_USD})"


@register(
    "annualise_structured",
    fx.with_postings(
        f"select key, case when {_plausible(_V)} then floor({_V} + 0.5) when {_V} >= 8 and "
        f"{_plausible(f'floor({_V} * 2080 + 0.5)')} then floor({_V} * 2080 + 0.5) end as annual from postings"
    ),
)
def annualise_structured(spark, sf_dir):
    m = F.col("ord") % 4
    v = F.col("salary_min") / F.when(m == 0, 1).when(m == 1, 2000).when(m == 2, 100000).otherwise(0.01)
    return postings(spark, sf_dir).select("key", pay.annualise(v, F.col("salary_currency")).alias("annual"))


@register("salary_parse")
def salary_parse(spark, sf_dir):
    df = pay.with_salary(postings(spark, sf_dir).select("key", "description"), "description")
    return df.select("key", "parsed_pay.min", "parsed_pay.max", "parsed_pay.currency")


PAY_SUMMARIES = ["$120K – $150K", "€90,000", "£1.2M • Offers Equity", "Competitive", "$5K", "$95.5K - 110000", "", None]
scalar(
    "pay_summary", PAY_SUMMARIES, lambda c: pay.pay_in_summary(c)["max"],
    "floor(list_max(list_filter(list_transform(regexp_extract_all(raw, '([\\d,]+(?:\\.\\d+)?\\s*[KkMm]?)', 1), "
    "lambda t: coalesce(try_cast(regexp_replace(t, '[,\\sKkMm]', '', 'g') as double), 0) * case when regexp_matches(t, '[Kk]$') "
    "then 1000 when regexp_matches(t, '[Mm]$') then 1000000 else 1 end), lambda n: n between 10000 and 2000000)) + 0.5)",
)


@register(
    "age_days",
    fx.with_postings(
        f"select key, cast(floor((epoch(timestamp '{fx.NOW}') - epoch(posted_at)) / 86400) as bigint) as age from postings"
    ),
)
def age_days(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "key", dates.age_days(F.col("posted_at"), F.lit(fx.NOW).cast("timestamp_ntz")).alias("age")
    )


POSTED = (
    "select o_orderkey as id, o_orderdate, case o_orderkey % 10 when 0 then 'Posted Today' when 1 then 'Just posted' "
    "when 2 then 'Posted Yesterday' when 3 then 'Posted 30+ Days Ago' "
    "when 4 then 'Posted ' || cast(o_custkey % 29 as string) || ' Days Ago' "
    "when 5 then cast(1 + o_custkey % 5 as string) || ' weeks ago' when 6 then cast(1 + o_custkey % 11 as string) || ' months ago' "
    "when 7 then cast(1 + o_custkey % 20 as string) || ' hours ago' "
    "when 8 then 'on ' || cast(cast(o_orderdate as date) as string) else '4/' || cast(1 + o_custkey % 30 as string) || '/2001' end as raw "
    "from orders"
)


@register(
    "posted_on_relative",
    f"with src as ({POSTED}), t as (select *, timestamp '2001-08-02 09:30:00' as n, timestamp '2001-08-02 00:00:00' as d, "
    "cast(nullif(regexp_extract(raw, '(\\d+)', 1), '') as int) as k from src) "
    "select id, case when raw in ('Posted Today', 'Just posted') then d when raw = 'Posted Yesterday' then d - interval '1' day "
    "when raw like '%+ Days%' or raw like '%Days Ago' then n - k * interval '1' day when raw like '%weeks%' then d - 7 * k * interval '1' day "
    "when raw like '%months%' then d - 30 * k * interval '1' day when raw like '%hours%' then d "
    "when raw like 'on %' then o_orderdate else strptime(raw, '%m/%d/%Y') end as posted_at from t",
)
def posted_on_relative(spark, sf_dir):
    now = F.lit("2001-08-02 09:30:00").cast("timestamp_ntz")
    return fx.from_sql(spark, sf_dir, POSTED, "orders").select(
        "id", dates.posted_on(F.col("raw"), now).alias("posted_at")
    )


STAMPS = (
    "select o_orderkey as id, o_orderdate, case o_orderkey % 6 "
    "when 0 then cast(cast(o_orderdate as date) as string) "
    "when 1 then cast(cast(o_orderdate as date) as string) || 'T00:00:00.000' "
    "when 2 then cast(cast(o_orderdate as date) as string) || ' 00:00' "
    "when 3 then cast(cast(o_orderdate as date) as string) || 'T02:00:00+02:00' "
    "when 4 then cast(cast(o_orderdate as date) as string) || 'T00:00:00Z' else 'soon' end as raw from orders"
)


@register(
    "parse_date",
    f"with src as ({STAMPS}) select id, case when raw <> 'soon' then o_orderdate end as from_text, "
    "o_orderdate as from_epoch from src",
)
def parse_date(spark, sf_dir):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    # Ten-digit numbers are seconds; thirteen-digit ones are milliseconds.
    n = F.when((F.col("id") % 2 == 0), seconds).otherwise(seconds * 1000)
    n = F.when(seconds * 1000 < 1_000_000_000_000, seconds).otherwise(n)
    return fx.from_sql(spark, sf_dir, STAMPS, "orders").select(
        "id", dates.from_text(F.col("raw")).alias("from_text"), dates.from_epoch(n).alias("from_epoch")
    )


# ------------------------------------------------------------------------- keys and fit

_NUM = "case when {c} = floor({c}) then cast(cast({c} as decimal(38,0)) as varchar) else cast({c} as varchar) end"


@register(
    "content_hash",
    fx.with_postings(
        "select key, sha256(title || coalesce(description, '') || coalesce(location, '') || "
        "coalesce(cast(cast(floor(salary_min) as bigint) as varchar), '') || coalesce(cast(cast(floor(salary_max) as bigint) as varchar), '') || "
        "coalesce(employment_type, '')) as hash from postings"
    ),
)
def content_hash(spark, sf_dir):
    c = F.col
    return postings(spark, sf_dir).select(
        "key",
        text.content_hash(
            c("title"), c("description"), c("location"), F.floor(c("salary_min")).cast("double"),
            F.floor(c("salary_max")).cast("double"), c("employment_type"),
        ).alias("hash"),
    )


@register(
    "identity_hash",
    fx.with_postings(
        "select key, sha256(board_token || trim(regexp_replace(regexp_replace(lower(title), "
        + quote(r"\((remote|hybrid|on[- ]?site|m/f/d|f/m/d|w/m/d)\)")
        + ", ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) || coalesce(trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g')), '')) as hash from postings"
    ),
)
def identity_hash(spark, sf_dir):
    c = F.col
    return postings(spark, sf_dir).select(
        "key", text.identity_hash(c("board_token"), c("title"), c("location")).alias("hash")
    )


@register("stack_of", fx.with_postings(f"select key, {STACK} as stack from postings"))
def stack_of(spark, sf_dir):
    return postings(spark, sf_dir).select("key", classify.stack_of(F.col("matched_skills")).alias("stack"))


_HAVE = "list_filter(matched_skills, lambda s: lower(s) in ('python', 'sql', 'kubernetes', 'aws', 'apis'))"
_MISS = "list_filter(matched_skills, lambda s: lower(s) not in ('python', 'sql', 'kubernetes', 'aws', 'apis'))"
_MINE = ["python", "SQL", "Kubernetes", "AWS", "apis"]


@register(
    "fit_score",
    fx.with_postings(
        f"select key, len(matched_skills) > 0 as fit_known, len(matched_skills) as fit_basis, "
        f"case when len(matched_skills) > 0 then len({_HAVE}) / len(matched_skills) else 0.5 end as fit, "
        f"case when len(matched_skills) > 0 then len({_HAVE}) / len(matched_skills) * least(1.0, len(matched_skills) / 5) else 0 end as fit_confidence, "
        f"array_to_string({_HAVE}, '|') as have, array_to_string({_MISS}, '|') as missing from postings"
    ),
)
def fit_score(spark, sf_dir):
    df = with_fit(postings(spark, sf_dir), F.array(*map(F.lit, _MINE)))
    return df.select(
        "key", "fit_known", "fit_basis", "fit", "fit_confidence",
        F.array_join("fit_have", "|").alias("have"), F.array_join("fit_missing", "|").alias("missing"),
    )


from boardwalk.operators import feed as feed_ops  # noqa: E402
from checks.feed import DEFAULT, query  # noqa: E402


@register(
    "feed_min_fit",
    fx.with_postings(
        f"select key from postings where {DEFAULT} and (len(matched_skills) = 0 or "
        f"len({_HAVE}) / len(matched_skills) >= 0.5)"
    ),
)
def feed_min_fit(spark, sf_dir):
    rows = feed_ops.filtered(postings(spark, sf_dir), query(skills=tuple(_MINE), min_fit=0.5))
    return rows.select("key")


@register(
    "feed_sort_fit",
    fx.with_postings(
        f"select key from postings where {DEFAULT} order by case when len(matched_skills) > 0 then "
        f"len({_HAVE}) / len(matched_skills) * least(1.0, len(matched_skills) / 5) else -1 end desc, key limit 50"
    ),
)
def feed_sort_fit(spark, sf_dir):
    return feed_ops.page(postings(spark, sf_dir), query(skills=tuple(_MINE), sort="fit")).select("key")


# --------------------------------------------------------------------------- discovery

COMPANIES = [
    "JPMorgan Chase", "Acme Technologies, Inc.", "The North Face", "Bank of America", "M&T Bank", "AT&T",
    "First National Health Systems", "O'Reilly Media", "Zürich Insurance Group", "3M", "X", "United Parcel Service",
]
SLUG_INPUT = (
    "select c_custkey as id, case c_custkey % 3 when 0 then v.raw || ' ' || cast(c_custkey % 40 as string) else v.raw end as raw "
    f"from customer join (values {fx._values([(c,) for c in COMPANIES])}) as v(i, raw) on v.i = c_custkey % {len(COMPANIES)}"
)


def _slug_sql() -> str:
    alias = case(
        (
            (f"trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) = {quote(k)}", "[" + ", ".join(map(quote, v)) + "]")
            for k, v in slug_rules.ALIASES.items()
        ),
        "cast([] as varchar[])",
    )
    squeeze = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    base = squeeze.format(x="regexp_replace(replace(lower(raw), '&', ' and '), '[^a-z0-9\\s-]', ' ', 'g')")
    return (
        f"a as (select id, {alias} as known, {base} as base from src), "
        f"b as (select *, {squeeze.format(x=f'regexp_replace(base, {re2(slug_rules.NOISE)}, chr(32), chr(103))').replace('chr(32)', quote('')).replace('chr(103)', quote('g'))} as less from a), "
        f"c as (select *, {squeeze.format(x=f'regexp_replace(less, {re2(slug_rules.SECTOR_WORDS)}, {quote('')}, {quote('g')})')} as bare from b), "
        "d as (select *, list_filter([base, less, bare], lambda v: length(v) > 0) as forms from c), "
        "e as (select id, list_concat(known, list_concat(list_transform(forms, lambda v: regexp_replace(v, '[\\s-]', '', 'g')), "
        "list_concat(list_transform(forms, lambda v: regexp_replace(v, '\\s+', '-', 'g')), "
        "list_concat(list_filter(list_transform(forms, lambda v: string_split(v, ' ')[1]), lambda w: length(w) >= 4), "
        "list_transform(list_filter(forms, lambda v: len(string_split(v, ' ')) between 2 and 4), "
        "lambda v: array_to_string(list_transform(string_split(v, ' '), lambda w: w[1]), '')))))) as every from d), "
        "f as (select id, list_filter(every, lambda c: length(c) between 2 and 60) as usable from e), "
        "g as (select id, list_filter(usable, lambda c, i: list_position(usable, c) = i) as slugs from f)"
    )


@register(
    "slug_candidates",
    f"with src as ({SLUG_INPUT}), {_slug_sql()} select id, unnest(slugs) as slug, unnest(range(1, len(slugs) + 1)) as rank from g",
)
def slug_candidates(spark, sf_dir):
    df = fx.from_sql(spark, sf_dir, SLUG_INPUT, "customer")
    out = df.select("id", F.posexplode(slugs.slug_candidates(F.col("raw"))).alias("pos", "slug"))
    return out.select("id", "slug", (F.col("pos") + 1).alias("rank"))


@register(
    "name_repair",
    "with src as (select c_custkey as id, 'acme-corp' || cast(c_custkey % 7 as string) as token, case c_custkey % 4 when 0 then null "
    "when 1 then 'Acme Corp' || cast(c_custkey % 7 as string) when 2 then 'ACME-CORP' || cast(c_custkey % 7 as string) else c_name end as current, "
    "case c_custkey % 5 when 0 then '' when 1 then 'acme-corp' || cast(c_custkey % 7 as string) else c_name end as found from customer) "
    "select id, case when (current is null or lower(current) = lower(token) or lower(current) = lower(replace(token, '-', ' '))) "
    "and found <> '' and lower(found) <> lower(token) and (current is null or found <> current) then found else current end as company from src",
)
def name_repair(spark, sf_dir):
    df = fx.from_sql(
        spark, sf_dir,
        "select c_custkey as id, 'acme-corp' || cast(c_custkey % 7 as string) as token, case c_custkey % 4 when 0 then null "
        "when 1 then 'Acme Corp' || cast(c_custkey % 7 as string) when 2 then 'ACME-CORP' || cast(c_custkey % 7 as string) else c_name end as current, "
        "case c_custkey % 5 when 0 then '' when 1 then 'acme-corp' || cast(c_custkey % 7 as string) else c_name end as found from customer",
        "customer",
    )
    return df.select("id", text.repaired_name(F.col("current"), F.col("found"), F.col("token")).alias("company"))


# -------------------------------------------------------------------------------- html


@register("html_to_text")
def html_to_text(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages")
    return pages.select("page_id", text.strip_html(F.col("html")).alias("text"))


# Entities of every kind, some of them escaped twice, planted in whole pages.
_ENTITY = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"
_PLANTED = (
    "select page_id, replace(replace(replace(html, '&middot;', '&#183;&eacute;&nosuch;'), '<p>', '&amp;lt;p&amp;gt;&#x41;&#X;'), '</p>', '&amp;amp;amp;copy; & &') as raw from pages"
)


def _decoded_sql(column: str) -> str:
    """DuckDB: one pass over the entities, from left to right; numbers up to six digits."""
    named = " ".join(f"when {quote('&' + k + ';')} then {quote(v)}" for k, v in label_rules.ENTITIES.items())
    return (
        f"array_to_string(list_transform(regexp_extract_all({column}, '{_ENTITY}|&|[^&]+'), lambda e: case e {named} else "
        "case when regexp_matches(e, '^&#[0-9]{1,6};$') then chr(cast(e[3:-2] as int)) "
        "when regexp_matches(e, '^&#x[0-9a-fA-F]{1,4};$') then chr(cast('0x' || e[4:-2] as int)) else e end end), '')"
    )


@register(
    "entity_decode",
    f"with s as ({_PLANTED}), a as (select page_id, {_decoded_sql('raw')} as x from s), b as (select page_id, {_decoded_sql('x')} as x from a) "
    f"select page_id, {_decoded_sql('x')} as text from b",
)
def entity_decode(spark, sf_dir):
    df = fx.from_sql(spark, sf_dir, _PLANTED, "pages")
    return df.select("page_id", text.decode_entities(F.col("raw")).alias("text"))


URL_HOSTS = [
    "https://boards.greenhouse.io/{t}/jobs/1", "https://boards-api.greenhouse.io/v1/boards/{t}/jobs",
    "https://jobs.lever.co/{t}/abc", "https://api.lever.co/v0/postings/{t}?mode=json",
    "https://jobs.ashbyhq.com/{t}", "https://apply.workable.com/{t}/j/9", "https://apply.workable.com/api/v1/widget/accounts/{t}",
    "https://careers-{t}.icims.com/jobs/5", "https://www.icims.com/", "https://jobs.smartrecruiters.com/{t}/77",
    "https://{t}.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/3", "https://{t}.fa.us2.oraclecloud.com/x",
    "https://{t}.eightfold.ai/careers?domain={t}.com", "https://{t}.eightfold.ai/careers", "https://{t}.breezy.hr/p/1",
    "https://{t}.jobs.personio.de/job/2", "https://{t}.wd5.myworkdayjobs.com/en-US/External", "https://{t}.taleo.net/a",
    "https://acme.com/careers?gh_jid=5", "https://acme.com/jobs?lever-origin=x", "https://{t}.example.com/jobs", "not a url",
]
URL_INPUT = (
    "select o_orderkey as id, replace(v.raw, '{t}', 'co' || cast(o_custkey % 90 as string)) as url from orders "
    f"join (values {fx._values([(u,) for u in URL_HOSTS])}) as v(i, raw) on v.i = o_orderkey % {len(URL_HOSTS)}"
)
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
_PATH = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '/'), lambda p: length(p) > 0)"
_UNSUPPORTED = url_rules.KNOWN_UNSUPPORTED
RESOLVE_SQL = f"""
h as (select id, url, {_HOST} as host, {_PATH} as parts from src),
s as (select *, case
    when regexp_matches(host, '(^|\\.)(boards|job-boards)\\.greenhouse\\.io$') then ['greenhouse', parts[1]]
    when host = 'boards-api.greenhouse.io' then ['greenhouse', parts[4]]
    when host = 'jobs.lever.co' then ['lever', parts[1]] when host = 'api.lever.co' then ['lever', parts[3]]
    when host = 'jobs.ashbyhq.com' then ['ashby', parts[1]]
    when host = 'apply.workable.com' then ['workable', case when parts[1] = 'api' then parts[5] else parts[1] end]
    when host like '%.icims.com' and host not in ('www.icims.com', 'careers.icims.com')
      then ['icims', regexp_replace(regexp_replace(host, '\\.icims\\.com$', ''), '^(careers|jobs)-', '')]
    when regexp_matches(host, '(^|\\.)(jobs|careers)\\.smartrecruiters\\.com$') then ['smartrecruiters', parts[1]]
    when regexp_matches(host, '\\.fa\\.[a-z0-9-]+\\.oraclecloud\\.com$') and list_position(parts, 'sites') > 0
      then ['oracle', string_split(host, '.')[1]]
    when host like '%.eightfold.ai' and url like '%domain=%' then ['eightfold', replace(host, '.eightfold.ai', '')]
    when host like '%.breezy.hr' then ['breezy', replace(host, '.breezy.hr', '')]
    when host like '%.jobs.personio.de' then ['personio', replace(host, '.jobs.personio.de', '')]
  end as b from h),
r as (select *, case when b is not null then b[1] when regexp_matches(url, '[?&](gh_jid|gh_src)=') then 'greenhouse_embedded'
    when regexp_matches(url, '[?&]lever-origin=') then 'lever_embedded'
    else {case((hit('host', p, False), quote(n)) for p, n, _ in _UNSUPPORTED)} end as platform from s),
v as (select id, case when b is not null then 'supported' when platform is not null then 'unsupported' else 'unknown' end as status,
  platform, case when b is not null then 'supported' when platform like '%embedded' then 'json_api_unbuilt' when platform is not null
    then {case((hit('host', p, False), quote(t)) for p, _, t in _UNSUPPORTED)} else 'unknown' end as tier,
  b[2] as token, case when host = '' then url else host end as host, b[1] as provider from r)
"""


@register("url_resolve", f"with src as ({URL_INPUT}), {RESOLVE_SQL} select id, status, platform, tier, token, host from v")
def url_resolve(spark, sf_dir):
    df = fx.from_sql(spark, sf_dir, URL_INPUT, "orders")
    df = df.select("id", urls.resolve_url(F.col("url")).alias("r"))
    return df.select("id", "r.status", "r.platform", "r.tier", "r.token", "r.host")
