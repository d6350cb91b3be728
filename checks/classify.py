"""Role classification: every verdict over the whole postings table."""

from pyspark.sql import functions as F

from boardwalk.operators import classify as ops
from boardwalk.operators import score as score_ops
from boardwalk.rules import adjacent as A
from boardwalk.rules import families as R
from boardwalk.rules import scoring as C
from boardwalk.rules import sector as S
from boardwalk.rules import skills as K
from boardwalk.rules import specializations as P
from checks import fixtures as fx
from checks.feed import heavy_postings as postings
from checks.registry import register
from checks.sqltext import case, first_label, hit, in_list, quote

ORDER = ("hris", "data", "cloud", "software")
TABLES = {"hris": K.HRIS_SKILLS, "data": K.DATA_SKILLS, "cloud": K.CLOUD_SKILLS, "software": K.SOFTWARE_SKILLS}


def names_sql(hay: str, table) -> str:
    parts = ", ".join(f"case when {hit(hay, p)} then {quote(n)} end" for p, n, _ in table)
    return f"list_filter([{parts}], lambda x: x is not null)"


def score_sql(hay: str, table) -> str:
    return "(" + " + ".join(f"case when {hit(hay, p)} then {w} else 0 end" for p, _, w in table) + ")"


def prepared() -> str:
    """CTEs up to the title-only verdicts and skill scores."""
    scores = ", ".join(f"{score_sql('hay', TABLES[f])} as {f}_s" for f in ORDER)
    names = ", ".join(f"{names_sql('hay', TABLES[f])} as {f}_n" for f in ORDER)
    it = f"({hit('title', A.IT_ACRONYM, False)} or {hit('hay', A.IT_SIGNAL)})"
    adjacent_pairs = []
    for category, pattern, _ in A.RULES:
        cond = hit("trim(m)", pattern)
        adjacent_pairs.append((f"{cond} and {it}" if category == "systems_engineering" else cond, quote(category)))
    veto = " or ".join(hit("title", p) for p in (A.NEVER_ADJACENT, A.HARDWARE_ENGINEERING, A.NOT_A_TECH_ROLE))
    return f"""
t0 as (select *, title || ' ' || coalesce(description, '') as hay,
  coalesce(description, '') as body,
  replace(regexp_replace(title, '(?i)\\bengineering\\b', 'engineer', 'g'), '-', ' ') as m from postings),
t1 as (select *, {scores}, {names}, {first_label('title', R.HARD_EXCLUSIONS)} as hard,
  {first_label('title', R.SOFT_EXCLUSIONS)} as soft, {hit('title', R.ENGINEERING_ROLE)} as eng,
  case when not ({veto}) then {case(adjacent_pairs)} end as adj from t0),
t2 as (select *, coalesce(hard, case when not eng then soft end) as reason from t1),
"""


def family_ctes() -> str:
    production = hit("m", R.PRODUCTION_ENGINEER)
    qualified = f"(not {hit('m', R.PRODUCTION_MANUFACTURING)} and ({hit('m', R.PRODUCTION_TECHNICAL)} or cloud_s > 0))"
    other = hit(f"regexp_replace(m, '(?i)\\bproduction\\s+engineer\\b', '')", R.CLOUD_TITLES)
    titles = {
        "hris": f"{hit('m', R.HRIS_TITLES)} and not ({hit('m', R.HRIS_EXCLUSIONS)} or ({hit('m', R.HRIS_PRODUCTS)} and {hit('m', R.HRIS_NON_HR_MODULE)}))",
        "testing": f"{hit('m', R.TESTING_TITLES)} and not ({hit('m', R.NOT_TESTING)} or {hit('m', R.TESTING_NONSOFTWARE)})",
        "networking": f"{hit('m', R.NETWORKING_TITLES)} and not ({hit('m', R.NOT_NETWORKING)} or {hit('m', R.NETWORKING_HARDWARE)})",
        "data": hit("m", R.DATA_TITLES),
        "cloud": f"{hit('m', R.CLOUD_TITLES)} and not ({hit('m', R.CLOUD_TITLE_NOISE)} or {hit('m', R.NOT_INFOSEC)} or ({production} and not {qualified} and not {other}))",
        "software": f"{hit('m', R.SOFTWARE_TITLES)} and not (({hit('m', chr(92) + 'barchitect' + chr(92) + 'b')} and {hit('m', R.NOT_SOFTWARE_ARCHITECT)}) or ({hit('m', R.ENGINEERING_LEADERSHIP)} and {hit('m', R.NOT_SOFTWARE_ENG_MANAGER)}))",
    }
    tf = case((titles[f], quote(f)) for f in R.TITLE_ORDER)

    def best(exclude: str, beat: str) -> str:
        items = ", ".join(
            f"case when {f}_s >= 5 and {f}_s > {beat} and ({exclude} is null or {exclude} <> '{f}') then "
            f"{{'s': -{f}_s, 'o': {i}, 'f': '{f}'}} end"
            for i, f in enumerate(R.STACK_FAMILIES)
        )
        return f"list_sort(list_filter([{items}], lambda x: x is not null))[1]"

    own = case(((f"tf = '{f}'", f"{f}_s") for f in ORDER), "0")
    return f"""
t3 as (select *, case when reason is null then {tf} end as tf from t2),
t4 as (select *, {own} as own from t3),
t5 as (select *, case when tf in ('data','cloud','software') then {best('tf', 'case when own < 5 then own else own * 2 end')} end as oth,
  case when tf is null and reason is null then {best('null', '0')} end as bst from t4),
t6 as (select *, coalesce(oth is not null and (own < 5 or -oth.s - own >= 8), false) as over_,
  reason is null and tf is null and bst is null and not {hit('m', R.CLOUD_TITLE_NOISE)} and {hit('m', R.CLOUD_TITLES_LOOSE)} as loose from t5),
t7 as (select *, case when over_ then oth.f when tf is not null then tf when bst is not null then bst.f when loose then 'cloud' end as fam,
  (tf is not null and not over_) or loose as title_matched,
  reason is null and ({hit('title', R.AI_TITLE)} or {hit('body', R.AI_BODY_STRONG)}) as ai_ from t6),
t8 as (select *, {case(((f"fam = '{f}'", f"{f}_s") for f in ORDER), "0")} as score,
  {case(((f"fam = '{f}'", f"array_to_string({f}_n, '|')") for f in ORDER), "''")} as own_skills,
  case when fam is not null then array_to_string(list_concat(hris_n, list_concat(data_n, list_concat(cloud_n, software_n))), '|') else '' end as all_skills from t7)
"""


CLASSIFIED = prepared() + family_ctes()


def base(spark, sf_dir):
    keep = ["key", "company", "board_token", "title", "description"]
    return postings(spark, sf_dir).select(*keep)


@register(
    "classify_role",
    fx.with_postings_cte(
        CLASSIFIED,
        "select key, fam as family, score, own_skills, all_skills, title_matched, ai_ as ai, reason as excluded_reason from t8",
    ),
)
def classify_role(spark, sf_dir):
    df = ops.with_family(base(spark, sf_dir))
    return df.select(
        "key", "family", "score", F.array_join("matched_skills", "|").alias("own_skills"),
        F.array_join("all_skills", "|").alias("all_skills"), "title_matched", "ai", "excluded_reason",
    )


_EVIDENCE = "list_sort(list_filter([" + ", ".join(
    f"case when {f}_s > 0 then {{'s': -{f}_s, 'o': {i}, 'f': '{f}'}} end" for i, f in enumerate(ORDER)
) + "], lambda x: x is not null))[1]"
_FALLBACK = case((f"adj = {quote(c)}", quote(f)) for c, _, f in A.RULES)
_REVIEW = (
    "not (" + " or ".join(hit("title", p) for p in (A.NEVER_UNSORTED, A.PHYSICAL_SECURITY, A.NOT_OUR_WORLD)) + ") and ("
    + hit("title", A.LOOKS_TECHNICAL) + " or greatest(hris_s, data_s, cloud_s, software_s) > 0)"
)
FINAL = f"""{CLASSIFIED},
t9 as (select *, {_EVIDENCE} as ev, case when fam is null or {hit('title', A.FORCE_ADJACENT)} then adj end as cat from t8),
t10 as (select *, case when cat is not null then case when cat in ('hris_platform', 'hris_operations') then 'hris'
  else coalesce(ev.f, {_FALLBACK}) end end as adj_family,
  fam is null and cat is null and reason is null and {_REVIEW} as review from t9),
t11 as (select *, coalesce(fam, adj_family, case when review then 'unsorted' end) as final from t10)
"""


@register(
    "adjacent",
    fx.with_postings_cte(
        FINAL,
        "select key, fam as core_family, final as family, cat is not null as adjacent, cat as adjacent_category, adj_family as adjacent_family, "
        f"case when cat is null then null when cat = 'hris_platform' and {hit('title', R.HRIS_NON_HR_MODULE)} then 'Adjacent (hris_platform); HR platform, non-HR module' "
        "when cat = 'hris_platform' then 'Adjacent (hris_platform); vendor product outside the core rules' "
        "when cat = 'hris_operations' then 'Adjacent (hris_operations); payroll or benefits management, not systems' "
        "when ev is not null then 'Adjacent (' || cat || '); description scored ' || cast(-ev.s as varchar) || ' for ' || ev.f "
        f"else 'Adjacent (' || cat || '); no description evidence, filed under ' || {_FALLBACK} end as adjacent_reason, "
        "case when final is null then coalesce(reason, 'no family matched') end as excluded_reason from t11",
    ),
)
def adjacent(spark, sf_dir):
    return ops.classify_postings(base(spark, sf_dir)).select(
        "key", "core_family", "family", "adjacent", "adjacent_category", "adjacent_family", "adjacent_reason",
        "excluded_reason",
    )


@register("review_pile", fx.with_postings_cte(FINAL, "select key, title from t11 where final = 'unsorted'"))
def review_pile(spark, sf_dir):
    return ops.review_pile(base(spark, sf_dir)).select("key", "title")


@register(
    "skill_scores",
    fx.with_postings_cte(
        prepared().rstrip().rstrip(","),
        "select key, hris_s as hris_score, data_s as data_score, cloud_s as cloud_score, software_s as software_score from t2",
    ),
)
def skill_scores(spark, sf_dir):
    return ops.skill_scores(base(spark, sf_dir)).select(
        "key", "hris_score", "data_score", "cloud_score", "software_score"
    )


_EVERY = "list_distinct"
_EXTRACT = " || ".join(names_sql("coalesce(description, '')", TABLES[f]) for f in ("cloud", "software", "data", "hris"))


@register(
    "skill_extract",
    fx.with_postings(f"select key, array_to_string({_EXTRACT}, '|') as skills from postings"),
)
def skill_extract(spark, sf_dir):
    df = ops.extract_skills(base(spark, sf_dir), "description")
    return df.select("key", F.array_join(F.coalesce("skills", F.array()), "|").alias("skills"))


VOCABULARY = [
    ("latin", r"\b(que|les|des)\b", "French words", 2), ("latin", r"\b(aux|eau)\b", "French words", 3),
    ("latin", r"\bpour\b", "Purpose", 1), ("german", r"\b(und|nicht|für)\b", "German words", 4),
    ("german", r"\b(der|die|das)\b", "Articles", 1), ("english", r"\b(the|and)\b", "English words", 2),
    ("english", r"\bwith\b", "With", 1),
]
_VOCAB_HITS = " union all ".join(
    f"select doc_id, {quote(f)} as family, {quote(c)} as canonical, {w} as weight from documents where {hit('text', p)}"
    for f, p, c, w in VOCABULARY if "ü" not in p
)


@register(
    "dictionary_match",
    f"select doc_id, family, cast(sum(weight) as bigint) as score, count(*) as skills from (select doc_id, family, canonical, max(weight) as weight "
    f"from ({_VOCAB_HITS}) group by 1, 2, 3) group by 1, 2",
)
def dictionary_match(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents")
    rows = [r for r in VOCABULARY if "ü" not in r[1]]
    table = spark.createDataFrame(rows, "family string, pattern string, canonical string, weight int")
    return ops.match_dictionary(docs, table, "doc_id", "text")


# One rule for each word of the texts, and one for each beginning of a longer word: tens of thousands.
_DICT_TOKENS = "select distinct doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) as w from documents"
_DICT_HITS = (
    f"with t as ({_DICT_TOKENS}), h as (select doc_id, left(w, 1) as family, w as canonical, length(w) as weight from t where length(w) >= 3 "
    "union select doc_id, 'plural' as family, left(w, 5) as canonical, 2 as weight from t where length(w) >= 6 and w like '%s')"
)


@register(
    "dictionary_wide",
    f"{_DICT_HITS} select doc_id, family, cast(sum(weight) as bigint) as score, count(*) as skills from h group by 1, 2",
)
def dictionary_wide(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents")
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    words = docs.select(word.alias("w")).select(F.lower("w").alias("w")).distinct()
    each = words.where(F.length("w") >= 3).select(
        F.left("w", F.lit(1)).alias("family"), F.concat(F.lit(r"\b"), "w", F.lit(r"\b")).alias("pattern"),
        F.col("w").alias("canonical"), F.length("w").alias("weight"),
    )
    stem = F.left("w", F.lit(5))
    plural = words.where(F.length("w") >= 6).select(
        F.lit("plural").alias("family"), F.concat(F.lit(r"\b"), stem, F.lit(r"\w*s\b")).alias("pattern"),
        stem.alias("canonical"), F.lit(2).alias("weight"),
    )
    return ops.match_dictionary(docs, each.unionByName(plural), "doc_id", "text")


# ---------------------------------------------------------------------- specialization


def spec_sql(family: str) -> str:
    def norm(x: str) -> str:
        return (
            f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\bengineering\\b', 'engineer', 'g'), "
            "'[.\\-_/]', ' ', 'g'), '\\s+', ' ', 'g'))"
        )

    by_title = case(
        (f"fam_ = '{f}'", case((hit("st", p, False), quote(s)) for s, p, _ in table)) for f, table in P.RULES.items()
    )
    ranked = case(
        (
            f"fam_ = '{f}'",
            "list_sort([" + ", ".join(
                "{'n': -(" + " + ".join(f"cast({hit('sb', t, False)} as int)" for t in terms) + f"), 'o': {i}, 'id': {quote(s)}, 'l': {quote(P.LABELS[s])}}}"
                for i, (s, _, terms) in enumerate(table)
            ) + "])",
        )
        for f, table in P.RULES.items()
    )
    generic = case(((f"fam_ = '{f}'", hit("st", p, False)) for f, p in P.GENERIC_TITLE.items()), "false")
    noun = case((f"fam_ = '{f}'", quote(n)) for f, n in P.FAMILY_NOUN.items())
    general = case((f"fam_ = '{f}'", quote(s)) for f, s in P.GENERAL.items())
    label = case((f"bt = {quote(k)}", quote(v)) for k, v in P.LABELS.items())
    return f"""
s0 as (select *, {family} as fam_, {norm('title')} as st, {norm("coalesce(description, '')")} as sb from postings),
s1 as (select *, {by_title} as bt, {generic} as gen, {noun} as noun, {general} as general, {ranked} as rk from s0),
s2 as (select *, -rk[1].n as top, rk[2].n - rk[1].n as lead_,
  array_to_string(list_transform(list_filter(rk, lambda r: -r.n >= -rk[1].n - 1), lambda r: r.l), ', ') as tied,
  bt is null and sb <> '' and -rk[1].n >= 2 as strong from s1),
s3 as (select key, fam_, case when fam_ is null or fam_ = 'unsorted' then null when bt is not null then bt
    when strong and lead_ >= 2 then rk[1].id when gen then general end as specialization,
  case when fam_ is null then null when fam_ = 'unsorted' then 'Unsorted: awaiting review, no family assigned yet'
    when bt is not null then 'Title matched ' || {label}
    when strong and lead_ >= 2 and gen then 'Generic ' || noun || ' title; ' || rk[1].l || ' evidence found in the description'
    when strong and lead_ >= 2 then 'Description evidence for ' || rk[1].l || ' (' || cast(top as varchar) || ' terms)'
    when strong and gen then 'Generic ' || noun || ' title; competing evidence (' || tied || ') — using general'
    when strong then 'Family identified as ' || noun || ', but evidence is split between ' || tied
    when gen then 'Generic ' || noun || ' title with no specialization evidence'
    else 'Family identified as ' || noun || ', but insufficient specialization evidence' end as specialization_reason from s2)
"""


_ROTATED = "case ord % 8 when 0 then 'software' when 1 then 'cloud' when 2 then 'data' when 3 then 'hris' when 4 then 'testing' when 5 then 'networking' when 6 then 'unsorted' end"


@register(
    "specialization",
    fx.with_postings_cte(spec_sql(_ROTATED), "select key, fam_ as family, specialization, specialization_reason from s3"),
)
def specialization(spark, sf_dir):
    df = postings(spark, sf_dir).select("key", "title", "description", F.expr(_ROTATED).alias("family"))
    return ops.with_specialization(df).select("key", "family", "specialization", "specialization_reason")


@register(
    "spec_family_check",
    fx.with_postings(
        "select key, case when ord % 5 = 0 then 'cloud' else family end as family, specialization from postings where specialization is not null and not ("
        + " or ".join(
            f"(coalesce(case when ord % 5 = 0 then 'cloud' else family end, '') = '{f}' and specialization in {in_list(v)})"
            for f, v in P.SPECIALIZATIONS_BY_FAMILY.items()
        ) + ")"
    ),
)
def spec_family_check(spark, sf_dir):
    df = postings(spark, sf_dir).withColumn("family", F.when(F.col("ord") % 5 == 0, "cloud").otherwise(F.col("family")))
    return ops.specialization_violations(df).select("key", "family", "specialization")


# ------------------------------------------------------------------------------ sector

_X = "regexp_replace(description, " + quote("(?i)" + S.BOILERPLATE) + ", ' ', 'g')"


def sector_sql() -> str:
    claims = []
    for s in S.SECTOR_ORDER:
        c = hit("x", "|".join(S.STRONG[s]))
        if s in S.CASED:
            c = f"({c} or {hit('x', S.CASED[s], False)})"
        claims.append(f"case when {c} then '{s}' end")
    hints = case((f"list_contains(mt, '{s}') and {hit('nm', S.NAME_HINT[s])}", quote(s)) for s in S.SECTOR_ORDER)
    return f"""
x0 as (select key, description, {_X} as x, coalesce(company, '') || ' ' || coalesce(tok, '') as nm
  from (select *, case when ord % 3 = 0 then 'stateuniversity' when ord % 3 = 1 then 'citymuseum' else board_token end as tok from postings)),
x1 as (select *, case when coalesce(description, '') <> '' and not {hit('x', '|'.join(S.VENDOR))} then
  list_filter([{', '.join(claims)}], lambda s: s is not null) else [] end as mt from x0),
x2 as (select key, case when len(mt) > 1 then coalesce({hints}, mt[1]) else mt[1] end as sector,
  case when len(mt) > 1 then 'The advert reads as more than one, and the employer name decides'
    when len(mt) = 1 then 'The advert describes the organisation as one' end as sector_reason from x1)
"""


@register("sector", fx.with_postings_cte(sector_sql(), "select * from x2"))
def sector(spark, sf_dir):
    m = F.col("ord") % 3
    token = F.when(m == 0, "stateuniversity").when(m == 1, "citymuseum").otherwise(F.col("board_token"))
    df = postings(spark, sf_dir).withColumn("board_token", token).drop("sector")
    return ops.with_sector(df).select("key", "sector", "sector_reason")


@register(
    "quiet_title",
    fx.with_postings(
        f"select key, not regexp_matches(lower(title), {quote(ops.magnet_pattern())}) as quiet from postings"
    ),
)
def quiet_title(spark, sf_dir):
    return postings(spark, sf_dir).select("key", ops.is_quiet(F.col("title")).alias("quiet"))


@register(
    "quiet_reasons",
    fx.with_postings(
        "select key, array_to_string(list_filter(['Titled something people do not search for', "
        "case remote_type when 'on_site' then 'On-site — competition capped by geography' when 'hybrid' then 'Hybrid — commutable candidates only' end, "
        "case when provider not in ('greenhouse','lever','ashby') then 'Mid-market board — rarely syndicated' end, "
        "case when provider in ('workday','ukg') then 'Application needs an account — high drop-off' end, "
        "case when seniority in ('staff','principal','lead') then 'Staff or above — small qualified pool' end], lambda x: x is not null), '|') as reasons from postings"
    ),
)
def quiet_reasons(spark, sf_dir):
    c = F.col
    return postings(spark, sf_dir).select(
        "key",
        F.array_join(score_ops.quiet_reasons(c("provider"), c("remote_type"), c("seniority")), "|").alias("reasons"),
    )


# ------------------------------------------------------------------------------- score


def _add(flag: str, n: float) -> str:
    return f"case when {flag} then {n}e0 else 0e0 end"


def _prior(table, default):
    return case(((f"provider = '{k}'", f"{v}e0") for k, v in table.items()), f"{default}e0")


_TXT = "(title || ' ' || coalesce(description, ''))"
SCORE_SQL = f"""
sizes as (select provider, board_token, count(*) as board_size from postings group by 1, 2),
c0 as (select p.*, z.board_size, (epoch(timestamp '{fx.NOW}') - epoch(posted_at)) / 86400.0 as age,
  {hit("coalesce(location, '')", C.HUB_CITIES)} as hub, {hit(_TXT, C.NICHE_SKILLS)} as niche, {hit(_TXT, C.CREDENTIALS)} as cred,
  {hit(_TXT, C.EVERGREEN)} as evergreen, {hit(_TXT, C.STAFFING)} as staffing,
  {hit("coalesce(description, '')", chr(92) + 'bcover letter' + chr(92) + 'b')} as letter,
  {hit("coalesce(description, '')", r'\b(work sample|take[- ]home|portfolio|writing sample|assessment)\b')} as sample_
  from postings p join sizes z using (provider, board_token)),
c1 as (select *,
  greatest(0e0, least(1e0, case remote_type when 'fully_remote' then 0.12e0 when 'hybrid' then 0.68e0 when 'on_site' then 0.85e0 else 0.5e0 end
    + case when hub then -0.2e0 when remote_type in ('on_site','hybrid') then 0.1e0 else 0e0 end)) as desirability,
  greatest(0e0, least(1e0, {_prior(C.PROVIDER_DISCOVERY, 0.5)} + case when board_size <= 10 then 0.12e0 when board_size > 500 then -0.1e0 else 0e0 end)) as discovery,
  greatest(0e0, least(1e0, case when seniority = 'entry' then 0.08e0 when seniority = 'senior' then 0.6e0 when seniority in ('staff','principal') then 0.8e0
    when seniority in ('lead','director','executive') then 0.75e0 else 0.4e0 end + {_add('niche', 0.25)} + {_add('cred', 0.2)})) as qualification,
  greatest(0e0, least(1e0, {_prior(C.PROVIDER_APPLICATION, 0.4)} + {_add('letter', 0.2)} + {_add('sample_', 0.15)})) as application,
  case when age is null then 0.4e0 when age <= 3 then 1e0 when age <= 14 then 0.7e0 when age <= 45 then 0.4e0 when age <= 90 then 0.2e0 else 0.05e0 end as freshness,
  greatest(0e0, least(1e0, {_add('evergreen', 0.6)} + {_add('staffing', 0.25)} + case when age > 120 then 0.4e0 when age > 60 and salary_min is null then 0.15e0 else 0e0 end)) as ghost
  from c0),
c2 as (select *, desirability * 0.3e0 + discovery * 0.25e0 + qualification * 0.2e0 + application * 0.15e0 + freshness * 0.1e0 as weighted from c1)
"""


def scored(spark, sf_dir):
    df = postings(spark, sf_dir).drop("ghost_risk").withColumns(
        {"city": F.lit(None).cast("string"), "region": F.lit(None).cast("string")}
    )
    df = score_ops.with_board_size(df, "provider", "board_token")
    return score_ops.with_scores(df, F.lit(fx.NOW).cast("timestamp_ntz"))


@register(
    "saturation_score",
    fx.with_postings_cte(
        SCORE_SQL,
        "select key, board_size, desirability, discovery, qualification, application, freshness, "
        "cast(floor(weighted * (1e0 - ghost * 0.8e0) * 100 + 0.5) as int) as score from c2",
    ),
)
def saturation_score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "key", "board_size", "desirability", "discovery", "qualification", "application", "freshness",
        F.col("competition_score").alias("score"),
    )


@register("ghost_risk", fx.with_postings_cte(SCORE_SQL, "select key, ghost as ghost_risk from c2"))
def ghost_risk(spark, sf_dir):
    return scored(spark, sf_dir).select("key", "ghost_risk")


_REASONS = """array_to_string(list_filter([
 case remote_type when 'fully_remote' then 'Fully remote — largest applicant pool of any format'
  when 'hybrid' then 'Hybrid — applicant pool limited to commutable candidates'
  when 'on_site' then 'On-site — geographically capped competition' end,
 case when hub then 'Major tech hub — deep local applicant pool' when remote_type in ('on_site','hybrid') then 'Secondary market — thinner local competition' end,
 case when board_size <= 10 then 'Small board — low-traffic employer' when board_size > 500 then 'Very large employer — high inbound volume' end,
 case when seniority = 'entry' then 'Entry level — the most contested tier in the market' when seniority in ('staff','principal') then 'Staff/principal — small qualified population' end,
 case when niche then 'Niche technology — very few qualified applicants' end, case when cred then 'Hard credential or clearance gate' end,
 case when letter then 'Cover letter required — high human drop-off' end, case when sample_ then 'Work sample required — high human drop-off' end,
 case when age <= 3 then 'Posted within 3 days — ahead of the applicant wave' end,
 case when evergreen then 'Evergreen pipeline posting — may not be a real opening' end, case when staffing then 'Agency or staffing listing' end,
 case when age > 120 then 'Open ' || cast(cast(floor(age + 0.5) as bigint) as varchar) || ' days — stale or perpetually relisted' end],
 lambda x: x is not null), '|')"""


@register("score_reasons", fx.with_postings_cte(SCORE_SQL, f"select key, {_REASONS} as reasons from c2"))
def score_reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("key", F.array_join("reasons", "|").alias("reasons"))


@register(
    "feed_sort_score",
    fx.with_postings_cte(
        SCORE_SQL,
        "select key, cast(floor(weighted * (1e0 - ghost * 0.8e0) * 100 + 0.5) as int) as score from c2 "
        "order by score desc, key limit 50",
    ),
)
def feed_sort_score(spark, sf_dir):
    df = scored(spark, sf_dir).orderBy(F.col("competition_score").desc(), "key").limit(50)
    return df.select("key", F.col("competition_score").alias("score"))
