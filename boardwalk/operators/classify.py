"""Role family, specialization, adjacency, sector: rule tables over whole tables.

Each function takes a DataFrame with ``title`` and ``description`` and adds
columns.  Titles are judged first; the long description is only searched for rows
whose title leaves the question open.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.match import (
    any_of,
    ascii_text,
    case_sql,
    first_hit,
    folded,
    hit,
    hit_sql,
    ladder,
    matches,
    text_literal,
)
from boardwalk.functions.steps import computed, per_value
from boardwalk.operators import dictionary
from boardwalk.rules import adjacent as adjacent_rules
from boardwalk.rules import families as rules
from boardwalk.rules import quiet as quiet_rules
from boardwalk.rules import sector as sector_rules
from boardwalk.rules import skills, specializations

SKILLS = {
    "hris": skills.HRIS_SKILLS,
    "data": skills.DATA_SKILLS,
    "cloud": skills.CLOUD_SKILLS,
    "software": skills.SOFTWARE_SKILLS,
}
UNMATCHED = "no family matched"
TEXTS = ["title", "description"]


def _names(haystack: str, table) -> Column:
    """Canonical names of the skills found, in table order."""
    found = (f"if({hit_sql(haystack, p)}, {text_literal(name)}, null)" for p, name, _ in table)
    return F.expr(f"array_compact(array({', '.join(found)}))")


def _weight(names: Column, table) -> Column:
    """Summed weight of canonical names; each name counts its highest weight."""
    weights = {}
    for _, name, weight in table:
        weights[name] = max(weight, weights.get(name, 0))
    lookup = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(
        F.array_distinct(names), F.lit(0), lambda acc, n: acc + F.element_at(lookup, n)
    )


def with_skill_scores(
    df: DataFrame, haystack: str, needed: Column | None = None, prefix: str = "_"
) -> DataFrame:
    """Per family: ``<prefix><family>_names`` and ``<prefix><family>_score``."""
    none = F.array().cast("array<string>")
    names = {}
    for family, table in SKILLS.items():
        found = _names(haystack, table)
        names[f"{prefix}{family}_names"] = (
            found if needed is None else F.when(needed, found).otherwise(none)
        )
    df = computed(df, names)
    return df.withColumns(
        {
            f"{prefix}{family}_score": _weight(F.col(f"{prefix}{family}_names"), table)
            for family, table in SKILLS.items()
        }
    )


def skill_scores(df: DataFrame) -> DataFrame:
    """Skill score of every family, whatever family the posting gets."""
    hay = F.concat(
        folded(F.col("title")), F.lit(" "),
        folded(F.coalesce("description", F.lit(""))),
    )
    keep = [F.col(f"_{f}_score").alias(f"{f}_score") for f in SKILLS]
    return per_value(df, TEXTS, lambda texts: with_skill_scores(texts.withColumn("_hay", hay), "_hay").select(*TEXTS, *keep))


def extract_skills(df: DataFrame, text: str = "text") -> DataFrame:
    """All skills named anywhere in a text, in vocabulary order."""
    order = ("cloud", "software", "data", "hris")
    found = F.array_distinct(F.concat(*[_names("_text", SKILLS[f]) for f in order]))
    return per_value(df, [text], lambda texts: texts.withColumn("_text", folded(F.col(text))).withColumn("skills", found).drop("_text"))


def match_dictionary(df: DataFrame, rules_df: DataFrame, key: str, text: str) -> DataFrame:
    """Score texts against a user-supplied dictionary (family, pattern, canonical, weight) of any size."""
    return dictionary.scores(df, rules_df, key, text)


# --------------------------------------------------------------------------- family


def _title_family(m: str, cloud_score: Column) -> Column:
    """First family whose title rule matches and is not vetoed."""
    production = hit(m, rules.PRODUCTION_ENGINEER)
    qualified = ~hit(m, rules.PRODUCTION_MANUFACTURING) & (
        hit(m, rules.PRODUCTION_TECHNICAL) | (cloud_score > 0)
    )
    first_only = r"(?s)^(.*?)" + rules.PRODUCTION_ENGINEER + r"(.*)\z"
    without_production = f"regexp_replace({m}, {text_literal(first_only)}, '$1$2')"
    other_claim = hit(without_production, rules.CLOUD_TITLES)
    vetoes = {
        "hris": hit(m, rules.HRIS_EXCLUSIONS)
        | (hit(m, rules.HRIS_PRODUCTS) & hit(m, rules.HRIS_NON_HR_MODULE)),
        "testing": hit(m, rules.NOT_TESTING) | hit(m, rules.TESTING_NONSOFTWARE),
        "networking": hit(m, rules.NOT_NETWORKING) | hit(m, rules.NETWORKING_HARDWARE),
        "data": F.lit(False),
        "cloud": hit(m, rules.CLOUD_TITLE_NOISE)
        | hit(m, rules.NOT_INFOSEC)
        | (production & ~qualified & ~other_claim),
        "software": (
            hit(m, r"\barchitect\b") & hit(m, rules.NOT_SOFTWARE_ARCHITECT)
        )
        | (
            hit(m, rules.ENGINEERING_LEADERSHIP)
            & hit(m, rules.NOT_SOFTWARE_ENG_MANAGER)
        ),
    }
    titles = {
        "hris": hit(m, rules.HRIS_TITLES),
        "testing": hit(m, rules.TESTING_TITLES),
        "networking": hit(m, rules.NETWORKING_TITLES),
        "data": hit(m, rules.DATA_TITLES),
        "cloud": hit(m, rules.CLOUD_TITLES),
        "software": hit(m, rules.SOFTWARE_TITLES),
    }
    return ladder((titles[f] & ~vetoes[f], f) for f in rules.TITLE_ORDER)


def _best_of(candidates) -> Column:
    """struct(score, ord, family) of the best (able, score, family); earlier wins ties."""
    entries = [
        F.when(able, F.struct(score.alias("score"), F.lit(-i).alias("ord"), F.lit(f).alias("family")))
        for i, (able, score, f) in enumerate(candidates)
    ]
    return F.array_max(F.array_compact(F.array(*entries)))


def _strongest(exclude: Column | None, beat: Column) -> Column:
    """Best stack family above its threshold and above ``beat``."""
    candidates = []
    for family in rules.STACK_FAMILIES:
        score = F.col(f"_{family}_score")
        able = (score >= rules.SKILL_THRESHOLD) & (score > beat)
        candidates.append((able if exclude is None else able & (exclude != family), score, family))
    return _best_of(candidates)


def _prepare(df: DataFrame) -> DataFrame:
    """Text forms and every title-only verdict."""
    body = F.coalesce(F.col("description"), F.lit(""))
    df = df.withColumns({"_t": folded(F.col("title")), "_body": folded(body)})
    df = df.withColumns(
        {
            "_hay": F.concat("_t", F.lit(" "), "_body"),
            "_m": F.regexp_replace(
                F.regexp_replace("_t", r"\bengineering\b", "engineer"), "-", " "
            ),
        }
    )
    t = "_t"
    soft = F.when(~hit(t, rules.ENGINEERING_ROLE), first_hit(t, rules.SOFT_EXCLUSIONS))
    return computed(
        df,
        {
            "excluded_reason": F.coalesce(first_hit(t, rules.HARD_EXCLUSIONS), soft),
            "_adjacent": _adjacent_category(),
        },
    )


def with_family(df: DataFrame) -> DataFrame:
    """Add family, score, matched/all skills, title_matched, ai and excluded_reason."""
    return per_value(df, TEXTS, lambda texts: _public(_family(_prepare(texts), all_rows=False)))


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _family(df: DataFrame, all_rows: bool) -> DataFrame:
    open_question = F.col("excluded_reason").isNull()
    needed = open_question | F.col("_adjacent").isNotNull() if all_rows else open_question
    df = with_skill_scores(df, "_hay", needed)
    m = "_m"
    df = computed(
        df, {"_tf": F.when(open_question, _title_family(m, F.col("_cloud_score")))}
    )
    own = ladder(
        [(F.col("_tf") == f, F.col(f"_{f}_score")) for f in ("hris", *rules.STACK_FAMILIES)], F.lit(0)
    )
    df = df.withColumn("_own", own)
    stack_title = F.col("_tf").isin(rules.STACK_FAMILIES)
    weak = F.col("_own") < rules.SKILL_THRESHOLD
    beat = F.when(weak, F.col("_own")).otherwise(F.col("_own") * rules.DOMINANCE_RATIO)
    df = df.withColumns(
        {
            "_other": F.when(stack_title, _strongest(F.col("_tf"), beat)),
            "_best": F.when(F.col("_tf").isNull() & open_question, _strongest(None, F.lit(0))),
        }
    )
    overruled = F.col("_other").isNotNull() & (
        weak | (F.col("_other.score") - F.col("_own") >= rules.DOMINANCE_MARGIN)
    )
    loose = (
        open_question
        & F.col("_tf").isNull()
        & F.col("_best").isNull()
        & ~hit(m, rules.CLOUD_TITLE_NOISE)
        & hit(m, rules.CLOUD_TITLES_LOOSE)
    )
    df = df.withColumns({"_over": F.coalesce(overruled, F.lit(False)), "_loose": loose})
    by_title = F.col("_tf").isNotNull() & ~F.col("_over")
    df = computed(
        df,
        {
            "family": F.when(F.col("_over"), F.col("_other.family"))
            .when(F.col("_tf").isNotNull(), F.col("_tf"))
            .when(F.col("_best").isNotNull(), F.col("_best.family"))
            .when(F.col("_loose"), F.lit("cloud")),
            "title_matched": by_title | F.col("_loose"),
            "ai": open_question
            & (hit("_t", rules.AI_TITLE) | hit("_body", rules.AI_BODY_STRONG)),
        },
    )
    family = F.col("family")
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "score": ladder(
                [(family == f, F.col(f"_{f}_score")) for f in SKILLS], F.lit(0)
            ),
            "matched_skills": ladder([(family == f, F.col(f"_{f}_names")) for f in SKILLS], none),
            "all_skills": F.when(
                family.isNotNull(), F.array_distinct(F.concat(*[F.col(f"_{f}_names") for f in SKILLS]))
            ).otherwise(none),
        }
    )


# --------------------------------------------------------------------- specialization


def with_specialization(df: DataFrame, family: str = "family") -> DataFrame:
    """Add specialization, specialization_reason and classification_version."""
    S = specializations

    def normalise(c: Column) -> Column:
        c = F.regexp_replace(folded(c), r"\bengineering\b", "engineer")
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"[.\-_/]", " "), r"\s+", " "))

    body = F.coalesce(F.col("description"), F.lit(""))
    df = df.withColumns({"_st": normalise(F.col("title")), "_sb": normalise(body)})
    fam = F.col(family)
    by_title = ladder(
        (fam == f, first_hit("_st", [(p, spec) for spec, p, _ in table]))
        for f, table in S.RULES.items()
    )
    generic = ladder(((fam == f, hit("_st", p)) for f, p in S.GENERIC_TITLE.items()), F.lit(False))
    df = computed(df, {"_by_title": by_title, "_generic": generic})

    def ranked(table) -> Column:
        """Specializations by body hits, most first, table order on ties."""
        entries = []
        for i, (spec, _, terms) in enumerate(table):
            hits = " + ".join(f"cast({hit_sql('_sb', p)} as int)" for p in terms)
            entries.append(
                f"named_struct('neg', -({hits}), 'ord', {i}, 'id', '{spec}', "
                f"'label', {text_literal(S.LABELS[spec])})"
            )
        return F.expr(f"array_sort(array({', '.join(entries)}))")

    undecided = F.col("_by_title").isNull() & (F.length("_sb") > 0)
    df = computed(
        df,
        {"_ranked": F.when(undecided, ladder((fam == f, ranked(t)) for f, t in S.RULES.items()))},
    )
    top = F.get("_ranked", F.lit(0))
    df = df.withColumns(
        {
            "_top": -top["neg"],
            "_lead": F.get("_ranked", F.lit(1))["neg"] - top["neg"],
            "_tied": F.array_join(
                F.transform(
                    F.filter("_ranked", lambda r: -r["neg"] >= -top["neg"] - 1), lambda r: r["label"]
                ),
                ", ",
            ),
            "_noun": ladder((fam == f, noun) for f, noun in S.FAMILY_NOUN.items()),
            "_general": ladder((fam == f, spec) for f, spec in S.GENERAL.items()),
        }
    )
    strong = F.coalesce(F.col("_top") >= S.MIN_BODY_HITS, F.lit(False))
    clear = strong & (F.col("_lead") >= S.BODY_MARGIN)
    noun, is_generic = F.col("_noun"), F.col("_generic")
    label = F.expr(
        case_sql((f"_by_title = '{k}'", text_literal(v)) for k, v in S.LABELS.items())
    )
    top_label = top["label"]
    c = F.concat
    reason = (
        F.when(fam.isNull(), F.lit(None).cast("string"))
        .when(fam == "unsorted", F.lit("Unsorted: awaiting review, no family assigned yet"))
        .when(F.col("_by_title").isNotNull(), c(F.lit("Title matched "), label))
        .when(
            clear & is_generic,
            c(F.lit("Generic "), noun, F.lit(" title; "), top_label,
              F.lit(" evidence found in the description")),
        )
        .when(
            clear,
            c(F.lit("Description evidence for "), top_label, F.lit(" ("),
              F.col("_top").cast("string"), F.lit(" terms)")),
        )
        .when(
            strong & is_generic,
            c(F.lit("Generic "), noun, F.lit(" title; competing evidence ("), F.col("_tied"),
              F.lit(") — using general")),
        )
        .when(
            strong,
            c(F.lit("Family identified as "), noun, F.lit(", but evidence is split between "),
              F.col("_tied")),
        )
        .when(
            is_generic, c(F.lit("Generic "), noun, F.lit(" title with no specialization evidence"))
        )
        .otherwise(
            c(F.lit("Family identified as "), noun, F.lit(", but insufficient specialization evidence"))
        )
    )
    decided = F.coalesce(
        F.col("_by_title"),
        F.when(clear, top["id"]),
        F.when(is_generic, F.col("_general")),
    )
    df = df.withColumns(
        {
            "specialization": F.when(fam.isNotNull() & (fam != "unsorted"), decided),
            "specialization_reason": reason,
            "classification_version": F.when(fam.isNotNull(), F.lit(S.CLASSIFICATION_VERSION)),
        }
    )
    return df.drop(
        "_st", "_sb", "_by_title", "_generic", "_ranked", "_top", "_lead", "_tied", "_noun", "_general"
    )


def specialization_pairs(spark) -> DataFrame:
    """Valid (family, specialization) pairs: a fixed table."""
    rows = [(f, s) for f, specs in specializations.SPECIALIZATIONS_BY_FAMILY.items() for s in specs]
    pairs = F.array(
        *[F.struct(F.lit(f).alias("family"), F.lit(s).alias("specialization")) for f, s in rows]
    )
    return spark.range(1).select(F.inline(pairs))


def specialization_violations(df: DataFrame) -> DataFrame:
    """Rows whose specialization does not belong to their family."""
    valid = [
        F.struct(F.lit(f), F.lit(s))
        for f, specs in specializations.SPECIALIZATIONS_BY_FAMILY.items()
        for s in specs
    ]
    pair = F.struct(F.coalesce("family", F.lit("")), F.col("specialization"))
    return df.where(F.col("specialization").isNotNull() & ~pair.isin(*valid))


# --------------------------------------------------------------------------- adjacent


def _adjacent_category() -> Column:
    """Category from the title alone; systems engineering still needs an IT signal."""
    R = adjacent_rules
    t, m = "_t", "trim(_m)"
    vetoed = any_of(
        hit(t, p) for p in (R.NEVER_ADJACENT, R.HARDWARE_ENGINEERING, R.NOT_A_TECH_ROLE)
    )
    it_role = matches(ascii_text(F.col("title")), R.IT_ACRONYM, ignore_case=False) | hit("_hay", R.IT_SIGNAL)
    pairs = []
    for category, pattern, _ in R.RULES:
        found = hit(m, pattern)
        pairs.append((found & it_role if category == "systems_engineering" else found, category))
    return F.when(~vetoed, ladder(pairs))


def _with_adjacent(df: DataFrame) -> DataFrame:
    """Add adjacent_category, adjacent_family and adjacent_reason (needs ``_family``)."""
    R = adjacent_rules
    category = F.col("_adjacent")
    scores = {f: F.col(f"_{f}_score") for f in SKILLS}
    df = df.withColumn("_evidence", _best_of((s > 0, s, f) for f, s in scores.items()))
    asked = F.col("family").isNull() | hit("_t", R.FORCE_ADJACENT)
    fallback = ladder((category == name, fam) for name, _, fam in R.RULES)
    hris = category.isin("hris_platform", "hris_operations")
    family = F.when(hris, "hris").otherwise(F.coalesce(F.col("_evidence.family"), fallback))
    df = df.withColumn("adjacent_category", F.when(asked, category))
    named = F.concat(F.lit("Adjacent ("), category, F.lit("); "))
    reason = (
        F.when(
            category == "hris_platform",
            F.when(
                hit("_t", rules.HRIS_NON_HR_MODULE),
                F.concat(named, F.lit("HR platform, non-HR module")),
            ).otherwise(F.concat(named, F.lit("vendor product outside the core rules"))),
        )
        .when(
            category == "hris_operations",
            F.concat(named, F.lit("payroll or benefits management, not systems")),
        )
        .when(
            F.col("_evidence").isNotNull(),
            F.concat(
                named, F.lit("description scored "), F.col("_evidence.score").cast("string"),
                F.lit(" for "), F.col("_evidence.family"),
            ),
        )
        .otherwise(F.concat(named, F.lit("no description evidence, filed under "), fallback))
    )
    is_adjacent = F.col("adjacent_category").isNotNull()
    return df.withColumns(
        {
            "adjacent_family": F.when(is_adjacent, family),
            "adjacent_reason": F.when(is_adjacent, reason),
        }
    )


def _review_pile() -> Column:
    R = adjacent_rules
    t = "_t"
    vetoed = any_of(hit(t, p) for p in (R.NEVER_UNSORTED, R.PHYSICAL_SECURITY, R.NOT_OUR_WORLD))
    any_score = F.greatest(*[F.col(f"_{f}_score") for f in SKILLS]) > 0
    return ~vetoed & (hit(t, R.LOOKS_TECHNICAL) | any_score)


def classify_postings(df: DataFrame) -> DataFrame:
    """Full verdict: core family, else adjacent, else the review pile, else none.

    Adds core_family, family, score, matched_skills, all_skills, title_matched, ai,
    excluded_reason, adjacent (+category, reason), specialization (+reason, version).
    """
    return per_value(df, TEXTS, verdicts)


def verdicts(df: DataFrame) -> DataFrame:
    """As ``classify_postings``, worked out for every row of ``df``."""
    df = _with_adjacent(_family(_prepare(df), all_rows=True))
    is_adjacent = F.col("adjacent_category").isNotNull()
    review = (
        F.col("family").isNull()
        & ~is_adjacent
        & F.col("excluded_reason").isNull()
        & _review_pile()
    )
    df = computed(
        df,
        {
            "core_family": F.col("family"),
            "adjacent": is_adjacent,
            "_final": F.coalesce("family", "adjacent_family", F.when(review, F.lit("unsorted"))),
        },
    )
    df = with_specialization(df, "core_family")
    df = df.withColumns(
        {
            "family": F.col("_final"),
            "excluded_reason": F.when(
                F.col("_final").isNull(), F.coalesce("excluded_reason", F.lit(UNMATCHED))
            ),
        }
    )
    return _public(df)


def review_pile(df: DataFrame) -> DataFrame:
    """Postings nothing claimed and nothing rejected."""
    return classify_postings(df).where(F.col("family") == "unsorted")


# ----------------------------------------------------------------------------- sector


def with_sector_claims(df: DataFrame, only: Column | None = None) -> DataFrame:
    """Add ``sector_claims``: the sectors the description speaks for, in order; NULL if it is not read."""
    R = sector_rules
    text = F.col("description")
    # The sentence pattern is only tried where one of its phrases occurs.
    quoted = hit(folded(text), R.BOILERPLATE_PHRASES)
    text = F.when(quoted, F.regexp_replace(text, "(?i)" + R.BOILERPLATE, " ")).otherwise(text)
    text = F.when(only, text) if only is not None else text
    df = df.withColumn("_cased", ascii_text(text)).withColumn("_x", F.lower("_cased"))
    x = "_x"
    readable = F.coalesce(F.length("description") > 0, F.lit(False)) & F.col(x).isNotNull()
    claims = []
    for s in R.SECTOR_ORDER:
        claim = hit(x, R.STRONG[s])
        if s in R.CASED:
            claim = claim | matches(F.col("_cased"), R.CASED[s], ignore_case=False)
        claims.append(F.when(claim, s))
    matched = F.when(
        readable & ~hit(x, R.VENDOR), F.array_compact(F.array(*claims))
    )
    return computed(df, {"sector_claims": matched}).drop("_x", "_cased")


def with_sector(df: DataFrame) -> DataFrame:
    """Add sector and sector_reason from the advert's own language; ``sector_claims`` that are there are used."""
    R = sector_rules
    claimed = df if "sector_claims" in df.columns else per_value(df, ["description"], with_sector_claims)
    name = folded(
        F.concat(F.coalesce("company", F.lit("")), F.lit(" "), F.coalesce("board_token", F.lit("")))
    )
    df = claimed.withColumn("_name", name).withColumn("_matched", F.col("sector_claims"))
    hinted = F.array_compact(
        F.array(
            *[
                F.when(F.array_contains("_matched", s) & hit("_name", R.NAME_HINT[s]), s)
                for s in R.SECTOR_ORDER
            ]
        )
    )
    several = F.size("_matched") > 1
    sector = F.coalesce(F.when(several, F.get(hinted, F.lit(0))), F.get("_matched", F.lit(0)))
    reason = F.when(
        F.size("_matched") > 0,
        F.when(several, "The advert reads as more than one, and the employer name decides").otherwise(
            "The advert describes the organisation as one"
        ),
    )
    return df.withColumns({"sector": sector, "sector_reason": reason}).drop("_name", "_matched", "sector_claims")


# ------------------------------------------------------------------------ quiet, stack


def magnet_pattern() -> str:
    phrases = [t.replace(" ", "[ -]?") for t in quiet_rules.MAGNET_TITLES]
    return "(^|[^a-z])(" + "|".join([*phrases, *quiet_rules.MAGNET_ACRONYMS]) + ")([^a-z]|$)"


def is_quiet(title: Column) -> Column:
    """The title is none of those the crowd searches for."""
    pattern = magnet_pattern()[:-2] + r"\z)"
    return ~F.coalesce(F.lower(title).rlike(pattern), F.lit(False))


def stack_of(skills_found: Column) -> Column:
    """Python wins ties; skills that name no language are unknown."""
    def has(names) -> Column:
        return F.arrays_overlap(skills_found, F.array(*map(F.lit, names)))

    return (
        F.when(F.coalesce(has(rules.PYTHON_STACK), F.lit(False)), "python")
        .when(F.coalesce(has(rules.OTHER_STACK), F.lit(False)), "other")
        .otherwise("unknown")
    )
