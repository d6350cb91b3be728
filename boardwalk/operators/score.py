"""Competition score, quiet score and skill fit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.dates import exact_age
from boardwalk.functions.match import folded, hit
from boardwalk.functions.steps import computed
from boardwalk.operators.keys import join_on_nullable
from boardwalk.rules import quiet as quiet_rules
from boardwalk.rules import scoring as rules

FULL_EVIDENCE = 5


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _lookup(table: dict, key: Column, default: float) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(entries, key), F.lit(default))


def with_board_size(df: DataFrame, *board: str) -> DataFrame:
    """Postings per board.  Counted apart and joined back, so a huge board is one
    pre-aggregated row rather than one window partition.  Null boards are a board."""
    sizes = df.groupBy(*board).agg(F.count("*").alias("board_size"))
    return join_on_nullable(df, sizes, list(board))


def with_scores(df: DataFrame, now: Column) -> DataFrame:
    """Add the six components, the 0-100 score and the reasons behind it.

    Needs title, description, location, city, region, remote_type, seniority,
    provider, board_size, salary_min and posted_at.
    """
    text = F.concat("title", F.lit(" "), F.coalesce("description", F.lit("")))
    place = F.concat_ws(
        " ", *[F.coalesce(c, F.lit("")) for c in ("location", "city", "region")]
    )
    df = df.withColumns(
        {
            "_text": folded(text),
            "_desc": folded(F.coalesce(F.col("description"), F.lit(""))),
            "_place": folded(place),
            "_age": exact_age(F.col("posted_at"), now),
        }
    )
    df = computed(
        df,
        {
            "_hub": hit("_place", rules.HUB_CITIES),
            "_niche": hit("_text", rules.NICHE_SKILLS),
            "_credential": hit("_text", rules.CREDENTIALS),
            "_evergreen": hit("_text", rules.EVERGREEN),
            "_staffing": hit("_text", rules.STAFFING),
            "_letter": hit("_desc", r"\bcover letter\b"),
            "_sample": hit("_desc",
                r"\b(work sample|take[- ]home|portfolio|writing sample|assessment)\b",
            ),
        },
    )
    remote, level, age = F.col("remote_type"), F.col("seniority"), F.col("_age")
    local = _flag(remote.isin("on_site", "hybrid"))
    base = (
        F.when(remote == "fully_remote", 0.12)
        .when(remote == "hybrid", 0.68)
        .when(remote == "on_site", 0.85)
        .otherwise(0.5)
    )
    hub_shift = F.when(F.col("_hub"), base - 0.2).when(local, base + 0.1).otherwise(base)
    skill = (
        F.when(level == "entry", 0.08)
        .when(level == "senior", 0.6)
        .when(level.isin("staff", "principal"), 0.8)
        .when(level.isin("lead", "director", "executive"), 0.75)
        .otherwise(0.4)
    )
    skill = F.when(F.col("_niche"), skill + 0.25).otherwise(skill)
    skill = F.when(F.col("_credential"), skill + 0.2).otherwise(skill)
    discovery = _lookup(rules.PROVIDER_DISCOVERY, F.col("provider"), 0.5)
    small, huge = F.col("board_size") <= 10, F.col("board_size") > 500
    discovery = F.when(small, discovery + 0.12).when(huge, discovery - 0.1).otherwise(discovery)
    apply = _lookup(rules.PROVIDER_APPLICATION, F.col("provider"), 0.4)
    apply = F.when(F.col("_letter"), apply + 0.2).otherwise(apply)
    apply = F.when(F.col("_sample"), apply + 0.15).otherwise(apply)
    fresh = (
        F.when(age.isNull(), 0.4)
        .when(age <= 3, 1.0)
        .when(age <= 14, 0.7)
        .when(age <= 45, 0.4)
        .when(age <= 90, 0.2)
        .otherwise(0.05)
    )
    df = df.withColumns(
        {
            "desirability": clamp(hub_shift),
            "discovery": clamp(discovery),
            "qualification": clamp(skill),
            "application": clamp(apply),
            "freshness": fresh,
            "ghost_risk": _ghost(age),
        }
    )
    w = rules.WEIGHTS
    weighted = (
        F.col("desirability") * w["desirabilityDiscount"]
        + F.col("discovery") * w["discoveryFriction"]
        + F.col("qualification") * w["qualificationFriction"]
        + F.col("application") * w["applicationFriction"]
        + F.col("freshness") * w["freshness"]
    )
    raw = weighted * (F.lit(1.0) - F.col("ghost_risk") * 0.8) * 100
    reasons = F.array_compact(
        F.array(
            F.when(remote == "fully_remote", "Fully remote — largest applicant pool of any format")
            .when(remote == "hybrid", "Hybrid — applicant pool limited to commutable candidates")
            .when(remote == "on_site", "On-site — geographically capped competition"),
            F.when(F.col("_hub"), "Major tech hub — deep local applicant pool").when(
                local, "Secondary market — thinner local competition"
            ),
            F.when(small, "Small board — low-traffic employer").when(
                huge, "Very large employer — high inbound volume"
            ),
            F.when(level == "entry", "Entry level — the most contested tier in the market").when(
                level.isin("staff", "principal"), "Staff/principal — small qualified population"
            ),
            F.when(F.col("_niche"), "Niche technology — very few qualified applicants"),
            F.when(F.col("_credential"), "Hard credential or clearance gate"),
            F.when(F.col("_letter"), "Cover letter required — high human drop-off"),
            F.when(F.col("_sample"), "Work sample required — high human drop-off"),
            F.when(age <= 3, "Posted within 3 days — ahead of the applicant wave"),
            F.when(F.col("_evergreen"), "Evergreen pipeline posting — may not be a real opening"),
            F.when(F.col("_staffing"), "Agency or staffing listing"),
            F.when(
                age > 120,
                F.concat(
                    F.lit("Open "), F.floor(age + 0.5).cast("string"),
                    F.lit(" days — stale or perpetually relisted"),
                ),
            ),
        )
    )
    df = df.withColumns(
        {"competition_score": F.floor(raw + 0.5).cast("int"), "reasons": reasons}
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _ghost(age: Column) -> Column:
    risk = F.when(F.col("_evergreen"), 0.6).otherwise(0.0)
    risk = F.when(F.col("_staffing"), risk + 0.25).otherwise(risk)
    risk = (
        F.when(age > 120, risk + 0.4)
        .when((age > 60) & F.col("salary_min").isNull(), risk + 0.15)
        .otherwise(risk)
    )
    return clamp(risk)


def quiet_score(provider: Column, remote: Column, level: Column) -> Column:
    n = F.lit(40)
    n = n + F.when(remote == "on_site", 25).when(remote == "hybrid", 15).when(
        remote == "fully_remote", -15
    ).otherwise(0)
    n = n + F.when(provider.isin(quiet_rules.SYNDICATED_PROVIDERS), 0).otherwise(15)
    n = n + F.when(provider.isin("workday", "ukg"), 10).otherwise(0)
    n = n + F.when(level == "entry", -20).when(level.isin("staff", "principal", "lead"), 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), n))


def quiet_reasons(provider: Column, remote: Column, level: Column) -> Column:
    return F.array_compact(
        F.array(
            F.lit("Titled something people do not search for"),
            F.when(remote == "on_site", "On-site — competition capped by geography").when(
                remote == "hybrid", "Hybrid — commutable candidates only"
            ),
            F.when(
                ~provider.isin(quiet_rules.SYNDICATED_PROVIDERS),
                "Mid-market board — rarely syndicated",
            ),
            F.when(
                provider.isin("workday", "ukg"), "Application needs an account — high drop-off"
            ),
            F.when(
                level.isin("staff", "principal", "lead"), "Staff or above — small qualified pool"
            ),
        )
    )


def with_fit(df: DataFrame, candidate_skills: Column, required: str = "matched_skills") -> DataFrame:
    """Add fit_known, fit, fit_basis, fit_confidence, fit_have and fit_missing."""
    owned = F.transform(candidate_skills, F.lower)
    df = df.withColumns(
        {
            "_have": F.filter(required, lambda s: F.array_contains(owned, F.lower(s))),
            "_missing": F.filter(required, lambda s: ~F.array_contains(owned, F.lower(s))),
            "fit_basis": F.size(F.coalesce(F.col(required), F.array().cast("array<string>"))),
        }
    )
    known = F.col("fit_basis") > 0
    ratio = F.size("_have") / F.col("fit_basis")
    evidence = F.least(F.lit(1.0), F.col("fit_basis") / FULL_EVIDENCE)
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "fit_known": known,
            "fit": F.when(known, ratio).otherwise(0.5),
            "fit_confidence": F.when(known, ratio * evidence).otherwise(0.0),
            "fit_have": F.when(known, F.col("_have")).otherwise(none),
            "fit_missing": F.when(known, F.col("_missing")).otherwise(none),
        }
    ).drop("_have", "_missing")
