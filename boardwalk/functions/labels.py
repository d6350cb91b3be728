"""Workplace, seniority and employment labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.match import (
    first_hit,
    folded,
    hit,
    join_parts,
    ladder,
    let,
    non_empty,
    trim_all,
)
from boardwalk.rules import labels as rules

_FULLY_REMOTE = r"\b(fully|100%|completely|entirely)[\s-]*remote\b"


def remote_type(explicit: Column | None, *text: Column, flag: Column | None = None) -> Column:
    """Workplace from an explicit value or boolean flag, else from free text.

    A boolean flag is final even when false; an explicit word that is not
    recognised falls through to the text.
    """
    from_text = F.lit(None).cast("string")
    if text:
        from_text = let(folded(join_parts(" ", *text)), _workplace_words)
    out = from_text
    if explicit is not None:
        word = F.regexp_replace(F.lower(explicit), r"[\s-]", "")
        out = F.coalesce(
            F.when(word.isin("remote", "fullyremote"), "fully_remote")
            .when(word == "hybrid", "hybrid")
            .when(word.isin("onsite", "inoffice"), "on_site"),
            from_text,
        )
    if flag is not None:
        out = F.when(flag.isNotNull(), F.when(flag, "fully_remote")).otherwise(out)
    return out


def _workplace_words(haystack: Column) -> Column:
    return ladder(
        [
            (hit(haystack, rules.HYBRID_WORDS) & ~hit(haystack, _FULLY_REMOTE), "hybrid"),
            (hit(haystack, rules.NEGATED_REMOTE), "on_site"),
            (hit(haystack, rules.REMOTE_WORDS), "fully_remote"),
            (hit(haystack, rules.ONSITE_WORDS), "on_site"),
        ]
    )


def looks_physical(location: Column) -> Column:
    """The location names a place a person would commute to."""
    return let(folded(trim_all(location)), _names_a_place)


def _names_a_place(t: Column) -> Column:
    return (
        F.coalesce(F.length(t) >= 3, F.lit(False))
        & ~hit(t, rules.VAGUE_LOCATION)
        & ~hit(t, rules.BARE_COUNTRY)
        & ~hit(t, r"\b(remote|hybrid|virtual|work from home|wfh)\b")
        & hit(t, r"[a-z]{3}")
    )


def resolved_remote_type(explicit: Column | None, location: Column, *text: Column) -> Column:
    """``remote_type``, else on-site for a concrete place."""
    return F.coalesce(
        remote_type(explicit, location, *text), F.when(looks_physical(location), "on_site")
    )


def seniority(title: Column, explicit: Column | None = None) -> Column:
    """Level from the vendor's own label when understood, else from the title."""
    by_title = let(folded(title), lambda t: first_hit(t, rules.SENIORITY_RULES))
    if explicit is None:
        return by_title
    canonical = let(
        folded(trim_all(explicit)), lambda t: first_hit(t, rules.EXPLICIT_SENIORITY)
    )
    return F.coalesce(let(canonical, non_empty), by_title)


_ENTRY_TEXT = r"\b(new grad|recent graduate|entry[- ]level|no experience required|0-2 years)\b"
_MINIMUM_YEARS = (
    r"\b(?:minimum(?: of)?|at least|min\.?|(?:requires?|require[ds])(?: a minimum of)?)\s*"
    r"(\d{1,2})\s*(?:\+|-\s*\d{1,2})?\s*(?:\+)?\s*years?\b"
)
_YEARS_OF = (
    r"\b(\d{1,2})\s*(?:\+|-\s*\d{1,2})?\s*(?:\+)?\s*years?(?:\s+(?:of|in|as|with))?\s+"
    r"(?:relevant\s+|professional\s+|hands[- ]on\s+|industry\s+)?"
    r"(?:experience|expertise|background)\b"
)


def seniority_from_text(description: Column, chars: int | None = None) -> Column:
    """Level from the first stated years of experience, in the whole text or its first ``chars``."""
    return let(folded(description if chars is None else F.substring(description, 1, chars)), _stated_level)


def _stated_level(text: Column) -> Column:
    found = F.concat(
        F.regexp_extract_all(text, F.lit(_MINIMUM_YEARS), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_YEARS_OF), F.lit(1)),
    )
    years = F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y <= 25)
    first = F.get(years, F.lit(0))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(hit(text, _ENTRY_TEXT), "entry")
        .when(first >= 10, "principal")
        .when(first >= 8, "staff")
        .when(first >= 5, "senior")
        .when(first >= 2, "mid")
        .when(first >= 0, "entry")
    )


# Query-side spellings of levels and employment, first match wins.
LEVELS = [
    (r"^not applicable$|^n/?a$", ""),
    (r"\b(intern|student|trainee)\b", "entry"),
    (r"\b(entry|junior|graduate|new grad|associate)\b", "entry"),
    (r"\b(executive|chief|vp|vice president)\b", "executive"),
    (r"\bdirector\b", "director"),
    (r"\b(principal|distinguished|fellow)\b", "principal"),
    (r"\bstaff\b", "staff"),
    (r"\bmid[\s-]senior\b", "senior"),
    (r"\bsenior\b", "senior"),
    (r"\bnon[\s-]?manager\b", "mid"),
    (r"\b(manager|head of|lead)\b", "lead"),
    (r"\b(mid|intermediate|experienced)\b", "mid"),
]
EMPLOYMENT = [
    (r"\b(intern|internship|trainee|apprentice)\b", "internship"),
    (r"\b(part[\s_-]?time|parttime)\b", "part_time"),
    (r"\b(contract|contractor|freelance|temporary|temp|fixed[\s_-]?term|b2b)\b", "contract"),
    (r"\b(volunteer)\b", "volunteer"),
    (r"\b(full[\s_-]?time|fulltime|permanent|regular|indefinite)\b", "full_time"),
]


def canonical_level(c: Column) -> Column:
    level = let(folded(trim_all(c)), lambda t: first_hit(t, LEVELS))
    return let(level, non_empty)


def canonical_employment(c: Column) -> Column:
    return let(folded(c), lambda t: first_hit(t, EMPLOYMENT))
