"""Board-token guesses from a company name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.match import let
from boardwalk.rules import slugs as rules


def slug_candidates(name: Column, limit: int | None = None) -> Column:
    """Array of candidate tokens, best first; all of them, or at most ``limit``."""
    alias_key = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    aliases = F.create_map(
        *[x for k, v in rules.ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    known = F.coalesce(F.element_at(aliases, alias_key), F.array().cast("array<string>"))
    base = F.regexp_replace(F.lower(name), "&", " and ")
    base = F.trim(F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9\s-]", " "), r"\s+", " "))
    return let(
        F.struct(known.alias("known"), _without(base, rules.NOISE).alias("less"), base.alias("base")),
        lambda s: _candidates(s, limit),
    )


def _without(text: Column, words: str) -> Column:
    cut = F.regexp_replace(text, "(?i)" + words, "")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def _candidates(s: Column, limit: int | None) -> Column:
    forms = F.array(s["base"], s["less"], _without(s["less"], rules.SECTOR_WORDS))
    return let(
        F.struct(s["known"].alias("known"), F.filter(forms, lambda v: F.length(v) > 0).alias("forms")),
        lambda v: _ordered(v, limit),
    )


def _ordered(s: Column, limit: int | None) -> Column:
    forms = s["forms"]
    joined = F.transform(forms, lambda v: F.regexp_replace(v, r"[\s-]", ""))
    hyphenated = F.transform(forms, lambda v: F.regexp_replace(v, r"\s+", "-"))
    first = F.filter(
        F.transform(forms, lambda v: F.get(F.split(v, " "), F.lit(0))), lambda w: F.length(w) >= 4
    )
    acronyms = F.transform(forms, _acronym)
    every = F.array_compact(F.concat(s["known"], joined, hyphenated, first, acronyms))
    usable = F.filter(every, lambda c: F.length(c).between(2, 60))
    found = F.array_distinct(usable)
    return found if limit is None else F.slice(found, 1, limit)


def _acronym(form: Column) -> Column:
    words = F.filter(F.split(form, " "), lambda w: F.length(w) > 0)
    letters = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.size(words).between(2, 4) & F.length(letters).between(2, 5), letters)
