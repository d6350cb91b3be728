"""Places: display form, country and US state."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.match import first_hit_sql, hit_sql, let, non_empty, trim_all
from boardwalk.rules import geo as rules


def clean_location(c: Column, chars: int | None = None) -> Column:
    """Display form: two places at most, no street number, codes or postcode; with ``chars`` cut to so many."""
    parts = F.filter(F.split(trim_all(c), r"\s*;\s*", -1), lambda p: F.length(p) > 0)
    return let(parts, lambda p: _shown_parts(p, chars))


def _shown_parts(parts: Column, chars: int | None) -> Column:
    many = F.concat(
        F.get(parts, F.lit(0)), F.lit(", "), F.get(parts, F.lit(1)),
        F.lit(" +"), (F.size(parts) - 2).cast("string"), F.lit(" more"),
    )
    s = F.array_join(parts, "; ")
    s = F.regexp_replace(s, r"^\d+\s+[^,]*,\s*", "")
    s = F.regexp_replace(s, r"\b[A-Z]{2,4}-\d{3,}\b,?\s*", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"\s*\d{6}\z", "")
    s = F.regexp_replace(s, r"\s*\d{5}(-\d{4})?\z", "")
    s = F.trim(F.regexp_replace(s, r",\s*\z", ""))
    s = F.regexp_replace(s, r",(?=\S)", ", ")
    return F.when(F.size(parts) > 2, many).otherwise(let(s if chars is None else F.substring(s, 1, chars), non_empty))


# Country and state read some 300 patterns, so they are built as SQL text over column
# names; the trimmed and the folded place are bound once with lambdas.

_TRIMMED = r"regexp_replace({0}, r'^[\s\u00a0]+|[\s\u00a0]+\z', '')"
_CODES = "(" + ", ".join(f"'{c}'" for c in rules.US_STATE_CODES) + ")"


def _folded_sql(expr: str) -> str:
    return (
        f"lower(if(octet_length({expr}) = char_length({expr}), {expr}, "
        f"regexp_replace({expr}, r'[^\\x00-\\x7f\u2013\u2014]', '\u00b7')))"
    )


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _place(column: str, body: str) -> str:
    return _let("raw", _TRIMMED.format(column), _let("plain", _folded_sql("raw"), body))


def _names(table) -> str:
    return first_hit_sql("plain", table, "raw")


def _us_if(condition: str) -> str:
    return f"if({condition}, 'US', null)"


def _explicit_sql(column: str) -> str:
    codes = ", ".join(f"'{c}'" for c in rules.COUNTRY_LABELS)
    return _place(
        column,
        f"case when raw = 'UK' then 'GB' when raw in ({codes}) then raw else "
        f"coalesce({_names(rules.COUNTRY_NAMES)}, {_us_if(hit_sql('plain', rules.US_MARKERS))}) end",
    )


def _country_sql(column: str) -> str:
    first_words = (
        "transform(split(raw, r'[,|;\\-–]'), "
        f"p -> upper(split({_TRIMMED.format('p')}, r'\\s+')[0]))"
    )
    code = f"get(filter({first_words}, t -> t in {_CODES}), 0)"
    decided = (
        f"coalesce({_names(rules.COUNTRY_NAMES)}, {_us_if(hit_sql('plain', rules.US_MARKERS))}, "
        f"if(code is not null, if(coalesce(city = code, false), city, 'US'), null), "
        f"{_us_if(hit_sql('plain', rules.US_STATE_NAMES))}, city, "
        f"{_us_if(hit_sql('plain', rules.US_CITIES))})"
    )
    return _place(column, _let("city", _names(rules.CITY_COUNTRY), _let("code", code, decided)))


def _state_sql(column: str) -> str:
    words = f"split({_TRIMMED.format('p')}, r'\\s+')"
    codes = (
        f"transform(split(raw, r'[,|/;]|\\s[–-]\\s'), p -> case when upper({words}[0]) in {_CODES} "
        f"then upper({words}[0]) when upper(element_at({words}, -1)) in {_CODES} "
        f"then upper(element_at({words}, -1)) end)"
    )
    return _place(
        column,
        f"coalesce(if({hit_sql('plain', rules.DC_FORMS)}, 'DC', null), get(array_compact({codes}), 0), "
        f"{_names(rules.US_STATE_NAME_TO_CODE)}, {_names(rules.CITY_STATE_US)})",
    )


def explicit_country(column: str) -> Column:
    """ISO code from a vendor's own country field; invalid codes are NULL."""
    return F.expr(_explicit_sql(column))


def _any_country_sql(location: str, explicit: str | None) -> str:
    found = _country_sql(location)
    return found if explicit is None else f"coalesce({_explicit_sql(explicit)}, {found})"


def country(location: str, explicit: str | None = None) -> Column:
    """Country of a free-text place column; an explicit field wins when understood."""
    return F.expr(_any_country_sql(location, explicit))


def us_state(location: str, explicit: str | None = None) -> Column:
    """US state code; NULL for anything placed in another country."""
    placed = f"coalesce({_any_country_sql(location, explicit)}, 'US') = 'US'"
    return F.expr(f"if({placed}, {_state_sql(location)}, null)")
