"""Turning rule tables into Column expressions.

Word boundaries in the rules are ASCII.  Java's ``\\b`` treats accented letters as
word characters (and changed between releases), so ASCII rules are tested against
``ascii_text`` (or its lower-case form ``folded``) and the few rules that contain
accented letters get explicit boundaries instead.
"""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.literals import required_literals
from boardwalk.rules import Rule

_SPACES = "[\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_OTHER_SIGNS = "[^\\x00-\\x7f\u2013\u2014]"
BOUNDARY = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def ascii_text(c: Column) -> Column:
    """Same length, but letters outside ASCII become a non-word sign."""
    changed = F.regexp_replace(F.regexp_replace(c, _SPACES, " "), _OTHER_SIGNS, "\u00b7")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(changed)


def folded(c: Column) -> Column:
    """Lower-case ``ascii_text``: what ``hit`` and ``first_hit`` read."""
    return F.lower(ascii_text(c))


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A rule pattern in Java's dialect: absolute end, ASCII word boundaries."""
    out = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
    out = out.replace("$|", r"\z|")
    if all(ord(ch) < 128 or ch in "\u2013\u2014" for ch in out):
        return ("(?i)" if ignore_case else "") + out
    return ("(?iu)" if ignore_case else "") + out.replace(r"\b", BOUNDARY)


def _lower_pattern(pattern: str) -> str:
    out = re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)
    return java_pattern(out, ignore_case=False)


def text_literal(value: str) -> str:
    """A SQL string literal, taken as written."""
    return f'r"{value}"' if "'" in value else f"r'{value}'"


def hit_sql(expr: str, rule) -> str:
    """SQL condition: the rule matches the folded text ``expr``.  Never NULL.

    The pattern runs only on texts that contain one of the strings it needs.
    """
    if isinstance(rule, list):
        return "(" + " or ".join(hit_sql(expr, r) for r in rule) + ")"
    if isinstance(rule, Rule):
        text = expr
        if rule.strip:
            text = f"regexp_replace({expr}, {text_literal(_lower_pattern(rule.strip))}, ' ')"
        parts = [hit_sql(text, p) for p in rule.must]
        parts += ["not " + hit_sql(text, p) for p in rule.must_not]
        return "(" + " and ".join(parts) + ")"
    found = f"{expr} rlike {text_literal(_lower_pattern(rule))}"
    needed = required_literals(rule)
    if needed:
        found = "(" + " or ".join(f"contains({expr}, {text_literal(s)})" for s in needed) + f") and {found}"
    return f"coalesce({found}, false)"


def case_sql(pairs, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def first_hit_sql(expr: str, rules, raw: str | None = None) -> str:
    """SQL label of the first rule matching folded text, NULL when none does.

    Rules holding accented letters read ``raw`` instead.
    """
    def condition(rule) -> str:
        if raw is None or is_ascii_rule(rule):
            return hit_sql(expr, rule)
        return f"coalesce({raw} rlike {text_literal(java_pattern(rule))}, false)"

    return case_sql((condition(rule), text_literal(label)) for rule, label in rules)


def hit(c: Column | str, rule) -> Column:
    """True where the rule matches folded text; ``c`` is a Column or SQL text.

    SQL text is one call to the JVM however long the rule; Columns are built piece by
    piece and suit short rules inside lambdas.
    """
    if isinstance(c, str):
        return F.expr(hit_sql(c, rule))
    if isinstance(rule, list):
        return any_of(hit(c, r) for r in rule)
    return F.coalesce(c.rlike(_lower_pattern(rule)), F.lit(False))


def first_hit(c: Column | str, rules) -> Column:
    """Label of the first rule matching folded text, NULL when none does."""
    if isinstance(c, str):
        return F.expr(first_hit_sql(c, rules))
    return ladder((hit(c, rule), label) for rule, label in rules)


def is_ascii_rule(rule) -> bool:
    parts = (*rule.must, *rule.must_not) if isinstance(rule, Rule) else (rule,)
    return all(ord(ch) < 128 or ch in "\u2013\u2014" for p in parts for ch in p)


def matches(c: Column, rule, ignore_case: bool = True) -> Column:
    """True where the rule matches; never NULL."""
    if isinstance(rule, list):
        return any_of(matches(c, r, ignore_case) for r in rule)
    if not isinstance(rule, Rule):
        return F.coalesce(c.rlike(java_pattern(rule, ignore_case)), F.lit(False))
    text = c
    if rule.strip:
        text = F.regexp_replace(c, java_pattern(rule.strip, ignore_case), " ")
    hit = all_of(matches(text, p, ignore_case) for p in rule.must)
    for p in rule.must_not:
        hit = hit & ~matches(text, p, ignore_case)
    return hit


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(flags) -> Column:
    return reduce(lambda a, b: a | b, flags)


def all_of(flags) -> Column:
    return reduce(lambda a, b: a & b, flags)


def ladder(pairs, otherwise: Column | None = None) -> Column:
    """CASE WHEN over (condition, value); the first true condition decides."""
    expr = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+\z", "")


def non_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def present(c: Column) -> Column:
    """Value is neither NULL nor blank."""
    return F.coalesce(F.length(trim_all(c)) > 0, F.lit(False))


def join_parts(separator: str, *parts: Column) -> Column:
    """Join the non-empty parts; NULL when nothing is left."""
    kept = F.filter(F.array(*parts), lambda p: F.coalesce(F.length(p) > 0, F.lit(False)))
    return non_empty(F.array_join(kept, separator))


def join_distinct(separator: str, *parts: Column) -> Column:
    """As ``join_parts`` on trimmed parts, each kept once, in order."""
    trimmed = F.transform(F.array(*parts), trim_all)
    kept = F.filter(trimmed, lambda p: F.coalesce(F.length(p) > 0, F.lit(False)))
    return non_empty(F.array_join(F.array_distinct(kept), separator))
