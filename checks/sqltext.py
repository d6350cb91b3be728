"""Rule tables as check SQL (RE2 dialect)."""

from boardwalk.rules import Rule


def quote(text) -> str:
    if text is None:
        return "null"
    return "'" + str(text).replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = True) -> str:
    out = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
    return quote(("(?i)" if ignore_case else "") + out.replace("$|", r"\z|"))


def hit(expr: str, rule, ignore_case: bool = True) -> str:
    if isinstance(rule, list):
        return "(" + " or ".join(hit(expr, r, ignore_case) for r in rule) + ")"
    if isinstance(rule, Rule):
        text = expr
        if rule.strip:
            text = f"regexp_replace({expr}, {re2(rule.strip, ignore_case)}, ' ', 'g')"
        parts = [hit(text, p, ignore_case) for p in rule.must]
        parts += ["not " + hit(text, p, ignore_case) for p in rule.must_not]
        return "(" + " and ".join(parts) + ")"
    return f"coalesce(regexp_matches({expr}, {re2(rule, ignore_case)}), false)"


def case(pairs, otherwise: str = "null") -> str:
    body = " ".join(f"when {cond} then {value}" for cond, value in pairs)
    return f"(case {body} else {otherwise} end)"


def first_label(expr: str, rules) -> str:
    return case((hit(expr, rule), quote(label)) for rule, label in rules)


def replace(expr: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {quote(pattern)}, {quote(by)}, '{flags}')"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def trim_all(expr: str) -> str:
    return replace(expr, r"^\s+|\s+$")
