"""Substrings a pattern cannot match without.

A rule such as ``\\b(aws|amazon web services)\\b`` can only hold where the text
contains 'aws' or 'amazon web services'.  Looking for those first is far cheaper than
running the pattern over every text.
"""

from functools import lru_cache
from re import _parser as parser

MAX_LITERALS = 80
_MAX_EXACT = 24


@lru_cache(maxsize=None)
def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-case strings of which one must occur, or None when there are none."""
    exact, needed = _sequence(parser.parse(pattern.replace(r"\z", r"\Z")))
    best = _better(exact, needed)
    if not best or len(best) > MAX_LITERALS or min(map(len, best)) < 2:
        return None
    kept = [a for a in best if not any(b != a and b in a for b in best)]
    return tuple(sorted(kept))


def _better(a, b):
    """The more selective of two sets of required strings."""
    sets = [s for s in (a, b) if s and "" not in s]
    return max(sets, key=lambda s: (min(min(map(len, s)), 3), -len(s)), default=None)


def _sequence(items):
    """(every text it matches, or None; strings of which one is required, or None)."""
    exact, run, needed = {""}, {""}, None
    for op, arg in items:
        e, n = _item(op, arg)
        needed = _better(needed, n)
        if e is not None and len(run) * len(e) <= _MAX_EXACT:
            run = {a + b for a in run for b in e}
            if exact is not None:
                exact = {a + b for a in exact for b in e}
            continue
        needed = _better(needed, run)
        exact, run = None, (e if e is not None else {""})
    return exact, _better(needed, run)


def _item(op, arg):
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "AT":
        return {""}, None
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(p) for p in arg[1]]
        exact = None
        if all(e is not None for e, _ in parts):
            exact = set().union(*(e for e, _ in parts))
        each = [_better(e, n) for e, n in parts]
        needed = set().union(*each) if all(each) else None
        return exact, needed
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        e, n = _sequence(inner)
        if low == 0:
            return (e | {""} if e is not None and high == 1 else None), None
        return (e if low == high == 1 else None), _better(e, n)
    if name == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 4:
        return {chr(v).lower() for _, v in arg}, None
    return None, None
