"""Rule tables: plain data, no logic.

Most entries are a single pattern.  ``Rule`` states the few that need several
patterns at once, which keeps every table free of lookaround.
"""

from typing import NamedTuple


class Rule(NamedTuple):
    """All of ``must`` match, none of ``must_not`` does, after ``strip`` is cut out."""

    must: tuple
    must_not: tuple = ()
    strip: str | None = None
