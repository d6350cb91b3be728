"""Rule tables: prefilter soundness and internal agreement."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boardwalk.functions.literals import required_literals
from boardwalk.operators.classify import magnet_pattern
from boardwalk.rules import Rule, adjacent, families, geo, labels, scoring, sector, skills, specializations


def patterns():
    out = []
    for module in (adjacent, families, geo, labels, scoring, sector):
        for value in vars(module).values():
            if isinstance(value, str) and "\\b" in value:
                out.append(value)
            elif isinstance(value, list):
                for item in value:
                    first = item[0] if isinstance(item, tuple) and not isinstance(item, Rule) else item
                    out += list(first.must) if isinstance(first, Rule) else [first]
    for table in (skills.CLOUD_SKILLS, skills.SOFTWARE_SKILLS, skills.DATA_SKILLS, skills.HRIS_SKILLS):
        out += [p for p, _, _ in table]
    for table in specializations.RULES.values():
        for _, title, body in table:
            out += [title, *body]
    return [p for p in out if isinstance(p, str) and "\\b" in p]


@pytest.mark.parametrize("pattern", patterns())
def test_a_match_contains_a_required_literal(pattern):
    needed = required_literals(pattern)
    if needed is None:
        return

    @settings(max_examples=15, deadline=None)
    @given(st.from_regex(re.compile(pattern, re.I | re.A)))
    def holds(text):
        assert any(n in text.lower() for n in needed)

    holds()


def test_every_specialization_has_a_label_and_one_family():
    listed = [s for specs in specializations.SPECIALIZATIONS_BY_FAMILY.values() for s in specs]
    assert len(listed) == len(set(listed)) == len(specializations.LABELS)
    for family, rules in specializations.RULES.items():
        assert {s for s, _, _ in rules} <= set(specializations.SPECIALIZATIONS_BY_FAMILY[family])


def test_magnets():
    pattern = re.compile(magnet_pattern())
    assert pattern.search("senior front-end engineer")
    assert not pattern.search("presrelease clerk")
