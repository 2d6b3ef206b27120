"""No pattern may need look-around or back-references: SQL engines without them must read it too."""

import re

import duckdb
import pytest

from doclens.functions import patterns as P

ALL = {k: v for k, v in vars(P).items() if isinstance(v, str) and k.isupper()} | {f"{e.family}{i}": e.pattern for i, e in enumerate(P.SIGNALS)}
ALL |= {f"{k}.{f}": getattr(v, f) for k, v in vars(P).items() if isinstance(v, P.Mark) for f in ("anywhere", "parts")}


@pytest.mark.parametrize("name", sorted(ALL))
def test_pattern_is_portable(name):
    assert not re.search(r"\(\?[=!<]", ALL[name]) and "'" not in ALL[name]
    duckdb.sql(f"select regexp_matches('', '{ALL[name]}')").fetchall()


@pytest.mark.parametrize("line, unit", [("X 5 µg/dl 1 - 2", "µg/dl"), ("X 5 µiu/ml", "µiu/ml"), ("X 5 µmol/l", "µmol/l"), ("X 250 /µl", "/µl"), ("X 250 x10^9/l", "x10^9/l"), ("X 5 cells/cumm", "cells/cumm")])
def test_units_of_rows(line, unit):
    assert duckdb.sql(f"select regexp_extract('{line}', '{P.LAB_ROW}', 6)").fetchall()[0][0] == unit


@pytest.mark.parametrize("dose, bad", [("5OO mg", True), ("SMG", True), ("500mg", False), ("OOOOO mg", True), ("5OOOOO mg", False)])
def test_letters_in_doses_of_up_to_five_characters(dose, bad):
    assert duckdb.sql(f"select regexp_matches('{dose}', '{P.DOSE_WITH_LETTERS.anywhere}')").fetchall()[0][0] is bad


def test_cues_never_hide_evidence():
    """A text that matches a pattern of evidence holds one of its cues: tried on each term as it is written."""
    for e in P.SIGNALS:
        for cue in e.cues:
            assert cue and cue == cue.lower()
    assert all(any(c in t for c in next(e for e in P.SIGNALS if re.search(e.pattern, t)).cues) for t in ("tax invoice", "sub total", "film coated", "each 5 ml contains", "follow up") if any(re.search(e.pattern, t) for e in P.SIGNALS))
