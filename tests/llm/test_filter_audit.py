from itertools import permutations
from math import factorial

import pytest

from doclens.llm import filter_audit as A

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
GOOD = " ".join(f"w{i}" for i in range(200))
#: (doc_id, text, lang): long and plain, short, repetitive, capitals, symbols, copies, nulls, repeated rows, very long.
ROWS = [
    (1, GOOD, "en"), (2, GOOD, "de"), (3, "few words", "en"), (4, "same " * 300, "en"), (5, GOOD.upper(), "en"), (6, GOOD + " #", "en"), (7, "SAME same # " * 99, None), (8, None, "en"), (9, "", "en"), (9, "", "en"),
    (10, GOOD, "en"), (None, GOOD, "en"), (None, "few words", "en"), (11, "few\twords", "fr"), (12, "ż " * 300 + "ÀÉ", "fr"), (13, GOOD * 400, "en"), (3, "few words", "en"), (3, GOOD, "de"), (14, "\x0b \n", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, 1), (5, 1, None), (9, 1, 0), (9, 0, 1), (None, 1, 1), (10, 1, 0), (77, 1, 1)]


def expected(rows, labels):
    """Every document through every order."""
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    flags = []
    for d, text, lang in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        smaller = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows)
        flags.append((lang or "", d, dict(A=len(words) < 200, B=100 * len(set(words)) < 50 * len(words), C=100 * capitals > 3 * len(text), D=any(c in "#$%&*|" for c in text), E=smaller)))
    out, totals = {}, {}
    for part in {p for p, _, _ in flags}:
        for order in permutations("ABCDE"):
            left = [(d, f) for p, d, f in flags if p == part]
            every = list(left)
            for step, k in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[k]]
                left = [(d, f) for d, f in left if not f[k]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[k] for _, f in every) - len(gone), sum(f[k] and sum(f.values()) == 1 for _, f in every), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                totals[part, k] = totals.get((part, k), 0) + len(gone)
    return {key: (*v, totals[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, part string, mask string")
    return docs, spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")


@pytest.fixture(scope="module")
def audited(spark):
    return A.audit(*frames(spark, ROWS, LABELS)).collect()


def test_against_every_document_through_every_order(audited):
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in audited} == expected(ROWS, LABELS)
    assert list(audited[0].asDict()) == COLUMNS
    assert len(audited) == 4 * 120 * 5


def test_shapley_values_add_up_to_what_is_removed(audited):
    for part in {r.part for r in audited}:
        mine = [r for r in audited if r.part == part]
        last = [r for r in mine if r.filter_order == "ABCDE"]
        assert sum(r.shapley for r in last) == factorial(5) * sum(r.removed for r in last)
        assert len({r.kept for r in mine if r.step == 5}) == 1


def test_repeated_rows_are_not_smaller_than_themselves(spark):
    rows = [(1, GOOD, "en")] * 3 + [(2, GOOD, "en")] * 2
    got = A.failures(*frames(spark, rows, [])).collect()
    assert sorted((r.mask, r.n) for r in got) == [(0, 3), (16, 2)]


def test_empty_tables(spark):
    assert A.audit(*frames(spark, [], LABELS)).count() == 0
    assert A.audit(*frames(spark, ROWS[:2], [])).where("good_lost + toxic_lost > 0").count() == 0


def test_a_group_of_copies_meets_as_counts(spark):
    docs, labels = frames(spark, [(k, GOOD, "en") for k in range(500)], [])
    got = A.failures(docs, labels).collect()
    assert sorted((r.mask, r.n) for r in got) == [(0, 1), (16, 499)]
