import math

import numpy as np
import pytest

from doclens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "n") for k, v in rows], SCHEMA)


def expected(rows, components=4):
    """With the whole table in one place, by the library's eigen-solver."""
    good = [(k, np.array([math.floor(256 * float(np.float32(c))) for c in v])) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    return good, n, s, values, vectors, cov


def check(spark, df, rows, sign_free=True):
    good, n, s, values, vectors, cov = expected(rows)
    got = df.collect()
    k = min(4, len(s))
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for vec_id, x in good:
        for c in range(1, k + 1):
            r = by[vec_id, c].pop()
            assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
            want = (x - s / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-3:
                assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(abs(r.whitened) - abs(want)) < 1e-8 * max(1, abs(want))
            assert math.isclose(r.explained, values[c - 1] / np.trace(cov), rel_tol=1e-9)
            assert 0 <= r.identity_error < 1e-9


@pytest.mark.parametrize("dim, many", [(2, 30), (6, 200), (64, 500)])
def test_against_the_whole_table_in_one_place(spark, dim, many):
    g = np.random.default_rng(dim)
    mixing = g.standard_normal((dim, dim)) * np.linspace(2, 0.2, dim)
    rows = [(k, (g.standard_normal(dim) @ mixing + 3).astype(np.float32).tolist()) for k in range(many)]
    rows += [(many, rows[0][1]), (many, rows[0][1]), (None, rows[1][1])]
    rows += [(many + 1, None), (many + 2, [None] * dim), (many + 3, [float("nan")] * dim), (many + 4, [float("inf")] + [0.0] * (dim - 1)), (many + 5, [-float("inf")] * dim), (many + 6, [0.5] * (dim + 1)), (many + 7, [])]
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dim]
    check(spark, W.apply(frame(spark, rows)), kept)


def test_a_third_of_the_rows_are_one_vector(spark):
    g = np.random.default_rng(3)
    rows = [(k, g.standard_normal(5).astype(np.float32).tolist()) for k in range(60)]
    check(spark, W.apply(frame(spark, rows + [(1000 + k, rows[7][1]) for k in range(300)]).repartition(5)), rows + [(1000 + k, rows[7][1]) for k in range(300)])


def test_negative_zero_and_floor(spark):
    rows = [(1, [-0.0, 0.001]), (2, [0.0, -0.001]), (3, [1.0, 0.5])]
    got = W.usable(frame(spark, rows)).collect()
    assert [r.x for r in got] == [[0, 0], [0, -1], [256, 128]]


def test_degenerate_tables(spark):
    assert W.apply(frame(spark, [])).collect() == []
    assert W.apply(frame(spark, [(1, None), (2, [])])).collect() == []
    one = W.apply(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = W.apply(frame(spark, [(k, [float(k), 1.0, 1.0]) for k in range(4)])).where("vec_id = 3").orderBy("component").collect()
    assert [r.whitened is None for r in flat] == [False, True, True] and flat[0].explained == pytest.approx(1)
    wide = W.apply(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert [r.deviation for r in wide if r.vec_id == 1] == [None, None]


@pytest.mark.parametrize("seed", range(4))
def test_symmetric_qr(seed):
    g = np.random.default_rng(seed)
    for n in (1, 2, 3, 10, 64):
        a = g.standard_normal((n, n)) * 10.0 ** g.integers(-3, 4, n)
        a = a @ a.T
        values, vectors = W.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-11 * np.abs(values).max())
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-11 * np.abs(a).max())
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([3.0, 1.0, 2.0]), np.ones((6, 6))):
        values, vectors = W.symmetric_qr(a)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12)


def test_merging_equals_adding():
    g = np.random.default_rng(9)
    x = g.standard_normal((300, 7)) + 1e6
    parts = []
    for piece in (x[:1], x[1:120], x[120:]):
        m = W.Moments(7)
        for row in piece:
            m.add(row)
        parts.append(m)
    total = W.Moments(7)
    for m in parts:
        total.merge(m)
    assert total.n == 300 and np.allclose(total.scatter / 300, np.cov(x.T, bias=True), rtol=1e-9)
