import math

import numpy as np
import pytest

from syncohort.llm import eigen, whitening


def spread(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    out = (q * np.array(values, float)) @ q.T
    return (out + out.T) / 2


CASES = {
    "distinct": [100.0 / (k + 1) for k in range(40)],
    "close": [50 + 0.01 * k for k in range(40)],
    "equal": [3.0] * 20,
    "cluster over the border": [9.0, 8.0] + [5.0] * 25 + [1.0] * 13,
    "rank three": [7.0, 2.0, 1.0] + [0.0] * 20,
    "two": [2.0, 1.0],
    "one": [4.0],
}


@pytest.mark.parametrize("name", CASES)
def test_leading_pairs(name):
    v = spread(CASES[name])
    values, vectors = eigen.leading(v, 16)
    expected = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.allclose(values, expected, rtol=0, atol=1e-13 * expected[0] * len(v))
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * expected[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10


@pytest.mark.parametrize("name", CASES)
def test_inertia_counts(name):
    v = spread(CASES[name], 3)
    form = eigen.tridiagonal(v)
    known = np.linalg.eigvalsh(v)
    full = np.diag(form[0]) + np.diag(form[1], 1) + np.diag(form[1], -1)
    assert np.allclose(np.linalg.eigvalsh(full), known, atol=1e-12 * known.max())
    for shift in (-1.0, 0.5, 1.5, 4.99, 6.0, 200.0):
        assert eigen.above(form, shift) == (known > shift).sum()


def test_a_missed_pair_is_noticed():
    v = np.diag([5.0, 4.0, 3.0, 2.0, 1.0] + [0.1] * 40)
    with pytest.raises(ArithmeticError):
        eigen.feast(v, 3.5, 5.5, 3)  # two are inside


def brute(rows, components=16):
    """{(position, component): (n, deviation, |whitened|, explained)} with numpy's solver."""
    kept = [
        (i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * c) + 1000000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    fit = [list(t) for t in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    shifted = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / max(n, 1)
    covariance = shifted.T @ shifted / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for (i, _), v in zip(kept, x):
        away = [n * c - s for c, s in zip(v, sums)]
        z = np.array(away, float) / n @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out += [
            (i, k + 1, n, sum(a * a for a in away), abs(z[k]), values[k] / np.trace(covariance))
            for k in range(len(values))
            if values[k] > 1e-12 * np.trace(covariance)
        ]
    return out


def compare(got, expected, tolerance=1e-7):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    expected = sorted(expected, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in expected], rtol=tolerance, atol=tolerance)


def test_corpus(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whitening.whiten(table).collect()
    compare(got, brute([(r.vec_id, r.embedding) for r in table.collect()]))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, n string, x int, component string"
    make = lambda rows: spark.createDataFrame([(i, v, 1, "a", 2, None) for i, v in rows], schema)
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [4.0, 0.0, 1.0]), (2, None), (3, [1.0, None, 2.0]),
        (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [-inf, 1.0, 1.0]), (7, []), (8, [5.0]), (9, [-7.5, 3.25, 0.5]),
        (10, [600.0, -800.0, 900.0]),
    ]
    got = whitening.whiten(make(rows)).collect()
    compare(got, brute(rows))
    assert {r.vec_id for r in got} == {1, None, 7, 8, 9, 10} and {r.component for r in got} == {1, 2, 3}
    for none in ([], [(2, None)], [(7, []), (8, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert whitening.whiten(make(none)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(k, [float((-1) ** k * 10**k), k + 0.25]) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = [r for r in brute(rows)]
    found = {(r.vec_id, r.component): r.deviation for r in got.collect()}
    assert found == {r[:2]: r[3] if r[3] < 2**63 else None for r in expected}


def test_rows_that_share_one_vector_count_once(spark):
    rows = [(k, [1.0, 2.0]) for k in range(900)] + [(1000, [3.0, 1.0]), (1001, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    compare(got.collect(), brute(rows))
