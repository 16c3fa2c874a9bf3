import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syncohort.llm import hard_negatives, rtree

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, page string"


def brute(rows, every=100, count=5):
    """Counter of result rows; `rows` are (vec_id, vector, label)."""
    kept = [
        (i, v, c) for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), c) for i, v, c in kept]
    out = Counter()
    for k, (anchor, x, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y)), i, c) for m, (i, y, c) in enumerate(kept) if m != k
        )
        for p, positive, _ in [s for s in scored if s[2] == label][:count]:
            fits = [(s, i) for s, i, c in scored if c != label and 80 * -p <= 100 * -s <= 100 * -p]
            for rank, (s, i) in enumerate(fits[:count]):
                out[anchor, positive, rank + 1, i, -p, -s] += 1
    return out


def found(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.fixture
def small_pages(monkeypatch):
    monkeypatch.setattr(rtree, "LEAF", 4)
    monkeypatch.setattr(rtree, "FANOUT", 3)


def test_corpus(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = found(hard_negatives.hard_negatives(table))
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_many_small_pages(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAGE_BYTES", 1)
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [
        (int(i), (rng.standard_normal(6) + 3 * (k % 4)).round(2).tolist(), int(rng.integers(0, 4)))
        for k, i in enumerate(rng.permutation(1500))
    ]
    got = found(hard_negatives.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), every=20))
    assert got == brute(rows, every=20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [1.0, 0.0], None), (200, None, 1), (300, [1.0, nan], 1),
        (1, [0.9, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, [inf, 0.0], 2), (None, [1.0, 0.5], 2),
        (5, [], 2), (6, [0.95], 2), (7, [0.8, 0.6], 1), (8, [None, 1.0], 1), (400, [0.0, 0.0], 3), (9, [0.0, 0.0], 3),
        (500, [-1.0, -1.0], 4), (10, [1.0, 1.0], 4), (11, [0.85, 0.55], -3),
    ]
    make = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = found(hard_negatives.hard_negatives(make(rows)))
    assert got == brute(rows) and max(got.values()) == 2  # an anchor that stands twice answers twice
    for few in ([], [(0, [1.0], 1)], [(0, None, 1)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        assert found(hard_negatives.hard_negatives(make(few))) == brute(few)


def test_one_vector_held_by_most_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [0.5, 0.25, 1.0], k % 3) for k in range(900)]
    rows += [(900 + k, rng.standard_normal(3).tolist(), k % 3) for k in range(300)]
    got = found(hard_negatives.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)))
    assert got == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(k, [float(3**12 + k), 5.0e6 + 1 / 256 * k, -7.0], k % 2) for k in range(210)]
    got = found(hard_negatives.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)))
    assert got == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(0, 10**6))
def test_search_equals_sorting(count, width, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-5, 6, (count, width)).astype(float)
    leaf, fanout = rtree.LEAF, rtree.FANOUT
    rtree.LEAF, rtree.FANOUT = 4, 3
    try:
        order = rtree.pack(x)
        assert sorted(order.tolist()) == list(range(count))
        ids, labels = rng.integers(0, 9, count), rng.integers(0, 2, count)
        page = rtree.Page(x[order], ids, labels)
        anchors = rng.integers(-5, 6, (3, width)).astype(float)
        low = rng.integers(-30, 10, (3, 2))
        high = low + rng.integers(-1, 30, (3, 2))
        may = lambda some, at: np.broadcast_to(labels[at] == 1, (len(some), len(labels[at])))
        best = page.search(anchors, may, low, high, np.full((3, 2), rtree.LOWEST), 4)
    finally:
        rtree.LEAF, rtree.FANOUT = leaf, fanout
    scores = (anchors @ page.rows.T).astype(int)
    for j in range(2):
        expected = []
        for a in range(3):
            fits = [
                (-scores[a, k], ids[k]) for k in range(count) if labels[k] == 1 and low[a, j] <= scores[a, k] <= high[a, j]
            ]
            expected += [(a, -s, i) for s, i in sorted(fits)[:4]]
        assert list(zip(best[j].anchor, best[j].score, best[j].id)) == expected


def test_leaves_outside_are_pruned():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c * 100, 3, (2000, 4)).round() for c in range(-5, 6)])
    page = rtree.Page(x[rtree.pack(x)], np.arange(len(x)), np.zeros(len(x), np.int64))
    anchors = page.rows[:: 2000].astype(float)
    shape = (len(anchors), 1)
    visits = rtree.Visits()
    every = lambda some, at: np.ones((len(some), len(page.ids[at])), bool)
    low, high, kth = (np.full(shape, v) for v in (rtree.LOWEST, rtree.NEVER, rtree.LOWEST))
    best = page.search(anchors, every, low, high, kth, 5, visits)
    assert visits.evaluated < 0.25 * (visits.evaluated + visits.pruned)
    scores = anchors @ page.rows.T
    assert [int(s) for s in best[0].score] == [int(s) for r in scores for s in sorted(r)[::-1][:5]]
