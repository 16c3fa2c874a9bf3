import random

import brute
import numpy as np
import pytest

from syncohort.llm import components, near_duplicates as nd
from syncohort.llm import words as W


def noisy_copies(seed=3, copies=60, length=60):
    """A text, copies with one to twelve changed words, chains and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(length)]
    rows = [(0, " ".join(base))]
    for k in range(1, copies):
        text = list(base) if k % 3 else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(40)]
    rows += [(2000 + k, " ".join(base[:n])) for k, n in enumerate(range(1, 12))]
    return rows


def check(frame, rows, size):
    want = brute.near_duplicates(rows, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == want[r.doc_id][1]) for r in frame.collect())


@pytest.mark.parametrize("size", [4, 5])
def test_brute_force(spark, odd_docs, size):
    rows = noisy_copies()
    check(nd.near_duplicates(odd_docs(rows), size), rows, size)


def test_blocks(spark, odd_docs, monkeypatch):
    """Buckets and clusters of many blocks give the same groups."""
    monkeypatch.setattr(nd, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(nd, "CLUSTER_BLOCK", 500)
    rows = noisy_copies(5)
    check(nd.near_duplicates(odd_docs(rows), 4), rows, 4)


def test_corpus(corpus, corpus_rows):
    check(nd.near_duplicates(corpus, 4), corpus_rows, 4)


def test_odd_rows(spark, odd_docs):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (10, "two one"),
        (11, long), (12, long + " end"), (12, long + " end"), (None, "one two"), (13, "É a b c d"),
        (14, "é a b c d"),
    ]
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(odd_docs(rows), 4).collect()),
        key=str,
    )
    assert got == sorted(
        [
            (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False),
            (10, 1, 10, True), (11, 29997, 11, True), (12, 29998, 11, False), (12, 29998, 11, False),
            (None, 1, None, True), (13, 2, 13, True), (14, 2, 14, True),
        ],
        key=str,
    )
    kept = nd.drop_near_duplicates(odd_docs(rows), 4)
    assert kept.columns == odd_docs(rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 6, 7, 8, 10, 11, 13, 14]


def test_empty(spark, odd_docs):
    assert nd.near_duplicates(odd_docs([]), 4).collect() == []
    assert nd.near_duplicates(odd_docs([(1, None)]), 4).count() == 1


def test_registers_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.8), (400, 0.8), (3000, 0.5)):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            only = rng.integers(0, 2**64, (2, int(n * (1 - share) / share / 2)), dtype=np.uint64)
            a, b = (nd.registers(np.unique(np.concatenate([both, x]))) for x in only)
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - share) < 0.04


def test_chance_of_unrelated_sets():
    rng = np.random.default_rng(2)
    n = 2000
    made = [nd.registers(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))) for _ in range(300)]
    agree = np.mean([(a == b).mean() for a, b in zip(made, made[1:])])
    assert agree == pytest.approx(float(nd.chance(n, np.array([n]))[0]), abs=3e-4)


def test_components(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    frame = spark.createDataFrame([*path, *star, (5, 5), (7, None), (300, 200)], "a long, b long")
    got = {r.node: r.component for r in components.components(frame).collect()}
    want = {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(200)} | {300: 200, 200: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_splitting():
    import pyarrow as pa

    texts = ["", None, " a\tb\u00a0c \x1c d\n", "É x", "x" * 100000]
    text = W.coded(pa.array(texts), lower=True)
    got = [
        [text.vocabulary[c].decode() for c in text.codes[a:b]]
        for a, b in zip(text.bounds, text.bounds[1:])
    ]
    assert got == [brute.words(brute.lower(t)) for t in texts]
