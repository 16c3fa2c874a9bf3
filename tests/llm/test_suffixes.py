import random

import brute
import numpy as np
import pytest

from syncohort.llm import suffixes as sx


def places(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return out


def planted(seed, docs=120):
    """Random texts, some with passages of 30 to 120 words from others, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(4))
    texts = [[word() for _ in range(rng.randint(5, 400))] for _ in range(docs)]
    for _ in range(60):
        a, b = rng.sample(range(docs), 2)
        n = rng.randint(30, 120)
        if len(texts[a]) > n:
            start = rng.randrange(len(texts[a]) - n)
            at = rng.randrange(len(texts[b]) + 1)
            texts[b][at:at] = texts[a][start : start + n]
    common = [word() for _ in range(70)]
    for k in range(0, docs, 3):
        at = rng.randrange(len(texts[k]) + 1)
        texts[k][at:at] = common
    texts += [list(texts[5]), list(texts[5])]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(odd_docs, seed):
    rows = planted(seed)
    got = places(sx.repeated_passages(odd_docs(rows)).collect())
    want = brute.repeated(rows, 50)
    # The same documents; never more than what another document holds.
    assert set(got) == set(want)
    hit = sum(len(got[d] & want[d]) for d in want)
    assert hit >= 0.99 * sum(map(len, want.values()))
    assert all(got[d] <= want[d] for d in got)


def test_corpus(corpus, corpus_rows):
    spans = sx.repeated_passages(corpus).collect()
    got, want = places(spans), brute.repeated(corpus_rows, 50)
    assert set(got) == set(want)
    assert all(got[d] <= want[d] for d in got)
    assert sum(len(got[d] & want[d]) for d in want) >= 0.99 * sum(map(len, want.values()))
    texts = dict(corpus_rows)
    for r in spans:
        assert r.n_words == r.end - r.start >= 50 and r.other_id != r.doc_id
        assert r.end <= len(brute.words(texts[r.doc_id]))


def test_across_partitions(spark, odd_docs):
    """Neighbours in different partitions of the sorted suffixes are compared too."""
    rows = planted(9)
    want = brute.repeated(rows, 50)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = places(sx.repeated_passages(odd_docs(rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(want)


def test_odd_rows(odd_docs):
    text = " ".join(f"w{k}" for k in range(80))
    loop = "again and again " * 200
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, loop), (None, text), (5, "w1 w2"), (6, " ".join(f"v{k}" for k in range(50000)))]
    assert sx.repeated_passages(odd_docs(rows)).collect() == []
    got = sx.repeated_passages(odd_docs([*rows, (7, "X\n" + text.replace(" ", "\n\t ") + " y")])).collect()
    assert sorted((r.doc_id, r.start, r.end, r.other_id) for r in got) == [(3, 0, 80, 7), (7, 1, 81, 3)]
    assert sx.repeated_passages(odd_docs([])).collect() == []


def test_removal_keeps_the_first(odd_docs):
    text = " ".join(f"w{k}" for k in range(80))
    docs = odd_docs([(1, text), (2, "a b " + text + " c"), (3, text), (4, None)])
    out = sx.without_passages(docs, sx.repeated_passages(docs))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: text, 2: "a b c", 3: "", 4: None}
    assert out.columns == docs.columns


def test_minimisers():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 2**63, 500).astype(np.uint64)
    got = set(sx.minimisers(grams, 43).tolist())
    want = {i + int(grams[i : i + 43].argmin()) for i in range(500 - 42)}
    assert got == want
    assert len(sx.minimisers(grams[:42], 43)) == 0
