import brute
import numpy as np
import pytest

from syncohort.llm import quality


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_rules(docs, labels):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert base(r) == brute.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_scores_by_plain_counting(docs, labels):
    """The same ratios from plain dictionaries of n-grams."""
    import pyarrow as pa

    from syncohort.llm import words as W

    rows = docs.select("doc_id", "text").collect()
    marks = labels.collect()
    good = {r.doc_id for r in marks if r.quality == 1 and r.toxic == 0}
    counts = np.zeros((2, quality.BUCKETS))
    own = {}
    for r in rows:
        at = np.concatenate(
            [at for at, _ in quality._grams(W.coded(pa.array([r.text])), quality.BUCKETS)]
        )
        own[r.doc_id] = at
        for k in range(1 + (r.doc_id in good)):
            np.add.at(counts[k], at, 1)
    ratios = quality.log_ratios(counts)
    for r in quality.quality_rules(docs, labels).collect():
        at = own[r.doc_id]
        assert r.score == pytest.approx(ratios[at].mean() if len(at) else 0.0, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= r.threshold)


def test_held_out_labels(docs, labels):
    """Fitted on half the labels, the verdict separates the other half."""
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs, fit).collect()}
    rows = held.collect()
    good = [kept[r.doc_id] for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [kept[r.doc_id] for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_odd_rows(spark, odd_docs):
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (None, text), (5, "a b c d e " * 9000)]
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (None, 1, 0)], "doc_id long, quality long, toxic long")
    got = quality.quality_rules(odd_docs(rows), labels).collect()
    assert sorted(str((r.doc_id, r.n_words, r.kept)) for r in got) == sorted(
        str(x) for x in [(1, 0, False), (2, 0, False), (3, 0, False), (4, 20, True), (4, 20, True), (None, 20, True), (5, 45000, False)]
    )
    none = quality.quality_rules(odd_docs(rows), labels.limit(0))
    assert sum(r.kept for r in none.collect()) == 3
    assert quality.quality_rules(odd_docs([]), labels).collect() == []
    kept = quality.keep_quality(odd_docs(rows), labels)
    assert kept.count() == 3 and kept.columns == odd_docs(rows).columns


def test_threshold():
    low, high = np.array([-3.0, -2.0]), np.array([-1.0, 0.0, 1.0])
    assert quality.best_threshold(high, low) == -1.5
    assert quality.best_threshold(high, low[:0]) == float("-inf")


def test_ties_are_kept():
    same = np.zeros(3)
    assert quality.best_threshold(same, same) == float("-inf")


def test_threshold_of_all_rows(spark):
    rng = np.random.default_rng(3)
    for good, bad in ((rng.normal(1, 1, 300), rng.normal(0, 1, 200)), (np.zeros(3), np.zeros(2)), (np.ones(2), np.zeros(0))):
        good, bad = good.round(1), bad.round(1)
        rows = [(float(x), True, False) for x in good] + [(float(x), False, True) for x in bad]
        got = quality.threshold_of(spark.createDataFrame(rows, "score double, good boolean, bad boolean"))
        assert got == quality.best_threshold(good, bad)


def test_every_label_counts(spark, odd_docs):
    """Usable labels behind more than 20,000 others, whichever order they are taken in."""
    from pyspark.sql import functions as F

    ids = spark.range(20_400).select(F.col("id").alias("doc_id"))
    last = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(200).collect()]
    marks = ids.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(0).cast("long").alias("toxic"))
    words = [[f"{kind}{k}" for k in range(20)] for kind in ("bad", "good")]
    rows = [(d, " ".join(words[d % 2])) for d in last]
    got = quality.quality_rules(odd_docs(rows), marks).collect()
    assert len(got) == 200 and {r.threshold for r in got} != {float("-inf")}
    assert all(r.kept == (r.doc_id % 2 == 1) for r in got)


def test_counts_move_only_texts_that_may_be_trusted(spark):
    """Counts by a plain dictionary; a small trusted table moves no other text."""
    import pyarrow as pa

    from syncohort.llm import words as W

    rows = [(d, f"word{d % 7} one{d % 3} two{d % 5}") for d in range(-300, 300)] * 2
    rows += [(None, "no id here"), (5, None), (2**62, "far away")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(d,) for d in range(-300, 300, 9)] + [(2**62,)], "doc_id long")
    ids = {r.doc_id for r in trusted.collect()}
    want = np.zeros((2, 1 << 13))
    for doc_id, text in rows:
        for at, _ in quality._grams(W.coded(pa.array([text], pa.string())), 1 << 13):
            for k in range(1 + (doc_id in ids)):
                np.add.at(want[k], at, 1)
    assert (quality._corpus_counts(table, trusted, 1 << 13) == want).all()
    words = quality._id_filter(trusted)
    kept = quality._may_hold(words, pa.array([r[0] for r in rows], pa.int64())).to_pylist()
    assert all(kept[i] for i, r in enumerate(rows) if r[0] in ids)
    assert sum(kept) <= sum(r[0] in ids for r in rows) + 10
    none = quality._corpus_counts(table, trusted.where("false"), 1 << 13)
    assert (none[0] == want[0]).all() and not none[1].any()
