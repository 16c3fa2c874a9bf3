import hashlib
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from syncohort.llm import fingerprints as fp


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_edited_texts(spark, corpus, corpus_rows):
    got = rows_of(fp.edited_fingerprints(corpus))
    want = brute.edited(corpus_rows)
    assert set(got) == set(want)
    texts = dict(corpus_rows)
    for d, text in want.items():
        assert got[d].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[d].n_chars == len(texts[d] or "")
        assert (got[d].fingerprint == got[d].edited_fingerprint) == ((texts[d] or "") == text)
    prints = {}
    for d, text in texts.items():
        prints.setdefault(text or "", set()).add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for s in prints.values() for p in s}) == len(prints)
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(r.near_edited > 0.5 for r in long) > 0.9 * len(long)
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))


def test_native(corpus):
    plan = fp.edited_fingerprints(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(odd_docs):
    rows = [(1, None), (2, ""), (3, "abcdefgh"), (3, "abcdefgh"), (9, "ÄÖ€😀x\nline two. More, and"), (None, "zz zz zz")]
    frame = fp.edited_fingerprints(odd_docs(rows))
    assert frame.count() == 6
    got = {(r.doc_id, r.n_chars): r for r in frame.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[None, 8].edited_sha256 == sha("zz zz ")  # next: document 1, empty
    assert got[1, 0].edited_sha256 == sha("")
    assert got[3, 8].edited_sha256 == sha("abcdefÄÖ")
    text = rows[4][1]
    assert got[9, len(text)].edited_sha256 == sha(text[: len(text) - len(text) // 4] + "zz zz zz"[: len(text) // 4])
    assert got[1, 0].near_next == 1.0 and got[1, 0].fingerprint == got[2, 0].fingerprint
    assert fp.edited_fingerprints(odd_docs([])).collect() == []
    only = fp.edited_fingerprints(odd_docs([(4, "abcdefgh")])).collect()
    assert only[0].edited_sha256 == sha("abcdefab") and only[0].near_next == 1.0


def test_branches_locate_edits(spark):
    lines = [f"Paragraph {k}, with words; number {k}." for k in range(40)]
    other = list(lines)
    other[17] = "Something else."
    other.insert(30, "New line.")
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    trees = frame.select(fp.tree(F.col("a")).alias("a"), fp.tree(F.col("b")).alias("b"))
    got = trees.select(
        fp.changed_paragraphs(F.col("a"), F.col("b")).alias("changed"),
        fp.changed_paragraphs(F.col("a"), F.col("a")).alias("same"),
        fp.tree_likeness(F.col("a"), F.col("b")).alias("near"),
        F.size(F.array_intersect("a.sections", "b.sections")).alias("sections"),
        F.col("a.sizes").alias("sizes"),
    ).first()
    assert got.changed == [17, 30] and got.same == []
    assert 0.9 < got.near < 1
    assert got.sections > 0 and len(got.sizes) == 40


def test_partitions(spark, corpus, corpus_rows):
    """The order of documents holds across many small range partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(fp.edited_fingerprints(corpus))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for d, text in brute.edited(corpus_rows).items():
        assert got[d].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "one", "a\n\nb", "x" * 5000])
def test_likeness_of_itself(spark, text):
    frame = spark.createDataFrame([(text,)], "t string").select(fp.tree(F.col("t")).alias("t"))
    assert frame.select(fp.tree_likeness(F.col("t"), F.col("t")).alias("x")).first().x == 1.0


def test_changed_equals_a_plain_difference(spark, corpus, corpus_rows):
    got = rows_of(fp.edited_fingerprints(corpus))
    for d, text in brute.edited(corpus_rows).items():
        own = set((dict(corpus_rows)[d] or "").split("\n"))
        want = [k for k, x in enumerate(text.split("\n")) if x not in own]
        assert got[d].changed == want, d


def test_very_many_paragraphs_take_seconds(spark):
    lines = [f"Line {k}, of very many {k * 7919}." for k in range(200_000)]
    other = [x if k % 50_000 else "changed" for k, x in enumerate(lines)] + ["new"]
    mixed = [f"Another line {k}." for k in range(200_000)]
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(x)) for x in (other, mixed)], "a string, b string")
    started = time.time()
    trees = frame.select(fp.tree(F.col("a")).alias("a"), fp.tree(F.col("b")).alias("b"))
    got = [r[0] for r in trees.select(fp.changed_paragraphs(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [0, 50_000, 100_000, 150_000, 200_000] and got[1] == list(range(200_000))
    assert time.time() - started < 60


def test_prose_without_signs_keeps_its_leaves(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    signs = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
    texts = [(prose, prose[: len(prose) * 3 // 4] + " other words"), (signs, signs[:2300] + prose[:700])]
    frame = spark.createDataFrame(texts, "a string, b string").select(
        fp.tree(F.col("a")).alias("a"), fp.tree(F.col("b")).alias("b")
    )
    for row in frame.select(fp.tree_likeness(F.col("a"), F.col("b")).alias("like"), F.size("a.leaves").alias("n")).collect():
        assert row.like > 0.5 and row.n > 20
