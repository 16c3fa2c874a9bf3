"""Quality rules: fixed rules on words and lines, then a likelihood ratio of hashed n-grams.

Single words and pairs of neighbouring words, and the same of their shapes (`XX!!`
for `THE!!`), are hashed to a fixed number of buckets. Two multinomials over the
buckets, of trusted texts and of the whole corpus, give each text the mean log
ratio of its n-grams. A text is kept if that mean reaches a threshold that is fixed
by the scores of labelled texts; nothing is drawn at random.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncohort.functions.ordered import running_totals
from syncohort.lineage import cut
from syncohort.llm import words as W

#: Buckets of the multinomials.
BUCKETS = 1 << 18
#: Pseudo-count of every bucket.
PRIOR = 1.0
#: 64-bit words of the filter of trusted ids.
FILTER = 1 << 18
#: Neighbouring buckets whose counts are added up as one row.
CHUNK = 1 << 12

_SYMBOLS = b"#*$%&|<>"
_SHAPES = bytes(
    120 if 97 <= b <= 122 or b >= 128 else 88 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)


def _grams(text: W.Coded, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of a slice, one kind at a time, and the text of each."""
    hashes = text.hashes()
    shape = [_RUNS.sub(rb"\1", w.translate(_SHAPES)) for w in text.vocabulary]
    shapes = np.fromiter(map(xxhash.xxh3_64_intdigest, shape), np.uint64, len(shape))
    shapes = W.mixed(shapes[text.codes] + np.uint64(1))
    own = np.repeat(np.arange(len(text.bounds) - 1), np.diff(text.bounds))
    within = own[1:] == own[:-1]
    for one in (hashes, shapes):
        yield (W.mixed(one) % np.uint64(buckets)).astype(np.int64), own
        pairs = W.gram_hashes(one, 2)[within]
        yield (pairs % np.uint64(buckets)).astype(np.int64), own[1:][within]


def _places(ids: pa.Array) -> np.ndarray:
    """Two bits (2, ids) of the filter for each id that is not null."""
    hashes = W.mixed(ids.drop_null().to_numpy().view(np.uint64))
    return np.stack([hashes, hashes >> np.uint64(32)]) % np.uint64(64 * FILTER)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits that the ids of `ids` set, as `FILTER` words; the driver sees these only."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER * 64, bool)
        for batch in batches:
            bits[_places(batch.column(0))] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(words[used])], names=["word", "bits"]
        )

    words = ids.mapInArrow(mark, "word long, bits long").groupBy("word")
    table = words.agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


def _may_hold(words: np.ndarray, ids: pa.Array) -> pa.Array:
    """Whether an id may be one of the filter's; never false for one that is."""
    at = _places(ids).astype(np.int64)
    out = np.zeros(len(ids), bool)
    out[ids.is_valid().to_numpy(zero_copy_only=False)] = ((words[at >> 6] >> (at & 63)) & 1).all(0)
    return pa.array(out)


def _corpus_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> np.ndarray:
    """Counts (2, buckets) of the whole corpus and of documents with an id of `trusted`.

    `trusted` has distinct doc_ids. Texts whose id is surely not among them are counted
    where they lie; only the others move, to be joined. The join is the same at every
    size, so that no executor ever holds all trusted ids.
    """
    seen = _id_filter(trusted)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_may_hold(seen, batch.column("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            if "trusted" not in batch.schema.names:
                sure = pc.invert(_may_hold(seen, batch.column("doc_id")))
                batch = batch.filter(sure).append_column("trusted", pa.repeat(False, sure.true_count))
            for part in W.slices(batch):
                chosen = part.column("trusted").to_numpy(zero_copy_only=False)
                for at, text in _grams(W.coded(part.column("text")), buckets):
                    total[0] += np.bincount(at, minlength=buckets)
                    if chosen.any():
                        total[1] += np.bincount(at[chosen[text]], minlength=buckets)
        starts = range(0, buckets, CHUNK) if total.any() else ()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(starts, pa.int64()),
                *[pa.array([c[a : a + CHUNK].tobytes() for a in starts], pa.binary()) for c in total],
            ],
            names=["start", "raw", "trusted"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, *own in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.stack([np.frombuffer(c, np.int64) for c in own])
                sums[start] = sums[start] + counts if start in sums else counts
        for start, counts in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"start": [start], "raw": [counts[0].tobytes()], "trusted": [counts[1].tobytes()]}
            )

    schema = "start long, raw binary, trusted binary"
    marks = trusted.select("doc_id", F.lit(True).alias("trusted")).hint("merge")
    texts = docs.select("doc_id", "text")
    moved = texts.mapInArrow(candidates, texts.schema).join(marks, "doc_id", "left")
    moved = moved.withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    counted = texts.mapInArrow(count, schema).union(moved.mapInArrow(count, schema))
    out = np.zeros((2, buckets))
    for row in counted.repartition("start").mapInArrow(add, schema).collect():
        for k, counts in enumerate((row["raw"], row["trusted"])):
            own = np.frombuffer(counts, np.int64)
            out[k, row["start"] : row["start"] + len(own)] = own
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of trusted over raw probability of each bucket; all 0 without trusted texts."""
    if not counts[1].any():
        return np.zeros(counts.shape[1])
    smooth = counts + PRIOR
    share = smooth / smooth.sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def _repeated(hashes: np.ndarray) -> int:
    """Words in 5-word windows that occur twice or more."""
    windows = W.gram_hashes(hashes, 5)
    if len(windows) < 2:
        return 0
    _, kind, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[kind] > 1)
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[twice] += 1
    np.add.at(cover, twice + 5, -1)
    return int((np.cumsum(cover) > 0).sum())


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    trimmed = pc.ascii_trim_whitespace(flat.dictionary)
    real = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)[codes]
    text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    n = np.bincount(text[real], minlength=len(texts))
    distinct = np.unique(text[real] * np.int64(len(flat.dictionary) or 1) + codes[real])
    return n - np.bincount(distinct // (len(flat.dictionary) or 1), minlength=len(texts))


_SCORED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, score double, text_hash long"
)


def _scores(ratios: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                text = W.coded(part.column("text"))
                n = len(part)
                size = np.fromiter(
                    (len(w.decode()) for w in text.vocabulary), np.int64, len(text.vocabulary)
                )
                signs = np.fromiter(
                    (len(w) - len(w.translate(None, _SYMBOLS)) for w in text.vocabulary),
                    np.int64,
                    len(text.vocabulary),
                )
                sums = [
                    np.diff(np.concatenate([[0], np.cumsum(x[text.codes])])[text.bounds])
                    for x in (size, signs)
                ]
                hashes = text.hashes()
                repeated = [
                    _repeated(hashes[a:b]) for a, b in zip(text.bounds, text.bounds[1:])
                ]
                count, mean = np.zeros(n, np.int64), np.zeros(n)
                for at, own in _grams(text, len(ratios)):
                    count += np.bincount(own, minlength=n)
                    mean += np.bincount(own, ratios[at], minlength=n)
                mean /= np.maximum(count, 1)
                columns = [np.diff(text.bounds), *sums, _dup_lines(part.column("text")), repeated]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(c, pa.int64()) for c in columns],
                        pa.array(mean, pa.float64()),
                        part.column("text_hash"),
                    ],
                    names=[c.split()[0] for c in _SCORED.split(", ")],
                )

    return score


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Score from which most good and fewest bad scores lie; -inf without either.

    Of all cuts with the highest sum of both shares it is the lowest one, in the middle
    between the scores beside it.
    """
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (values[1:] + values[:-1]) / 2])
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    gone = np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[int((kept + gone).argmax())])


def threshold_of(rated: DataFrame) -> float:
    """`best_threshold` of the scores of (score, good, bad) rows, of any number.

    Cuts are judged by running counts along the distinct scores; two rows reach the driver.
    """
    counts = cut(
        rated.groupBy("score").agg(
            *[F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "bad")]
        ),
        "rated",
    )
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return float("-inf")
    upto = running_totals(counts, [], ["score"], {"good_upto": "good", "bad_upto": "bad"})
    gain = (F.lit(1.0) - F.col("good_upto") / F.lit(good)) + F.col("bad_upto") / F.lit(bad)
    top = upto.agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("below")))).first()[0]
    if top.gain <= 1.0:  # as good as no cut
        return float("-inf")
    above = counts.where(F.col("score") > F.lit(-top.below)).agg(F.min("score")).first()[0]
    return (above - top.below) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, score, threshold, kept, text_hash) for every row.

    `labels` has doc_id, quality and toxic. Trusted are documents of quality 1 that are
    not toxic. Corpus counts and scores cover every row, trusted counts and the threshold
    every label; the threshold is `best_threshold` of the labelled rows that pass the base
    rules, of a doc_id with several texts the lowest score. Null, empty and word-free texts have all counts 0 and
    fail the base rules (fewer than ten words). Labels with nulls are left out; an id
    with several labels counts by its lowest quality and its highest toxicity; without
    usable labels only the base rules decide. Rows that repeat a doc_id are judged one by one; a null
    doc_id is judged like any other. Other columns are ignored.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    known = cut(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select("doc_id", good.alias("good"), (F.col("quality") == 0).alias("bad"))
        .where("good or bad"),
        "labels",
    )
    ratios = log_ratios(_corpus_counts(texts, known.where("good").select("doc_id"), buckets))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = cut(
        texts.mapInArrow(_scores(ratios), _SCORED).withColumn("base_failed", failed), "scores"
    )
    rated = (
        scored.where("not base_failed")
        .join(known, "doc_id")
        .groupBy("doc_id", "good", "bad")
        .agg(F.min("score").alias("score"))
    )
    threshold = threshold_of(rated)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "score", F.lit(threshold).alias("threshold"), kept.alias("kept"), "text_hash",
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that the rules keep; columns as in `docs`."""
    gone = (
        quality_rules(docs, labels)
        .where("not kept")
        .select("doc_id", "text_hash")
        .distinct()
    )
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("own"),
        F.xxhash64("text").alias("own_hash"),
    )
    same = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")
