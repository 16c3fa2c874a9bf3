"""Repeated passages by a sparse suffix array over word sequences.

Of every 43 consecutive 8-word grams the one with the lowest hash is retained, so
any 50 words that two documents share retain the same position in both. Suffixes
whose gram occurs in one document only are left out; the others are sorted by the
words that follow (ties by the words before, then the document), and each is
compared with the nearest suffix of another document on either side. What matches
is extended right and left; 50 words or more make a repeat. Where three or more
suffixes share a gram, the neighbour with the longest match to the right need not be
the one with the longest in all, so these are also sorted by the words before.

The sort is a range partitioning on the whole key, so one passage in a third of the
documents spreads over many tasks. A few rows at the border of each partition are
compared again across borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncohort.lineage import cut
from syncohort.llm import words as W
from syncohort.llm.passages import cut_words

MIN_WORDS = 50
GRAM = 8

_SUFFIX = "way int, first binary, second binary, doc_id long, spot int"
_ORDER = ["way", "first", "second", "doc_id", "spot"]


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are lowest in some run of `window` grams (the first of equals)."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    lowest = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(1)
    return np.unique(lowest + np.arange(len(lowest)))


def _retained(min_words: int, gram: int):
    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                texts = part.column("text")
                text = W.coded(texts)
                hashes = text.hashes()
                digests, counts, spots, grams = [], [], [], []
                for start, end in zip(text.bounds, text.bounds[1:]):
                    own = hashes[start:end]
                    found = W.gram_hashes(own, gram)
                    at = minimisers(found, min_words - gram + 1)
                    digests.append(xxhash.xxh3_128_digest(own))
                    counts.append(len(own))
                    spots.append(at.astype(np.int32))
                    grams.append(found[at].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(digests, pa.binary()),
                        pa.array(counts, pa.int32()),
                        pa.array(spots, pa.list_(pa.int32())),
                        pa.array(grams, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "digest", "n_words", "spots", "grams"],
                )

    return retain


def _contexts(size: int):
    """Hashes (4 bytes, big-endian) of `size` words after and, reversed, before each spot.

    Way 0 has the words after it first, way 1 the words before it.
    """

    def cutout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                text = W.coded(part.column("text"))
                whole = text.hashes()
                hashes = (whole >> np.uint64(32)).astype(">u4")
                hashes[hashes == 0] = 1  # 0 stands for the text's ends
                way, first, second, docs, spots = [], [], [], [], []
                for doc, digest, at, start, end in zip(
                    part.column("doc_id").to_pylist(),
                    part.column("digest").to_pylist(),
                    part.column("spots").to_pylist(),
                    text.bounds,
                    text.bounds[1:],
                ):
                    if xxhash.xxh3_128_digest(whole[start:end]) != digest:
                        continue
                    end_mark = np.zeros(size, ">u4")
                    own = np.concatenate([end_mark, hashes[start:end], end_mark])
                    back = np.ascontiguousarray(own[::-1])
                    for spot in at:
                        here = spot["spot"] + size
                        right = own[here : here + size].tobytes()
                        there = len(own) - here
                        left = back[there : there + size].tobytes()
                        for k in range(1 + spot["many"]):
                            way.append(k)
                            first.append(left if k else right)
                            second.append(right if k else left)
                            docs.append(doc)
                            spots.append(spot["spot"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(way, pa.int32()),
                        pa.array(first, pa.binary()),
                        pa.array(second, pa.binary()),
                        pa.array(docs, pa.int64()),
                        pa.array(spots, pa.int32()),
                    ],
                    names=_ORDER,
                )

    return cutout


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal words of the rows of `a` and `b`; ends of texts never match."""
    equal = (a == b) & (a != 0)
    return np.where(equal.all(1), a.shape[1], equal.argmin(1))


def _neighbours(size: int):
    """Compare sorted suffixes with the nearest one of another document on either side."""

    def compared(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").to_numpy()
        spot = table.column("spot").to_numpy()
        new = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [len(doc)]])
        run = np.repeat(np.arange(len(starts)), ends - starts)
        rows = np.arange(len(doc))
        pairs = [(rows[run > 0], starts[run[run > 0]] - 1)]
        inner = run < len(starts) - 1
        pairs.append((rows[inner], ends[run[inner]]))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        way = table.column("way").to_numpy()
        i, j = i[way[i] == way[j]], j[way[i] == way[j]]
        matched = []
        for name in ("first", "second"):
            hashes = np.frombuffer(b"".join(table.column(name).to_pylist()), ">u4")
            hashes = hashes.reshape(-1, size)
            matched.append(_common(hashes[i], hashes[j]))
        hit = matched[0] + matched[1] >= size
        i, j, first, second = i[hit], j[hit], matched[0][hit], matched[1][hit]
        after, ahead = np.where(way[i] == 0, (first, second), (second, first))
        return pa.table(
            {
                "doc_id": pa.array(doc[i]),
                "start": pa.array((spot[i] - ahead).astype(np.int64)),
                "end": pa.array((spot[i] + after).astype(np.int64)),
                "other_id": pa.array(doc[j]),
            }
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.nulls
        rest = first = None

        def border(table: pa.Table) -> pa.RecordBatch:
            n = table.num_rows
            return pa.RecordBatch.from_arrays(
                [empty(n, pa.int64()) for _ in range(4)]
                + [table.column(c).combine_chunks() for c in _ORDER],
                names=names,
            )

        names = ["doc_id", "start", "end", "other_id", "way", "first", "second", "suffix", "spot"]
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            doc = table.column("doc_id").to_numpy()
            changes = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            if first is None and len(changes):
                first = table.take([0, int(changes[0])])
                yield border(first)
            found = compared(table)
            if found.num_rows:
                n = found.num_rows
                yield pa.RecordBatch.from_arrays(
                    [found.column(c).combine_chunks() for c in ("doc_id", "start", "end", "other_id")]
                    + [empty(n, kind) for kind in (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32())],
                    names=names,
                )
            # The last document's run still misses what follows it.
            rest = table.slice(max(int(changes[-1]) - 1, 0) if len(changes) else 0)
        if rest is not None:
            yield border(rest.take(sorted({0, rest.num_rows - 1})))

    return rows


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM
) -> DataFrame:
    """(doc_id, start, end, n_words, other_id): passages that other documents hold too.

    start and end count words `[^\\x20\\x09-\\x0D]+` of the whole text, end exclusive;
    overlapping finds are one passage. other_id is the lowest doc_id found to hold
    (a part of) it. Copies of a text with at least `min_words` words are one passage
    each. Passages repeated within one document only are no repeats. Null, empty and
    shorter texts and rows with a null doc_id have none; rows that repeat doc_id and
    text count once; a doc_id with several texts is compared once for each. Other
    columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    docs = docs.where("doc_id is not null and text is not null")
    marked = cut(
        docs.mapInArrow(
            _retained(min_words, gram),
            "doc_id long, digest binary, n_words int, spots array<int>, grams array<long>",
        ).where(F.col("n_words") >= min_words),
        "spots",
    )
    classes = marked.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")
    )
    copied = classes.where("last > rep")
    copies = marked.select("doc_id", "digest", "n_words").join(copied, "digest").select(
        "doc_id",
        F.lit(0).cast("long").alias("start"),
        F.col("n_words").cast("long").alias("end"),
        F.when(F.col("doc_id") > F.col("rep"), F.col("rep")).otherwise(F.col("last")).alias("other_id"),
    )
    chosen = classes.select("digest", F.col("rep").alias("doc_id"))
    kept = marked.join(chosen, ["digest", "doc_id"])
    held = kept.select(
        "doc_id", "digest", F.inline(F.arrays_zip("grams", "spots")).alias("gram", "spot")
    )
    # As a table, so that the join below deals out both sides anew and Spark can split the
    # partition of a gram that very many positions hold.
    shared = cut(
        held.groupBy("gram")
        .agg(
            F.min("doc_id").alias("low"),
            F.max("doc_id").alias("high"),
            (F.count("*") > 2).cast("int").alias("many"),
        )
        .where("low < high")
        .select("gram", "many"),
        "grams",
    )
    spots = (
        held.join(shared, "gram")
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set(F.struct("spot", "many"))).alias("spots"))
    )
    suffixes = docs.join(spots, "doc_id").mapInArrow(_contexts(min_words), _SUFFIX)
    compare = _neighbours(min_words)
    schema = (
        "doc_id long, start long, end long, other_id long, "
        "way int, first binary, second binary, suffix long, spot int"
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(
        suffixes.repartitionByRange(parts, *_ORDER)
        .sortWithinPartitions(*_ORDER)
        .mapInArrow(compare, schema),
        "neighbours",
    )
    # Four rows of each partition at most meet once more in a single task.
    borders = found.where("doc_id is null").select(
        "way", "first", "second", F.col("suffix").alias("doc_id"), "spot"
    )
    across = (
        borders.distinct().coalesce(1).sortWithinPartitions(*_ORDER).mapInArrow(compare, schema)
    )
    spans = ["doc_id", "start", "end", "other_id"]
    every = (
        found.select(*spans).union(across.select(*spans)).where("doc_id is not null").union(copies)
    )
    ordered = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reach, F.lit(True)).cast("long")
    return (
        every.withColumn("_begins", begins)
        .withColumn("_part", F.sum("_begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_part")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.min("other_id").alias("other_id"),
        )
        .select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other_id")
    )


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the words of `spans` removed from every document but the passage's first.

    A span stays where no other holder of it has a lower doc_id.
    """
    later = spans.where("other_id < doc_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"))
    text = F.col("row.text")
    changed = cut_words(F.when(F.col("spans").isNotNull(), text), F.col("spans"))
    return rows.join(later, F.col("own") == F.col("doc_id"), "left").select(
        *[
            F.coalesce(changed, text).alias("text") if c == "text" else F.col(f"row.`{c}`")
            for c in docs.columns
        ]
    )
