"""Near-duplicate groups by HyperMinHash sketches, confirmed on whole shingle sets.

1. A text's distinct word shingles are hashed to 64 bits. The first bits choose one
   of 128 buckets; of the lowest hash in a bucket the register keeps the number of
   leading zeros (6 bits) and the next 10 bits. Empty buckets borrow the register of
   a bucket chosen by a fixed probe sequence, which keeps the chance of equal
   registers at the Jaccard similarity.
2. Texts with equal sets become one class. Classes that agree in one of 32 bands of
   four registers meet in a bucket; a pair at 0.8 is missed with (1 - 0.8^4)^32 = 5e-8.
3. Inside a bucket the collision-corrected estimate, less five standard errors,
   joins classes to clusters; only a spanning tree of a bucket leaves the task.
4. Clusters are compared on full sets; again only spanning trees of confirmed links
   leave the task. Their components are the groups.

Buckets and clusters beyond a block are dealt out by pairs of blocks: every two
members meet in one task, no task holds more than two blocks, and no pair of
members becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.lineage import cut
from syncohort.llm import words as W
from syncohort.llm.components import components

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS = 4
#: Classes in a block of a bucket, and shingles in a block of a cluster.
BUCKET_BLOCK = 1024
CLUSTER_BLOCK = 1 << 20
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 5.0
SMALL = 32

_PROBES = W.mixed(np.arange(BUCKETS * 4096, dtype=np.uint64)).reshape(BUCKETS, 4096) >> np.uint64(
    64 - BUCKET_BITS
)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of a non-empty sorted set of 64-bit hashes."""
    bucket = hashes >> np.uint64(64 - BUCKET_BITS)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    value = hashes[first] << np.uint64(BUCKET_BITS)
    filled = bucket[first].astype(np.intp)
    # Leading zeros of the 57 bits left: position of the highest set bit by float exponent,
    # on the upper half first so that no rounding can carry.
    upper = (value >> np.uint64(32)).astype(np.float64)
    lower = (value & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(upper > 0, 32 - np.frexp(upper)[1], 64 - np.frexp(lower)[1])
    zeros = np.minimum(zeros, 63 - MANTISSA_BITS).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(BUCKETS, np.uint16)
    out[filled] = (zeros << np.uint64(MANTISSA_BITS)) | mantissa
    have = np.zeros(BUCKETS, bool)
    have[filled] = True
    empty, start = np.flatnonzero(~have), 0
    while len(empty) and start < _PROBES.shape[1]:
        tried = _PROBES[empty, start : start + 64]
        hit = have[tried]
        at, done = hit.argmax(1), hit.any(1)
        out[empty[done]] = out[tried[done, at[done]]]
        empty, start = empty[~done], start + 64
    out[empty] = out[filled[0]]
    return out


def chance(n: float, sizes: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of `n` and `sizes` members agree."""
    level = 2.0 ** -np.arange(0, 64 - MANTISSA_BITS)
    share = lambda s: np.exp(-np.outer(s, level / 2)) - np.exp(-np.outer(s, level))
    return share(sizes / BUCKETS) @ share(np.array([n / BUCKETS]))[0] / (1 << MANTISSA_BITS)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, registers); both binaries are null without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                text = W.coded(part.column("text"), lower=True)
                hashes = text.hashes()
                counts, digests, sketched = [], [], []
                for start, end in zip(text.bounds, text.bounds[1:]):
                    found = W.shingles(hashes[start:end], size)
                    counts.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found) if len(found) else None)
                    sketched.append(registers(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(sketched, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "registers"],
                )

    return docs.mapInArrow(
        sketch, "doc_id long, n_shingles long, digest binary, registers binary"
    )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = BUCKETS // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)),
                pa.array(values),
                pa.array(np.repeat(batch.column("rep").to_numpy(), bands)),
            ],
            names=["band", "value", "rep"],
        )


def _block_pairs(frame: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Every row once for each pair of blocks (i, j) that its member's block is in."""
    own = F.pmod(F.xxhash64(member), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    return (
        frame.withColumn("_blocks", blocks.cast("long"))
        .withColumn("_own", own)
        .select("*", other)
        # With several blocks, a block meets itself beside any of the others.
        .where("_blocks = 1 or _own <> _other")
        .withColumn("i", F.least("_own", "_other"))
        .withColumn("j", F.greatest("_own", "_other"))
        .drop("_blocks", "_own", "_other")
    )


def _trees(count: int, near) -> list[tuple[int, int]]:
    """Spanning stars of the graph whose neighbours `near(x, others)` tells."""
    left = np.arange(count)
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            found = left[hit]
            left = left[~hit]
            queue.extend(found.tolist())
            out.extend((root, y) for y in found.tolist())
    return out


def _links(ids: np.ndarray, trees: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(trees, np.int64).reshape(-1, 2)
    a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _estimated(share: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in W.groups(batches, ["band", "value", "i", "j"]):
            if group.num_rows < 2:
                continue
            ids = group.column("rep").to_numpy()
            n = group.column("n").to_numpy().astype(float)
            table = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16)
            table = table.reshape(len(ids), BUCKETS)

            def near(x: int, others: np.ndarray) -> np.ndarray:
                agree = (table[others] == table[x]).mean(1)
                by_chance = chance(n[x], n[others])
                estimate = (agree - by_chance) / (1 - by_chance)
                small, large = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
                error = np.sqrt(share * (1 - share) / np.minimum(BUCKETS, small))
                close = (estimate >= share - SLACK * error) | (small < SMALL)
                return close & (small >= share * large - 1e-9)

            if trees := _trees(len(ids), near):
                yield _links(ids, trees)

    return compare


def _whole_sets(size: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                text = W.coded(part.column("text"), lower=True)
                hashes = text.hashes()
                sets, right = [], []
                for start, end, digest in zip(
                    text.bounds, text.bounds[1:], part.column("digest").to_pylist()
                ):
                    found = W.shingles(hashes[start:end], size)
                    # A doc_id may name several texts; only the sketched one is compared.
                    right.append(xxhash.xxh3_128_digest(found) == digest)
                    sets.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep"),
                        part.column("cluster"),
                        part.column("total"),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["rep", "cluster", "total", "members"],
                ).filter(pa.array(right))

    return collect


def _confirmed(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in W.groups(batches, ["cluster", "i", "j"]):
            if group.num_rows < 2:
                continue
            ids = group.column("rep").to_numpy()
            raw = group.column("members").to_pylist()
            n = np.array([len(x) // 8 for x in raw])
            start = np.concatenate([[0], np.cumsum(n)])
            values, member = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)

            def near(x: int, others: np.ndarray) -> np.ndarray:
                mark = np.zeros(len(values), bool)
                mark[member[start[x] : start[x + 1]]] = True
                small, large = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
                hit = 100 * small >= percent * large
                some = others[hit]
                if len(some):
                    parts = [member[start[y] : start[y + 1]] for y in some]
                    at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    both = np.add.reduceat(mark[np.concatenate(parts)].astype(np.int64), at)
                    hit[hit] = 100 * both >= percent * (n[some] + n[x] - both)
                return hit

            if trees := _trees(len(ids), near):
                yield _links(ids, trees)

    return compare


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text, ...).

    Two rows are linked if 100 * shared shingles >= percent * all shingles of both, on
    distinct lower-cased (A-Z) shingles of `size` words; component_id is the lowest
    doc_id reachable and kept says whether it is the row's own. Null, empty and
    word-free texts have no shingles and link with nothing. Rows that repeat a doc_id
    with the same text are one document; a doc_id with several texts links each of
    them. A row with a null doc_id links with nothing, has a null component and is
    kept. Other columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    sketched = cut(sketches(docs, size), "sketches")
    reps = cut(
        sketched.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("registers").alias("registers"),
        ),
        "classes",
    )
    bands = reps.mapInArrow(_bands, "band int, value long, rep long")
    shared = bands.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1")
    met = _block_pairs(
        bands.join(shared, ["band", "value"]), F.ceil(F.col("c") / BUCKET_BLOCK), "rep"
    ).drop("c")
    keys = ["band", "value", "i", "j"]
    near = (
        met.join(reps.select("rep", "n", "registers"), "rep")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_estimated(percent / 100), "a long, b long")
    )
    clusters = cut(components(near.distinct()), "clusters")
    member = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    member = member.join(reps.select("rep", "n", "digest"), "rep")
    total = member.groupBy("cluster").agg(F.sum("n").alias("total"))
    member = member.join(total, "cluster").select("rep", "cluster", "total", "digest")
    whole = docs.join(member, docs.doc_id == member.rep).mapInArrow(
        _whole_sets(size), "rep long, cluster long, total long, members binary"
    )
    keys = ["cluster", "i", "j"]
    links = (
        _block_pairs(whole, F.ceil(F.col("total") / CLUSTER_BLOCK), "rep")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_confirmed(percent), "a long, b long")
    )
    found = cut(components(links), "groups").withColumnRenamed("node", "rep")
    classes = reps.select("digest", "rep").join(found, "rep", "left")
    classes = classes.select("digest", F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        sketched.select("doc_id", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` without those that have a near duplicate with a lower doc_id."""
    found = near_duplicates(docs, size, percent)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"))
    return rows.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")
