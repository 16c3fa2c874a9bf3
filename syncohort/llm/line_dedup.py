"""Line deduplication: documents that share lines are aligned, later copies of blocks go.

1. A block is worth deleting with MIN_BLOCK characters, however often it occurs. Every
   such block is a union of its shortest runs of lines that still count, one from each
   line onwards and one up to each line. Runs are hashed, and every run points from each
   holder to its earliest holder: n holders make n - 1 pairs of documents, none among
   the later ones, so a run is evidence however rare or common it is.
2. Each pair is aligned by patience diff on its lines, told apart by 96 bits and their
   sizes. Aligned common blocks of enough characters go from the later document. Lines
   that stand elsewhere in the earlier document too, repeated or moved, are matched
   block by block.

A source that very many documents point to is copied, so that its pairs are many groups.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncohort.lineage import cut
from syncohort.llm import words as W

#: Characters (bytes of UTF-8) in a block that is worth deleting.
MIN_BLOCK = 40
#: Pairs of one source in a group.
PAIRS = 512
#: Runs in one batch of rows.
RUNS = 1 << 16
#: Lines handled at once; a longer text makes a slice of its own.
SLICE_LINES = 1 << 18


_LOW = (1 << 64) - 1


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            lists = pc.split_pattern(part.column("text"), "\n")
            lines = pc.ascii_trim_whitespace(lists.flatten()).cast(pa.binary())
            digests = [xxhash.xxh3_128_intdigest(x) if x else None for x in lines.to_pylist()]
            hashes = [None if x is None else (x & _LOW) - (1 << 63) for x in digests]
            # 32 further bits beside the size tell lines with equal hashes apart.
            more = np.array([0 if x is None else x >> 96 for x in digests], np.int64)
            checks = (pc.binary_length(lines).to_numpy().astype(np.int64) << 32) | more
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("version"),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(checks)),
                ],
                names=["doc_id", "version", "lines", "checks"],
            )


def _anchors(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines found once in either range, thinned to the longest increasing sequence."""
    once_a = Counter(a[a0:a1])
    once_b = Counter(b[b0:b1])
    place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
    common = [(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place]
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(common)
    for k, (_, j) in enumerate(common):
        pile = bisect.bisect_left(tops, j)
        before[k] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[pile], piles[pile] = j, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(common[k])
        k = before[k]
    return chain[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both, of equal entries of `a` and `b`.

    One increasing chain: moved and repeated blocks are not in it, `common_blocks` has them.
    """
    out: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _anchors(a, b, a0, a1, b0, b1)
        out.extend(chain)
        if chain:
            stops = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            ranges.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(stops, stops[1:]))
    return sorted(out)


def shortest_runs(
    sizes: np.ndarray, bounds: np.ndarray, min_block: int
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the shortest runs of lines that count as a block.

    Document d has the lines `bounds[d]:bounds[d + 1]`; `sizes` are characters.
    """
    count = len(sizes)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    onward = np.searchsorted(total, total[:-1] + min_block, "left")
    backward = np.searchsorted(total, total[1:] - min_block, "right") - 1
    at = np.arange(count)
    first, last = onward <= bounds[of + 1], backward >= bounds[of]
    starts = np.concatenate([at[first], backward[last]])
    ends = np.concatenate([onward[first], at[last] + 1])
    pairs = np.unique(np.stack([starts, ends]), axis=1)
    return pairs[0], pairs[1]


def common_blocks(
    earlier: Sequence, later: Sequence, sizes: Sequence[int], min_block: int
) -> list[int]:
    """Positions in `later` of blocks with at least `min_block` characters that `earlier` holds.

    However often and in whatever order either side has them.
    """
    sizes = np.asarray(sizes, np.int64)
    runs = shortest_runs(sizes, np.array([0, len(sizes)]), min_block)
    runs = list(zip(*(x.tolist() for x in runs)))
    held = {
        tuple(earlier[i : i + n])
        for n in {end - start for start, end in runs}
        for i in range(len(earlier) - n + 1)
    }
    found = {k for a, b in runs if tuple(later[a:b]) in held for k in range(a, b)}
    return sorted(found)


def aligned_blocks(
    earlier: Sequence, later: Sequence, sizes: Sequence[int], min_block: int
) -> list[int]:
    """Positions in `later` of blocks with at least `min_block` characters that `earlier` holds.

    Blocks of the alignment first. Where lines that are left stand in `earlier` too, every
    other common block is looked for, so the result is that of `common_blocks`.
    """
    found: set[int] = set()
    pairs = patience(earlier, later)
    start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            block = range(pairs[start][1], pairs[k - 1][1] + 1)
            if sum(sizes[j] for j in block) >= min_block:
                found.update(block)
            start = k
    known = set(earlier)
    if any(j not in found and line in known for j, line in enumerate(later)):
        found.update(common_blocks(earlier, later, sizes, min_block))
    return sorted(found)


def _run_hashes(lines: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = W.mixed((ends - starts).astype(np.uint64))
    step, open_ = 0, np.arange(len(starts))
    while len(open_):
        total[open_] = W.mixed(total[open_] * W._STEP + lines[starts[open_] + step])
        step += 1
        open_ = open_[starts[open_] + step < ends[open_]]
    return total


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most SLICE_LINES lines, or one row."""
    ends = np.asarray(batch.column("lines").offsets)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + SLICE_LINES, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _real(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and checks of the lines that are not blank, and where each text's begin."""
    held = batch.column("lines")
    offsets = np.asarray(held.offsets).astype(np.int64)
    flat, offsets = held.flatten(), offsets - offsets[0]
    real = flat.is_valid().to_numpy(zero_copy_only=False)
    lines = flat.fill_null(0).to_numpy(zero_copy_only=False)[real]
    checks = batch.column("checks").flatten().to_numpy(zero_copy_only=False)[real]
    return lines, checks, np.concatenate([[0], np.cumsum(real)])[offsets]


def _runs(min_block: int):
    """Rows (run, doc_id, version), a row for each shortest run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            lines, checks, bounds = _real(batch)
            starts, ends = shortest_runs(checks >> 32, bounds, min_block)
            of = np.searchsorted(bounds, starts, "right") - 1
            hashes = _run_hashes(lines.view(np.uint64), starts, ends).view(np.int64)
            for a in range(0, len(starts), RUNS):
                some = slice(a, a + RUNS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[some]),
                        batch.column("doc_id").take(pa.array(of[some])),
                        batch.column("version").take(pa.array(of[some])),
                    ],
                    names=["run", "doc_id", "version"],
                )

    return runs


def _aligned(min_block: int):
    """Rows with both texts' lines in, line numbers of the later one's common blocks out."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                mine = row.select(["lines", "checks"])
                other = row.select(["source_lines", "source_checks"]).rename_columns(["lines", "checks"])
                lines, checks, _ = _real(mine)
                source, source_checks, _ = _real(other)
                keys = np.stack([np.concatenate([source, lines]), np.concatenate([source_checks, checks])])
                codes = np.unique(keys, axis=1, return_inverse=True)[1].ravel().tolist()
                gone = aligned_blocks(
                    codes[: len(source)], codes[len(source) :], (checks >> 32).tolist(), min_block
                )
                if not gone:
                    continue
                numbers = np.flatnonzero(mine.column("lines").flatten().is_valid())[gone]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[row.column(c) for c in ("doc_id", "version", "source_id")],
                        pa.array([numbers.tolist()], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "version", "source_id", "removed"],
                )

    return align


def overlaps(docs: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """(doc_id, version, source_id, removed): lines of `doc_id` also found in the earlier source.

    `version` is the hash of the text; `removed` holds line numbers from 0.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("version"),
        F.col("text").cast("string").alias("text"),
    ).where("doc_id is not null and text is not null")
    lined = cut(
        texts.mapInArrow(
            _line_hashes, "doc_id long, version long, lines array<long>, checks array<long>"
        ).dropDuplicates(["doc_id", "version"]),
        "lines",
    )
    runs = cut(
        lined.mapInArrow(_runs(min_block), "run long, doc_id long, version long").select(
            "run", F.struct("doc_id", "version").alias("doc")
        ),
        "runs",
    )
    # Written, so that the join below stands alone and Spark can split a frequent run.
    first = cut(
        runs.groupBy("run")
        .agg(F.min("doc").alias("source"), F.max("doc").alias("latest"))
        .where("source <> latest")
        .select("run", "source"),
        "holders",
    )
    pairs = cut(runs.join(first, "run").where("doc <> source").select("doc", "source").distinct(), "pairs")
    shares = cut(
        pairs.groupBy("source").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("shares")), "shares"
    )
    part = F.pmod(F.xxhash64("doc"), "shares").cast("int").alias("part")
    later = (
        pairs.join(shares, "source")
        .select("doc.*", "source", part)
        .join(lined, ["doc_id", "version"])
    )
    sources = (
        lined.join(shares, (F.col("source.doc_id") == F.col("doc_id")) & (F.col("source.version") == F.col("version")))
        .select(
            "source",
            F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"),
            F.col("lines").alias("source_lines"),
            F.col("checks").alias("source_checks"),
        )
    )
    return (
        later.join(sources, ["source", "part"])
        .withColumn("source_id", F.col("source.doc_id"))
        .mapInArrow(
            _aligned(min_block), "doc_id long, version long, source_id long, removed array<int>"
        )
    )


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, removed):
        if text is None or gone is None:
            out.append(None)
            continue
        gone, kept, after = set(gone.tolist()), [], False
        for k, line in enumerate(text.split("\n")):
            if k in gone:
                after = True
            elif line.strip(" \t\r\v\f") or not after:  # blank lines go with the block before
                kept.append(line)
                after = False
        out.append("\n".join(kept))
    return pd.Series(out, dtype=object)


def line_dedup(docs: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """`docs` with `text` freed of blocks that an earlier document holds.

    Earlier means a lower doc_id (then a lower hash of the text). Adds n_lines,
    n_removed (long) and source_ids (the earlier documents, sorted); columns of `docs`
    with these names are replaced. Blank lines are never compared and go with a block
    they follow. Null texts, empty texts and rows with a null doc_id stay as they are
    (n_lines 0 for a null). Rows that repeat doc_id and text are one document: none is
    the other's source and all lose the same lines. An empty table stays empty.
    """
    found = (
        overlaps(docs, min_block)
        .groupBy("doc_id", "version")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"),
            F.sort_array(F.collect_set("source_id")).alias("sources"),
        )
    )
    docs = docs.drop("n_lines", "n_removed", "source_ids")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("own"),
        F.xxhash64("text").alias("own_version"),
    )
    same = (F.col("own") == F.col("doc_id")) & (F.col("own_version") == F.col("version"))
    text = F.col("row.text")
    changed = _without(F.when(F.col("removed").isNotNull(), text), F.col("removed"))
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return rows.join(found, same, "left").select(
        *[
            F.coalesce(changed, text).alias("text") if c == "text" else F.col(f"row.`{c}`")
            for c in docs.columns
        ],
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sources", F.array().cast("array<long>")).alias("source_ids"),
    )
