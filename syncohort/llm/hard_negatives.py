"""Hard negatives of anchors, by an STR-packed R-tree whose pages are Spark rows.

Rows are tiled by label, slabs of one coordinate and the order of a second one, cut into
pages of bounded size, and packed further inside each page (`rtree.py`). Page boxes form
a directory. Anchors travel only to the pages whose box can hold something for them:
first for their positives, starting from the k-th score of the anchor's own page, then
with the positives' score windows for the negatives. A task holds one page and a block
of anchors at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncohort.lineage import cut
from syncohort.llm import rtree
from syncohort.llm.vectors import matrix, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Bytes of vectors in a page, anchors in a block, pages in a row of the directory. Results
#: do not depend on them.
PAGE_BYTES, BLOCK, CHUNK = 2 << 20, 256, 512
#: Scaled components beyond count as this.
LIMIT = 2.0**62

Batches = Iterator[pa.RecordBatch]

_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def _rows(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _scaled(lists: pa.Array, width: int) -> np.ndarray:
    return np.clip(np.floor(SCALE * matrix(lists.cast(pa.list_(pa.float64())), width)), -LIMIT, LIMIT)


def _spread(width: int) -> Callable[[Batches], Batches]:
    """Count, sum and sum of squares of every coordinate of a task's rows."""

    def add(batches: Batches) -> Batches:
        total = np.zeros((3, width))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding").cast(pa.list_(pa.float64())), width)
                total += [np.full(width, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), *[pa.array(t) for t in total]],
            names=["axis", "n", "total", "squares"],
        )

    return add


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


_PAGE = (
    "page long, low binary, high binary, label_low long, label_high long, "
    "ids binary, labels binary, vectors binary"
)


def _pages(width: int, most: int) -> Callable[[Batches], Batches]:
    """Consecutive rows of a sorted partition as pages of at most `most` rows."""

    def page(number: int, part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        x = _scaled(part.column("embedding").chunk(0), width)
        order = rtree.pack(x)
        x = x[order]
        ids, labels = (part.column(c).to_numpy()[order] for c in ("vec_id", "label"))
        (low,), (high,) = rtree.boxes(x, len(x))
        row = [
            number, _bytes(low), _bytes(high), int(labels.min()), int(labels.max()),
            _bytes(ids), _bytes(labels), _bytes(_narrow(x)),
        ]
        names = [c.split()[0] for c in _PAGE.split(", ")]
        return pa.RecordBatch.from_pylist([dict(zip(names, row))], _arrow(_PAGE))

    def cut_up(batches: Batches) -> Batches:
        number, rest = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= most:
                yield page(number, rest.slice(0, most))
                rest, number = rest.slice(most), number + 1
        if rest is not None and rest.num_rows:
            yield page(number, rest)

    return cut_up


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in schema.split(", "))])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) if np.abs(x).max(initial=0) < 2**24 else x


def _vectors(raw: bytes, count: int, width: int) -> np.ndarray:
    kind = np.float32 if len(raw) == 4 * count * width else np.float64
    return np.frombuffer(raw, kind).reshape(count, width)


def _page_of(row: dict, width: int) -> rtree.Page:
    ids = np.frombuffer(row["ids"], np.int64)
    return rtree.Page(
        _vectors(row["vectors"], len(ids), width), ids, np.frombuffer(row["labels"], np.int64)
    )


_BLOCK = (
    "home long, block int, spots binary, ids binary, labels binary, vectors binary, "
    "low binary, high binary, kth binary"
)


def _is_anchor(ids: np.ndarray, every: int) -> np.ndarray:
    return ids % every == 0


def _blocks(width: int, every: int, positives: int) -> Callable[[Batches], Batches]:
    """Anchors of every page, with the k-th score that their own page already gives."""

    def collect(batches: Batches) -> Batches:
        for row in _rows(batches):
            page = _page_of(row, width)
            spots = np.flatnonzero(_is_anchor(page.ids, every))
            for k, start in enumerate(range(0, len(spots), BLOCK)):
                some = spots[start : start + BLOCK]
                x, labels = page.rows[some], page.labels[some]
                shape = (len(some), 1)
                low, high, kth = (np.full(shape, v) for v in (rtree.LOWEST, rtree.NEVER, rtree.LOWEST))
                own = page.search(x, _same(page, labels, some), low, high, kth, positives)
                kth = own[0].kth(len(some), positives)[:, None]
                arrays = (some, page.ids[some], labels, x, low, high, kth)
                names = [c.split()[0] for c in _BLOCK.split(", ")]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, [row["page"], k, *map(_bytes, arrays)]))], _arrow(_BLOCK)
                )

    return collect


def _same(page: rtree.Page, labels: np.ndarray, spots: np.ndarray | None):
    """Rows of an anchor's label, but the anchor itself where `spots` says its place."""

    def allowed(some: np.ndarray, at: slice) -> np.ndarray:
        out = labels[some, None] == page.labels[None, at]
        if spots is not None:
            out &= spots[some, None] != np.arange(at.start, at.stop)
        return out

    return allowed


def _others(page: rtree.Page, labels: np.ndarray):
    return lambda some, at: labels[some, None] != page.labels[None, at]


_REQUEST = "page long, kind int, " + _BLOCK


def _asked(width: int, same: bool) -> Callable[[Batches], Batches]:
    """A block's anchors, for every page of a directory row that can matter to them."""

    def ask(batches: Batches) -> Batches:
        for row in _rows(batches):
            pages = np.array([p["page"] for p in row["chunk"]])
            box_low, box_high = (
                np.frombuffer(b"".join(p[c] for p in row["chunk"]), float).reshape(-1, width)
                for c in ("low", "high")
            )
            labels_low, labels_high = (
                np.array([p[c] for p in row["chunk"]]) for c in ("label_low", "label_high")
            )
            arrays = _block_arrays(row, width)
            x, labels = arrays["vectors"].astype(float), arrays["labels"][:, None]
            least, most = rtree.bounds(x, box_low, box_high)
            floor = np.maximum(arrays["low"], arrays["kth"])
            fits = np.zeros((len(x), len(pages)), bool)
            for j in range(floor.shape[1]):
                fits |= (most >= floor[:, j, None]) & (least <= arrays["high"][:, j, None])
            if same:
                fits &= (labels >= labels_low) & (labels <= labels_high)
            else:
                fits &= (labels != labels_low) | (labels != labels_high)
            out = []
            for p in np.flatnonzero(fits.any(0)).tolist():
                part = {n: _bytes(v[fits[:, p]]) for n, v in arrays.items()}
                out.append(
                    {"page": int(pages[p]), "kind": 1, "home": row["home"], "block": row["block"], **part}
                )
            if out:
                yield pa.RecordBatch.from_pylist(out, _arrow(_REQUEST))

    return ask


def _block_arrays(row: dict, width: int) -> dict[str, np.ndarray]:
    out = {c: np.frombuffer(row[c], np.int64) for c in ("spots", "ids", "labels")}
    count = len(out["ids"])
    out["vectors"] = _vectors(row["vectors"], count, width)
    for c in ("low", "high", "kth"):
        out[c] = np.frombuffer(row[c], np.int64).reshape(count, -1)
    return out


_HIT = "home long, block int, spot long, anchor_id long, window int, score long, id long"


def _searched(width: int, same: bool, count: int) -> Callable[[Batches], Batches]:
    """Requests of a page follow its row in the sorted partition."""

    def search(batches: Batches) -> Batches:
        page, number = None, None
        for row in _rows(batches):
            if row["kind"] == 0:
                page, number = _page_of(row, width), row["page"]
                continue
            arrays = _block_arrays(row, width)
            if same:
                own = arrays["spots"] if row["home"] == number else None
                allowed = _same(page, arrays["labels"], own)
            else:
                allowed = _others(page, arrays["labels"])
            found = page.search(
                arrays["vectors"], allowed, arrays["low"], arrays["high"], arrays["kth"], count
            )
            for j, best in enumerate(found):
                if len(best.anchor):
                    size = len(best.anchor)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(size, row["home"])),
                            pa.array(np.full(size, row["block"], np.int32)),
                            pa.array(arrays["spots"][best.anchor]),
                            pa.array(arrays["ids"][best.anchor]),
                            pa.array(np.full(size, j, np.int32)),
                            pa.array(best.score),
                            pa.array(best.id),
                        ],
                        names=[c.split()[0] for c in _HIT.split(", ")],
                    )

    return search


def _windowed(width: int, percent: int) -> Callable[[Batches], Batches]:
    """Blocks with a window per positive: percent * positive <= 100 * score <= 100 * positive."""

    def take(batches: Batches) -> Batches:
        for row in _rows(batches):
            arrays = _block_arrays(row, width)
            place = {int(s): k for k, s in enumerate(arrays["spots"])}
            shape = (len(place), max(p["rank"] for p in row["positives"]))
            low, high = np.full(shape, rtree.NEVER), np.full(shape, rtree.LOWEST)
            for p in row["positives"]:
                score, k = p["score"], place[p["spot"]]
                low[k, p["rank"] - 1] = -(-percent * score // 100)
                high[k, p["rank"] - 1] = score
            arrays |= {"low": low, "high": high, "kth": np.full(shape, rtree.LOWEST)}
            out = {n: _bytes(v) for n, v in arrays.items()}
            yield pa.RecordBatch.from_pylist(
                [{"home": row["home"], "block": row["block"], **out}], _arrow(_BLOCK)
            )

    return take


def _search(
    pages: DataFrame, directory: DataFrame, chunks: int, blocks: DataFrame, width: int, same: bool, count: int
) -> DataFrame:
    """The first `count` hits of every anchor and window over all pages, ranked."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    requests = (
        blocks.withColumn("chunk_no", every)
        .join(directory, "chunk_no")
        .mapInArrow(_asked(width, same), _REQUEST)
    )
    hits = (
        pages.drop("label_low", "label_high", "low", "high")
        .withColumn("kind", F.lit(0))
        .unionByName(requests, allowMissingColumns=True)
        .repartition("page")
        .sortWithinPartitions("page", "kind")
        .mapInArrow(_searched(width, same, count), _HIT)
    )
    first = Window.partitionBy("home", "spot", "window").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)


def hard_negatives(
    embeddings: DataFrame,
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `embeddings` has (vec_id, embedding, label, ...). A component x becomes
    floor(256 x) and scores are integer inner products; higher scores come first, ties
    by smaller vec_id. Anchors are the rows whose vec_id is divisible by `every`, their
    positives the first `positives` other rows of the same label. For each of them,
    the first `negatives` rows of another label with percent * positive_score <=
    100 * negative_score <= 100 * positive_score.

    Rows with a null label or vec_id, or a vector that is null or holds null or
    non-finite components, take no part. Vectors shorter than the longest end in zeros.
    Every row counts for itself: one that repeats an anchor is another row of its label
    and an anchor again. A positive without such negatives gives no row, nor does an
    empty table. Scores must fit a long; scaled components beyond 2^62 count as that.
    Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return spark.createDataFrame([], _RESULT)
    if width == 0:
        rows, width = rows.withColumn("embedding", F.array(F.lit(0.0))), 1

    spread = (
        rows.mapInArrow(_spread(width), "axis int, n double, total double, squares double")
        .groupBy("axis")
        .agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
        .withColumn("variance", F.expr("squares / n - (total / n) * (total / n)"))
        .orderBy(F.desc_nulls_last("variance"), "axis")
        .collect()
    )
    most = max(rtree.LEAF, PAGE_BYTES // (4 * width))
    n = int(spread[0]["n"])
    axes = [F.coalesce(F.try_element_at("embedding", F.lit(r["axis"] + 1)), F.lit(0.0)) for r in spread[:2]]
    slabs = math.ceil(math.sqrt(n / most))
    borders = []
    if slabs > 1:
        shares = [k / slabs for k in range(1, slabs)]
        borders = rows.agg(F.percentile_approx(axes[0], shares)).first()[0]
    slab = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= axes[0])) if borders else F.lit(0)
    pages = cut(
        rows.withColumn("_slab", slab)
        .withColumn("_next", axes[-1])
        .repartitionByRange("label", "_slab", "_next", "vec_id", F.xxhash64("embedding"))
        .sortWithinPartitions("label", "_slab", "_next", "vec_id")
        .mapInArrow(_pages(width, most), _PAGE),
        "pages",
    )
    chunks = max(1, math.ceil(pages.count() / CHUNK))
    directory = cut(
        pages.select("page", "low", "high", "label_low", "label_high")
        .withColumn("chunk_no", F.pmod(F.xxhash64("page"), F.lit(chunks)))
        .groupBy("chunk_no")
        .agg(F.collect_list(F.struct("page", "low", "high", "label_low", "label_high")).alias("chunk")),
        "directory",
    )
    blocks = cut(pages.mapInArrow(_blocks(width, every, positives), _BLOCK), "anchors")
    found = cut(_search(pages, directory, chunks, blocks, width, True, positives), "positives")
    per_block = found.groupBy("home", "block").agg(
        F.collect_list(F.struct("spot", "rank", "score")).alias("positives")
    )  # at most BLOCK * positives entries
    windowed = blocks.join(per_block, ["home", "block"]).mapInArrow(_windowed(width, percent), _BLOCK)
    worse = _search(pages, directory, chunks, windowed, width, False, negatives)
    return worse.select(
        "home", "spot", (F.col("window") + 1).alias("positive_rank"), "rank",
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    ).join(
        found.select(
            "home", "spot", F.col("rank").alias("positive_rank"), "anchor_id",
            F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        ),
        ["home", "spot", "positive_rank"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
