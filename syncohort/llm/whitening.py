"""Whitening of embeddings on their leading principal components.

Entries become integers, so that sums and products over all vectors are exact wherever
the rows are. Tasks add up the moments of the distinct vectors, of which only the sums
reach the driver: as many numbers as a covariance matrix has. `eigen.py` takes the
components out of it by contour integration; tasks then project every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncohort.lineage import cut
from syncohort.llm import eigen
from syncohort.llm.vectors import matrix, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Integers before the shift are at most this large; entries beyond count as the limit.
LIMIT = 2**36
#: Components with less than this share of the variance count as none.
LEAST = 1e-12
#: Rows handled at once.
ROWS = 2048

_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, "
    "explained double, identity_error double"
)


def _integers(lists: pa.Array, width: int) -> np.ndarray:
    scaled = np.floor(SCALE * matrix(lists.cast(pa.list_(pa.float64())), width))
    return np.clip(scaled, -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _packed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id and the integers as bytes: two bytes each where that is enough for a vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                numbers = _integers(part.column("embedding"), width) - SHIFT
                short = np.abs(numbers).max(1, initial=0) < 2**15
                low = numbers.astype("<i2")
                keys = [
                    (low if s else numbers)[k].tobytes() for k, s in enumerate(short.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(keys, pa.binary())], names=["vec_id", "x"]
                )

    return pack


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k] = np.frombuffer(row, "<i2" if len(row) == 2 * width else "<i8")
    return out + SHIFT


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _unpacked(part.column("x"), width)


def _products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows of integers, exact, as Python integers."""
    most = int(np.abs(rows).max(initial=0))
    if len(rows) * most**2 < 2**53:
        rows = rows.astype(float)
        return (rows.T @ rows).astype(np.int64).astype(object)
    rows = rows.astype(object)
    return rows.T @ rows


def _exact(of: Callable[[np.ndarray], np.ndarray], width: int, kind: pa.DataType):
    """Sums of `of(rows)` over a task's rows: a (place, total) row for each place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, rows in _chunks(batches, width):
            total = of(rows) if total is None else total + of(rows)
        if total is not None:
            values = total.tolist()
            if pa.types.is_decimal(kind):
                values = [Decimal(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()), pa.array(values, kind)],
                names=["place", "total"],
            )

    return add


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, exact: bool = True) -> list:
    kind, sql = (pa.decimal128(38, 0), "decimal(38,0)") if exact else (pa.float64(), "double")
    rows = (
        fit.mapInArrow(_exact(of, width, kind), f"place int, total {sql}")
        .groupBy("place")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    found = {r["place"]: r["total"] for r in rows}
    return [int(found[k]) if exact else found[k] for k in range(len(found))]


def _triangle(square: np.ndarray) -> np.ndarray:
    return square[np.triu_indices(len(square))]


def _square(triangle: list, width: int, kind=object) -> np.ndarray:
    out = np.zeros((width, width), kind)
    out[np.triu_indices(width)] = triangle
    return out + np.triu(out, 1).T


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; null where that is more than a long holds."""
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums))
    if len(sums) * most**2 < 2**63:
        away = n * rows - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    away = n * rows.astype(object) - np.array(sums, object)
    return [v if v < 2**63 else None for v in (away * away).sum(1).tolist()]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows of `embeddings` (vec_id, embedding, ...) whose vector is null or holds null or
    non-finite entries drop out. An entry c becomes x = floor(64 c) + 1000000. The fit
    list is each distinct x vector once, n of them with sums S. Each remaining row
    gives one row per component, numbered from 1 by falling eigenvalue e of the fit
    list's covariance: deviation, the sum of (n x - S)^2 (null where a long cannot hold
    it); whitened, (x - S/n) along the component over sqrt(e); explained, e over the sum
    of all eigenvalues. identity_error is the largest entry of whitened's covariance over
    the fit list minus the identity.

    Vectors shorter than the longest one end in zeros. Entries beyond 2^30 count as that.
    Components without variance (rank, fewer distinct vectors than dimensions) are left
    out, so equal vectors alone, a single row and an empty table give no rows. Rows that
    repeat a vec_id or vector, or have a null vec_id, are projected one by one. The
    driver holds a few width x width matrices. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(usable())
    empty = spark.createDataFrame([], _SCHEMA)
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return empty
    packed = cut(rows.mapInArrow(_packed(width), "vec_id long, x binary"), "vectors")
    fit = cut(packed.select("x").distinct(), "distinct")

    n, *sums = _summed(
        fit, lambda x: np.concatenate([[len(x)], x.sum(0)]).astype(object), width
    )
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * c for s, c in zip(sums, centre.tolist())], object)
    gram = _square(_summed(fit, lambda x: _triangle(_products(x - centre)), width), width)
    # n^2 times the covariance, exact; the division rounds once.
    covariance = ((n * gram - np.outer(rest, rest)) / (n * n)).astype(float)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return empty
    rank = eigen.above(eigen.tridiagonal(covariance), LEAST * trace)
    values, directions = eigen.leading(covariance, min(components, rank))
    mean = (rest / n).astype(float)
    to_unit = directions / np.sqrt(values)
    kept, explained = len(values), values / trace

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - mean) @ to_unit

    def second_moments(x: np.ndarray) -> np.ndarray:
        z = project(x)
        return np.concatenate([z.sum(0), _triangle(z.T @ z)])

    moments = _summed(fit, second_moments, width, exact=False)
    first = np.array(moments[:kept]) / n
    second = _square(moments[kept:], kept, float) / n
    error = float(np.abs(second - np.outer(first, first) - np.eye(kept)).max())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches, width):
            count = len(x)
            deviation = pa.array(_deviations(x, n, sums), pa.int64())
            each = pa.array(np.repeat(np.arange(count), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * kept, n)),
                    deviation.take(each),
                    pa.array(project(x).reshape(-1)),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * kept, error)),
                ],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )

    return packed.mapInArrow(rows_of, _SCHEMA)
