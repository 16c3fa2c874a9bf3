"""Nearest records, exact matches and the similarity metrics built on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncohort.functions.columns import ratio, run_keys
from syncohort.lineage import cut
from syncohort.operators.attack import split_reference, with_member
from syncohort.operators.blocks import (
    BLOCK_ROWS,
    Page,
    block_pairs,
    box_distances,
    curve_position,
    into_blocks,
    nearest_block,
    points_of,
    tiled,
    tiles_of,
)
from syncohort.operators.cohort import column_ranges, spread_over_runs
from syncohort.operators.stats import top_k
from syncohort.settings import RUN, StudySettings

_DEFAULTS = StudySettings()

#: Stands for a missing category, which equals only itself.
_MISSING_CATEGORY = -1.0e300


def _coordinates(
    frame: DataFrame,
    ranges: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keys: Sequence[str],
) -> DataFrame:
    """(keys, id, x): numeric features divided by their range, then category codes."""

    def scaled(c: str) -> Column:
        span = F.col(f"_span_{c}")
        value = (F.col(c).cast("double") - F.col(f"_min_{c}")) / F.nullif(span, F.lit(0.0))
        return F.when(span > 0, value).otherwise(F.lit(0.0))

    codes = [
        F.coalesce(F.col(c).cast("double"), F.lit(_MISSING_CATEGORY)) for c in categorical
    ]
    complete = frame.dropna(subset=list(numeric)) if numeric else frame
    return complete.join(ranges, list(keys)).select(
        *keys, "id", F.array(*[scaled(c) for c in numeric], *codes).alias("x")
    )


def _place(numeric: int, total: int) -> Column:
    """Sort key: categories first, then the curve through the numeric features."""
    nothing = F.lit(0).cast("bigint")
    category = F.xxhash64(*[F.col("x")[i] for i in range(numeric, total)])
    return F.struct(
        (category if total > numeric else nothing).alias("c"),
        (curve_position([f"x[{i}]" for i in range(numeric)]) if numeric else nothing).alias("z"),
    )


def _mean_difference(gap: np.ndarray, numeric: int) -> np.ndarray:
    """Mean over features of numeric gaps and of 0/1 for any gap between categories."""
    total = gap[:, :numeric].sum(axis=1) + (gap[:, numeric:] > 0).sum(axis=1)
    return total / gap.shape[1]


def _gower_bounds(numeric: int, wanted: int):
    def bounds(qlo: np.ndarray, qhi: np.ndarray, page: Page):
        gap = np.maximum(0.0, np.maximum(page.lo - qhi, qlo - page.hi))
        lower = _mean_difference(gap, numeric)
        upper = _mean_difference(np.maximum(page.hi - qlo, qhi - page.lo), numeric)
        # A block with enough points bounds the distance to the last wanted neighbour.
        enough = page.counts >= wanted
        if enough.any():
            limit = upper[enough].min() * (1 + 1e-9) + 1e-9
            lower = np.where(lower <= limit, lower, np.inf)
        return lower, upper

    return bounds


def _gower(queries: np.ndarray, data: np.ndarray, numeric: int) -> np.ndarray:
    """All distances of two blocks. Rounded, so that ties do not depend on summation."""
    out = np.zeros((len(queries), len(data)))
    for j in range(queries.shape[1]):
        difference = queries[:, j, None] - data[None, :, j]
        out += np.abs(difference) if j < numeric else difference != 0
    return np.round(out / queries.shape[1], 12)


def _smallest(distance: np.ndarray, ids: np.ndarray, wanted: int):
    """The `wanted` smallest distances per row and their ids; `ids` ascend, so ties
    go to the smaller id. Changes `distance`."""
    rows = np.arange(len(distance))
    found_d, found_i = [], []
    for _ in range(min(wanted, len(ids))):
        best = distance.argmin(axis=1)
        found_d.append(distance[rows, best])
        found_i.append(ids[best])
        distance[rows, best] = np.inf
    return np.stack(found_d, axis=1), np.stack(found_i, axis=1)


#: Points of a block that are compared at once.
_CHUNK = 128
_TOLERANCE = 1e-9


def _add_nearest(
    best: tuple[np.ndarray, np.ndarray], queries: np.ndarray, ids: np.ndarray, data: np.ndarray,
    limits: np.ndarray, numeric: int,
) -> None:
    """Merge the nearest points of a block of data into `best`, (distances, ids) per query.

    Points follow the curve, so chunks of them have boxes of their own: the nearest come
    first, and only queries that a box may still serve are compared with its points.
    Points beyond the `limits` may be missing.
    """
    found, found_ids = best
    wanted = found.shape[1]
    starts = np.arange(0, len(data), _CHUNK)
    lo, hi = np.minimum.reduceat(data, starts), np.maximum.reduceat(data, starts)
    chunks = []
    for start in starts:
        order = start + np.argsort(ids[start : start + _CHUNK])
        chunks.append((ids[order], data[order]))
    for start in range(0, len(queries), _CHUNK):
        part = slice(start, start + _CHUNK)
        x, known, known_ids, limit = queries[part], found[part], found_ids[part], limits[part]
        gap = np.maximum(0.0, np.maximum(lo - x.max(axis=0), x.min(axis=0) - hi))
        lower = _mean_difference(gap, numeric)
        for j in np.argsort(lower, kind="stable"):
            reach = np.minimum(limit, known[:, -1]) + _TOLERANCE
            if lower[j] > reach.max():
                break
            gap = np.maximum(0.0, np.maximum(lo[j] - x, x - hi[j]))
            rows = np.flatnonzero(_mean_difference(gap, numeric) <= reach)
            if not len(rows):
                continue
            own_ids, own = chunks[j]
            distance, did = _smallest(_gower(x[rows], own, numeric), own_ids, wanted)
            distance = np.concatenate([known[rows], distance], axis=1)
            did = np.concatenate([known_ids[rows], did], axis=1)
            order = np.lexsort((did, distance))[:, :wanted]
            known[rows] = np.take_along_axis(distance, order, 1)
            known_ids[rows] = np.take_along_axis(did, order, 1)


def _nothing_yet(count: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.full((count, wanted), np.inf),
        np.full((count, wanted), np.iinfo(np.int64).max, np.int64),
    )


def _search(
    queries: DataFrame,
    data: DataFrame,
    keys: Sequence[str],
    numeric: int,
    dims: int,
    wanted: int,
) -> DataFrame:
    """(keys, qid, distance, did): at least the `wanted` nearest data points per query."""
    keys = list(keys)
    key_fields = [queries.schema[k] for k in keys]
    candidates = box_distances(queries, data, keys, _gower_bounds(numeric, wanted))
    first = nearest_block(candidates, keys)
    first_schema = T.StructType(
        [
            *key_fields,
            T.StructField("q_block", T.LongType()),
            T.StructField("d_block", T.LongType()),
            T.StructField("worst", T.DoubleType()),
            T.StructField("limits", T.BinaryType()),
            T.StructField("qid", T.ArrayType(T.LongType())),
            T.StructField("distance", T.ArrayType(T.DoubleType())),
            T.StructField("did", T.ArrayType(T.LongType())),
        ]
    )

    def evaluate_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                qids, qx, _ = points_of(row, dims, "q_")
                dids, dx, _ = points_of(row, dims, "d_")
                best = _nothing_yet(len(qids), wanted)
                _add_nearest(best, qx, dids, dx, np.full(len(qids), np.inf), numeric)
                distance, did = (b[:, : min(wanted, len(dids))] for b in best)
                limits = best[0][:, -1]
                out = {k: getattr(row, k) for k in (*keys, "q_block", "d_block")}
                out |= {
                    "worst": float(limits.max()),
                    "limits": limits.tobytes(),
                    "qid": np.repeat(qids, distance.shape[1]),
                    "distance": distance.ravel(),
                    "did": did.ravel(),
                }
                yield pd.DataFrame([out])[first_schema.names]

    # Written out: it feeds both the result and the choice of further blocks.
    pilot = cut(
        block_pairs(first, queries, data, keys).mapInPandas(evaluate_first, first_schema), "pilot"
    )

    payload = pilot.select(*keys, "q_block", F.col("d_block").alias("done"), "worst", "limits")
    further = candidates.join(payload, [*keys, "q_block"]).filter(
        (F.col("d_block") != F.col("done")) & (F.col("lower") <= F.col("worst") + _TOLERANCE)
    )
    rest_schema = T.StructType(
        [
            *key_fields,
            T.StructField("qid", T.LongType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("did", T.LongType()),
        ]
    )

    def evaluate_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, rows, others in tiles_of(batches, keys):
            own = []
            for row in rows:
                qids, qx, _ = points_of(row, dims)
                box = qx.min(axis=0), qx.max(axis=0)
                limits = np.frombuffer(row.limits)
                own.append((row, qids, qx, box, limits, _nothing_yet(len(qids), wanted)))
            for other in others:
                dids, dx, _ = points_of(other, dims)
                lo, hi = dx.min(axis=0), dx.max(axis=0)
                for row, _, qx, box, limits, best in own:
                    gap = np.maximum(0.0, np.maximum(lo - box[1], box[0] - hi))
                    lower = _mean_difference(gap[None, :], numeric)[0]
                    if other.block != row.done and lower <= row.worst + _TOLERANCE:
                        _add_nearest(best, qx, dids, dx, limits, numeric)
            for _, qids, _, _, limits, (distance, did) in own:
                better = np.isfinite(distance) & (distance <= limits[:, None] + _TOLERANCE)
                out = dict(zip(keys, run)) | {
                    "qid": np.repeat(qids, wanted)[better.ravel()],
                    "distance": distance[better],
                    "did": did[better],
                }
                yield pd.DataFrame(out)[rest_schema.names]

    near = pilot.select(*keys, F.inline(F.arrays_zip("qid", "distance", "did")))
    more = tiled(further, queries, data, keys, payload).mapInPandas(evaluate_tiles, rest_schema)
    return near.select(*rest_schema.names).unionByName(more)


def nearest_records(
    data: DataFrame,
    samples: DataFrame,
    numeric: Sequence[str] = _DEFAULTS.numeric,
    categorical: Sequence[str] = _DEFAULTS.categorical,
    k: int = 1,
    keys: Sequence[str] = RUN,
    scaling: DataFrame | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k records of `data` closest to each row of `samples`: (keys, id, rank, neighbour, distance).

    The distance is the mean over features of the absolute difference divided by
    the range (numeric) and of 0/1 for equal/different (categorical). Ranges are
    taken per run over data, samples and `scaling`; a range of 0 contributes 0.
    Distances are rounded to twelve decimals; ties go to the smaller id. Ids are
    integers; categories are integer codes.

    Equal records are searched once, however many there are. Data without all
    numeric features cannot be a neighbour; samples without them get one row of rank 1
    without neighbour and distance.
    """
    keys = run_keys(samples.columns, keys)
    numeric, categorical = list(numeric), list(categorical)
    features = len(numeric) + len(categorical)
    data = spread_over_runs(data, samples, keys)
    frames = [data, samples] + ([] if scaling is None else [spread_over_runs(scaling, samples, keys)])
    ranges = column_ranges(frames, numeric, keys)

    def points(frame: DataFrame) -> DataFrame:
        return _coordinates(frame, ranges, numeric, categorical, keys)

    wanted = k + 1 if exclude_self else k
    place = _place(len(numeric), features)
    rows = points(samples)
    distinct = rows.groupBy(*keys, "x").agg(F.min("id").alias("pid"))
    # Of equal data records only the first few ids can appear in a result.
    if wanted == 1:
        stock = points(data).groupBy(*keys, "x").agg(F.min("id").alias("pid"))
    else:
        stock = (
            top_k(points(data), [*keys, "x"], [F.col("id")], wanted, "_copy")
            .withColumnRenamed("id", "pid")
            .drop("_copy")
        )

    def blocked(frame: DataFrame, tag: str) -> DataFrame:
        placed = frame.withColumns({"w": F.lit(1.0), "place": place})
        return into_blocks(placed, keys, block_rows, tag)

    found = _search(
        blocked(distinct, "q"), blocked(stock, "d"), keys, len(numeric), features, wanted
    )
    entry = F.struct("distance", F.col("did").alias("neighbour"))
    if wanted == 1:
        best = found.groupBy(*keys, "qid").agg(F.min(entry).alias("best"))
        lists = best.select(*keys, "qid", F.array("best").alias("best"))
    else:
        near = top_k(found, [*keys, "qid"], [F.col("distance"), F.col("did")], wanted, "_rank")
        lists = near.groupBy(*keys, "qid").agg(F.sort_array(F.collect_list(entry)).alias("best"))
    # Back from distinct records to rows: equal records share one result.
    by_record = distinct.join(
        lists.withColumnRenamed("qid", "pid"), [*keys, "pid"]
    ).select(*keys, "x", "best")
    out = rows.join(by_record, [*keys, "x"])
    if exclude_self:
        out = out.withColumn("best", F.filter("best", lambda b: b["neighbour"] != F.col("id")))
    ranked = out.select(*keys, "id", F.posexplode(F.slice("best", 1, k)).alias("rank", "b"))
    found = ranked.select(
        *keys,
        "id",
        (F.col("rank") + 1).alias("rank"),
        F.col("b.neighbour").alias("neighbour"),
        F.col("b.distance").alias("distance"),
    )
    if not numeric:
        return found
    missing = F.lit(False)
    for c in numeric:
        missing = missing | F.col(c).isNull()
    # Incomplete samples stay in the result, with nothing known about their neighbours.
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("neighbour", "distance")]
    incomplete = samples.filter(missing).select(*keys, "id", F.lit(1).alias("rank"), *nothing)
    return found.unionByName(incomplete)


def _distinct_records(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.select(*columns).distinct()


def exact_match(
    real: DataFrame, synthetic: DataFrame, features: Sequence[str], keys: Sequence[str] = RUN
) -> DataFrame:
    """Synthetic rows identical to some real row; missing equals missing."""
    keys = run_keys(synthetic.columns, keys)
    own = run_keys(real.columns, keys)
    seen = _distinct_records(real, [*own, *features])
    right = seen.select(*[F.col(c).alias(f"_r_{c}") for c in seen.columns])
    condition = F.lit(True)
    for c in [*own, *features]:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return synthetic.join(right, condition, "left_semi")


def identical_match_share(
    real: DataFrame, synthetic: DataFrame, features: Sequence[str], keys: Sequence[str] = RUN
) -> DataFrame:
    """Share of synthetic rows identical to a real row.

    Synthetic rows are counted per distinct record before the match, so a record
    that occurs very often is one row of the join.
    """
    keys = run_keys(synthetic.columns, keys)
    counts = synthetic.groupBy(*keys, *features).agg(F.count("*").alias("n"))
    own = run_keys(real.columns, keys)
    seen = _distinct_records(real, [*own, *features])
    right = seen.select(F.lit(1).alias("_hit"), *[F.col(c).alias(f"_r_{c}") for c in seen.columns])
    condition = F.lit(True)
    for c in [*own, *features]:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    matched = counts.join(right, condition, "left")
    hits = F.sum(F.when(F.col("_hit") == 1, F.col("n")).otherwise(0))
    return matched.groupBy(*keys).agg(ratio(hits, F.sum("n")).alias("ims"))


def closest_distance(
    data: DataFrame, samples: DataFrame, keys: Sequence[str] = RUN, **options
) -> DataFrame:
    """(keys, id, distance) to the closest record of `data`."""
    return nearest_records(data, samples, keys=keys, **options).drop("rank", "neighbour")


def mean_closest_distance(
    real: DataFrame, synthetic: DataFrame, keys: Sequence[str] = RUN, **options
) -> DataFrame:
    """Mean distance from synthetic rows to their closest real record."""
    keys = run_keys(synthetic.columns, keys)
    near = closest_distance(real, synthetic, keys, **options)
    return near.groupBy(*keys).agg(F.avg("distance").alias("dcr"))


def identifiability_score(
    real: DataFrame, synthetic: DataFrame, keys: Sequence[str] = RUN, **options
) -> DataFrame:
    """Share of real rows strictly closer to a synthetic row than to another real row."""
    keys = run_keys(synthetic.columns, keys)
    people = spread_over_runs(real, synthetic, keys)
    to_synthetic = closest_distance(synthetic, people, keys, **options)
    to_real = closest_distance(
        people, people, keys, scaling=synthetic, exclude_self=True, **options
    )
    both = to_synthetic.withColumnRenamed("distance", "to_synthetic").join(
        to_real.withColumnRenamed("distance", "to_real"), [*keys, "id"], "left"
    )
    closer = F.coalesce(F.col("to_synthetic") < F.col("to_real"), F.lit(False))
    return both.groupBy(*keys).agg(F.avg(closer.cast("double")).alias("id_score"))


def distance_scores(
    real: DataFrame, synthetic: DataFrame, keys: Sequence[str] = RUN, **options
) -> DataFrame:
    """Membership score: the closer a synthetic record, the higher."""
    keys = run_keys(synthetic.columns, keys)
    near = closest_distance(synthetic, real, keys, **options)
    flags = with_member(real).select(*keys, "id", "member")
    return flags.join(near, [*keys, "id"]).select(
        *keys, "id", "member", (-F.col("distance")).alias("score")
    )


def calibrated_distance_scores(
    real: DataFrame,
    synthetic: DataFrame,
    keys: Sequence[str] = RUN,
    uniform: Column | None = None,
    **options,
) -> DataFrame:
    """Distance to the reference minus distance to the synthetic table."""
    keys = run_keys(synthetic.columns, keys)
    tested, reference = split_reference(real, uniform, keys)
    to_synthetic = closest_distance(synthetic, tested, keys, **options)
    to_reference = closest_distance(reference, tested, keys, **options)
    flags = with_member(tested).select(*keys, "id", "member")
    return (
        flags.join(to_synthetic.withColumnRenamed("distance", "d_synth"), [*keys, "id"])
        .join(to_reference.withColumnRenamed("distance", "d_ref"), [*keys, "id"])
        .select(
            *keys, "id", "member", F.round(F.col("d_ref") - F.col("d_synth"), 12).alias("score")
        )
    )
