"""Running totals and row numbers over groups of any size, by a scan of sorted ranges.

A window over a whole run would put that run into one task. Here the rows are dealt into
ranges of (group, order) of even size and written in that order. Every range adds up its
own rows; what the earlier ranges of a group hold together is a table with a row per
range and group, which gives each range its starting offset. A group may span any
number of ranges, and a range any number of groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncohort.lineage import cut

#: Ranges that rows are dealt into: Spark's shuffle partitions, which follow the data.
SPLITS = 0


def ranges(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`frame` with `_range`: ascending numbers of ranges of about equal size.

    The rows are written, so every later step sees the same ranges.
    """
    dealt = frame.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, str | Column],
    descending: bool = False,
    splits: int | None = SPLITS,
) -> DataFrame:
    """Add inclusive running sums of `totals` along `order` within `keys`.

    `frame` must hold one row per (keys, order): aggregate first, so that a hot
    value is one row. No keys make all rows one group. With `splits=None` a plain
    window is used; only for groups whose size is bounded by the study design.
    """
    keys = list(keys)
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    measures = {n: F.col(c) if isinstance(c, str) else c for n, c in totals.items()}
    if splits is None:
        window = (
            Window.partitionBy(*keys)
            .orderBy(*sort)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return frame.select("*", *[F.sum(c).over(window).alias(n) for n, c in measures.items()])

    ranged = ranges(frame, keys, order)
    range_sort = F.col("_range").desc() if descending else F.col("_range").asc()
    # A group has a row per range it reaches into, the whole table at most one more per group.
    before = Window.partitionBy(*keys).orderBy(range_sort).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    offsets = cut(
        sums.select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.col("_range").alias("_at"),
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in measures],
        ),
        "offsets",
    )
    within = (
        Window.partitionBy("_range", *keys)
        .orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    own = F.col("_range") == F.col("_at")
    for key in keys:
        own = own & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    numbered = ranged.select("*", *[F.sum(c).over(within).alias(f"_own_{n}") for n, c in measures.items()])
    return numbered.join(offsets, own).select(
        *frame.columns,
        *[(F.col(f"_before_{n}") + F.col(f"_own_{n}")).alias(n) for n in measures],
    )


def row_numbers(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    splits: int | None = SPLITS,
) -> DataFrame:
    """Number the rows of each group 1..n; `order` must be unique within a group."""
    return running_totals(frame, keys, order, {name: F.lit(1).cast("bigint")}, splits=splits)
