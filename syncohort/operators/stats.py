"""Summaries shared by all metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncohort.functions.columns import as_column, format_fixed, format_interval, ratio
from syncohort.functions.ordered import SPLITS, running_totals
from syncohort.lineage import join_constants


def percentile_type2(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Mapping[str, int],
    splits: int | None = SPLITS,
) -> DataFrame:
    """Percentiles that average the two neighbours when n*p is whole.

    Rows are first counted per distinct value. Ranks use integers, so n*p is
    whole exactly when it should be.
    """
    keys = list(keys)
    counts = (
        frame.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count("*").alias("_c"))
    )
    ranked = running_totals(counts, keys, ["_x"], {"_upto": "_c"}, splits=splits)
    if splits is None:
        ranked = ranked.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    else:
        sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        ranked = join_constants(ranked, sizes, keys)

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col("_x")))

    def percentile(percent: int) -> Column:
        product = F.col("_n") * F.lit(percent)
        lower_rank = F.greatest(-F.floor(-product / F.lit(100)), F.lit(1))
        upper_rank = F.floor(product / F.lit(100)) + 1
        lower = at_rank(lower_rank)
        return (lower + F.coalesce(at_rank(upper_rank), F.max("_x"))) / F.lit(2.0)

    return ranked.groupBy(*keys).agg(*[percentile(p).alias(n) for n, p in percents.items()])


def summary_median_iqr(
    metrics: DataFrame, keys: Sequence[str], value: str, digits: int | None = None
) -> DataFrame:
    """Median and quartiles over runs; with `digits` also as text `med (p25, p75)`.

    There are as many rows per group as runs, so plain windows are bounded.
    """
    out = percentile_type2(metrics, keys, value, {"med": 50, "p25": 25, "p75": 75}, splits=None)
    if digits is None:
        return out
    return out.withColumn(
        "text",
        format_interval(*[format_fixed(c, digits) for c in ("med", "p25", "p75")]),
    )


def summary_median_range(
    metrics: DataFrame, keys: Sequence[str], value: str, digits: int | None = None
) -> DataFrame:
    """Median, minimum and maximum over runs."""
    median = percentile_type2(metrics, keys, value, {"med": 50}, splits=None)
    limits = metrics.groupBy(*keys).agg(
        F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high")
    )
    out = median.join(limits, list(keys))
    if digits is None:
        return out
    return out.withColumn(
        "text", format_interval(*[format_fixed(c, digits) for c in ("med", "low", "high")])
    )


def sum_by_run(metrics: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.sum(value).alias(value))


def mean_by(metrics: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def metric_mean_sd(metrics: DataFrame, keys: Sequence[str], model: str, value: str) -> DataFrame:
    """Mean and population sd over runs per model, and the limits over all models."""
    groups = [*keys, model]
    per_model = metrics.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    limits = per_model.groupBy(*keys).agg(
        F.min(F.col("mean") - F.col("sd")).alias("ylim_low"),
        F.max(F.col("mean") + F.col("sd")).alias("ylim_high"),
    )
    return per_model.join(limits, list(keys))


def class_metric_mean_sd(
    metrics: DataFrame, keys: Sequence[str], model: str, sim: str, klass: str, value: str
) -> DataFrame:
    """Mean over classes of the class means, and sd over runs of the class averages."""
    groups = [*keys, model]
    by_class = metrics.groupBy(*groups, klass).agg(F.avg(value).alias("class_mean"))
    means = by_class.groupBy(*groups).agg(F.avg("class_mean").alias("mean"))
    by_run = metrics.groupBy(*groups, sim).agg(F.avg(value).alias("_run_mean"))
    spread = by_run.groupBy(*groups).agg(F.stddev_pop("_run_mean").alias("sd"))
    return means.join(spread, groups)


def two_way_counts(
    frame: DataFrame, keys: Sequence[str], value: str | Column, flag: str = "synth"
) -> DataFrame:
    return frame.groupBy(*keys, as_column(value)).agg(
        F.count_if(F.col(flag) == 0).alias("n_real"),
        F.count_if(F.col(flag) == 1).alias("n_synth"),
    )


def describe(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count, range, mean and number of levels, one row per group and column."""
    levels = frame.unpivot(
        [F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns],
        "variable", "value",
    ).groupBy(*keys, "variable", "value").agg(F.count("value").alias("_c"))
    return levels.filter(F.col("value").isNotNull()).groupBy(*keys, "variable").agg(
        F.sum("_c").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.count("*").alias("levels"),
    )


def correlation_matrix(
    frame: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Pearson correlations of column pairs over complete rows, in one aggregation."""
    pairs = list(combinations(columns, 2)) if pairs is None else list(pairs)
    complete = frame.dropna(subset=list(columns)).select(
        *keys, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    moments = complete.groupBy(*keys).agg(
        *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns],
        *[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs],
    )
    # Rows first, then the division: one expression instead of one per pair.
    long = moments.unpivot(
        [*keys, *[f"_sd_{c}" for c in columns]], [f"`{a}|{b}`" for a, b in pairs], "pair", "cov"
    )
    names = F.split("pair", r"\|")
    spread = F.create_map(
        *[part for c in columns for part in (F.lit(c), F.col(f"_sd_{c}"))]
    )
    return (
        long.select(*keys, names[0].alias("a"), names[1].alias("b"), "cov", spread.alias("_sd"))
        .select(
            *keys, "a", "b", "cov",
            (F.col("_sd")[F.col("a")] * F.col("_sd")[F.col("b")]).alias("_scale"),
        )
        .select(*keys, "a", "b", ratio("cov", "_scale").alias("r"))
    )


def with_group_stats(
    frame: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]
) -> DataFrame:
    """Group statistics kept on every row: aggregate, then join back.

    Map-side aggregation and a join that leaves the rows where they are beat a window when
    one group holds a large share of the rows.
    """
    totals = frame.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return join_constants(frame, totals, keys)


def dedupe_first(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """The first row per key along `order`, as an aggregate (partial results combine)."""
    first = frame.groupBy(*keys).agg(F.min(F.struct(*order, *keep)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *keep]])


def first_last(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], value: str
) -> DataFrame:
    """First and last value of each group along `order`; a missing order value is last."""
    position = F.struct(
        *[part for c in order for part in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    )
    return frame.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value)), position)[value].alias("first"),
        F.max_by(F.struct(F.col(value)), position)[value].alias("last"),
    )


def separate_by_model(
    metrics: DataFrame, ids: Sequence[str], value: str, models: Sequence[int]
) -> DataFrame:
    """One column per model, `<value><model>`."""
    wide = metrics.groupBy(*ids).pivot("model", list(models)).agg(F.first(value))
    return wide.select(*ids, *[F.col(f"`{m}`").alias(f"{value}{m}") for m in models])


def row_range(columns: Sequence[str]) -> tuple[Column, Column]:
    """Row-wise minimum and maximum, missing values skipped."""
    return F.least(*columns), F.greatest(*columns)


def with_running_probability(
    table: DataFrame, keys: Sequence[str], order: str, prob: str, name: str = "cum"
) -> DataFrame:
    """Cumulative category probability; groups are as long as the list of categories."""
    return running_totals(table, keys, [order], {name: prob}, splits=None)


def merge_results(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer 1:1 join of two result tables; a repeated key stops the job."""

    def unique(frame: DataFrame) -> DataFrame:
        rest = [c for c in frame.columns if c not in on]
        grouped = frame.groupBy(*on).agg(
            F.count("*").alias("_copies"), *[F.any_value(c).alias(c) for c in rest]
        )
        return (
            grouped.withColumn(
                "_copies",
                F.when(F.col("_copies") == 1, F.col("_copies")).otherwise(
                    F.raise_error(F.lit("key is not unique")).cast("bigint")
                ),
            )
            .filter("_copies = 1")
            .drop("_copies")
        )

    return unique(left).join(unique(right), list(on), "full_outer")


def median_run(metrics: DataFrame, keys: Sequence[str], value: str, sim: str = "sim") -> DataFrame:
    """Run whose value is closest to the group's median, ties by run number."""
    medians = percentile_type2(metrics, keys, value, {"med": 50}, splits=None)
    near = metrics.filter(F.col(value).isNotNull()).join(medians, list(keys))
    # Rounded: of two runs at the same distance, the lower number counts.
    gap = F.round(F.abs(F.col(value) - F.col("med")), 12)
    return near.groupBy(*keys).agg(
        F.min(F.struct(gap.alias("gap"), F.col(sim), F.col(value), F.col("med"))).alias("_best")
    ).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (sim, value, "med")])


def top_k(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows per group; Spark cuts every task's groups to k before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
