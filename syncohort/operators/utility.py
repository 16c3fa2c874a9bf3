"""How close synthetic tables are to the real one."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.functions.columns import (
    bin_index,
    format_interval,
    format_scientific,
    ratio,
    run_keys,
)
from syncohort.operators.cohort import one_hot, spread_over_runs
from syncohort.operators.stats import (
    correlation_matrix,
    merge_results,
    percentile_type2,
    sum_by_run,
    summary_median_iqr,
    with_group_stats,
)
from syncohort.settings import RUN, StudySettings

PLAIN = ("stage", "sex", "daar", "status")
BINNED = ("age", "t")
CORRELATED = ("age", "daar", "sex", "t", "status")


def value_counts(frame: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Rows per distinct value of each variable."""
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
            for v in variables
        ]
    )
    long = frame.select(*keys, F.inline(cells)).filter(F.col("value").isNotNull())
    return long.groupBy(*keys, "variable", "value").agg(F.count("*").alias("n"))


def _divergence(share: Column, mixture: Column) -> Column:
    log2 = F.ln(share / mixture) / F.ln(F.lit(2.0))
    return F.when(share > 0, share * log2).otherwise(0.0)


def jsd_univariate(
    real: DataFrame,
    synthetic: DataFrame,
    keys: Sequence[str] = RUN,
    plain: Sequence[str] = PLAIN,
    binned: Sequence[str] = BINNED,
    pieces: int = 19,
) -> DataFrame:
    """Jensen-Shannon distance per run and variable, base 2.

    Both sources are counted per distinct value before runs, bins and shares come
    into play, so the real table is read and shuffled once, not once per run.
    """
    keys = run_keys(synthetic.columns, keys)
    variables = [*plain, *binned]
    own = run_keys(real.columns, keys)
    real_counts = spread_over_runs(value_counts(real, own, variables), synthetic, keys)
    counts = real_counts.select(
        *keys, "variable", "value", F.col("n").alias("n_real"), F.lit(0).alias("n_synth")
    ).unionByName(
        value_counts(synthetic, keys, variables).select(
            *keys, "variable", "value", F.lit(0).alias("n_real"), F.col("n").alias("n_synth")
        )
    )
    groups = [*keys, "variable"]
    widths = counts.groupBy(*groups).agg(
        ((F.max("value") - F.min("value")) / F.lit(float(pieces))).alias("width"),
        F.sum("n_real").alias("size_real"),
        F.sum("n_synth").alias("size_synth"),
    )
    cell = F.when(F.col("variable").isin(list(binned)), bin_index("value", "width").cast("double"))
    cells = (
        counts.join(widths, groups)
        .groupBy(*groups, "size_real", "size_synth", cell.otherwise(F.col("value")).alias("cell"))
        .agg(F.sum("n_real").alias("n_real"), F.sum("n_synth").alias("n_synth"))
    )
    p, q = ratio("n_real", "size_real"), ratio("n_synth", "size_synth")
    mixture = (F.col("p") + F.col("q")) / F.lit(2.0)
    parts = F.lit(0.5) * _divergence(F.col("p"), mixture) + F.lit(0.5) * _divergence(
        F.col("q"), mixture
    )
    return (
        cells.withColumn("p", p)
        .withColumn("q", q)
        .groupBy(*groups)
        .agg(F.sqrt(F.greatest(F.sum(parts), F.lit(0.0))).alias("jsd"))
    )


def jsd_total(univariate: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return sum_by_run(univariate, run_keys(univariate.columns, keys), "jsd")


def pcd(
    real: DataFrame,
    synthetic: DataFrame,
    keys: Sequence[str] = RUN,
    settings: StudySettings = StudySettings(),
    variables: Sequence[str] = CORRELATED,
) -> DataFrame:
    """Frobenius norm of the difference of the two correlation matrices.

    Correlations among the stage dummies themselves are left out.
    """
    keys = run_keys(synthetic.columns, keys)
    dummies = [f"stage_{s}" for s in settings.stages]
    columns = [*dummies, *variables]

    pairs = [
        (a, b) for a, b in combinations(columns, 2) if not (a in dummies and b in dummies)
    ]

    def correlations(frame: DataFrame, own: Sequence[str], name: str) -> DataFrame:
        coded = one_hot(frame, "stage", settings.stages)
        return correlation_matrix(coded, own, columns, pairs).withColumnRenamed("r", name)

    own = run_keys(real.columns, keys)
    real_side = spread_over_runs(correlations(real, own, "r_real"), synthetic, keys)
    both = real_side.join(correlations(synthetic, keys, "r_synth"), [*keys, "a", "b"])
    gap = F.pow(F.col("r_real") - F.col("r_synth"), F.lit(2.0))
    return both.groupBy(*keys).agg(F.sqrt(F.lit(2.0) * F.sum(gap)).alias("pcd"))


def pmse(scores: DataFrame, keys: Sequence[str] = RUN, prob: str = "prob") -> DataFrame:
    """Mean squared distance of propensity scores from one half."""
    keys = run_keys(scores.columns, keys)
    return scores.groupBy(*keys).agg(
        F.avg(F.pow(F.col(prob) - F.lit(0.5), F.lit(2.0))).alias("pmse")
    )


def pmse_summary(metrics: DataFrame, keys: Sequence[str], value: str = "pmse") -> DataFrame:
    """Median and quartiles in scientific notation."""
    table = percentile_type2(metrics, keys, value, {"med": 50, "p25": 25, "p75": 75}, splits=None)
    return table.select(
        *keys,
        format_interval(*[format_scientific(c, 1) for c in ("med", "p25", "p75")]).alias("pmse"),
    )


def fixed_summary(metrics: DataFrame, keys: Sequence[str], value: str, digits: int = 3):
    table = summary_median_iqr(metrics, keys, value, digits)
    return table.select(*keys, F.col("text").alias(value))


def utility_table(
    jsd: DataFrame,
    correlation: DataFrame,
    propensity: DataFrame,
    survival: DataFrame,
    keys: Sequence[str] = ("site", "model"),
) -> DataFrame:
    """Median (p25, p75) of the four utility metrics side by side per model.

    Each input has one row per run; models missing from one input are kept.
    """
    keys = list(keys)
    table = fixed_summary(jsd, keys, "jsd")
    table = merge_results(table, fixed_summary(correlation, keys, "pcd"), keys)
    table = merge_results(table, pmse_summary(propensity, keys), keys)
    return merge_results(table, fixed_summary(survival, keys, "mean_diff"), keys)


def trade_off(
    utility: DataFrame,
    privacy: DataFrame,
    value: str,
    loss: str,
    keys: Sequence[str] = RUN,
) -> DataFrame:
    """Utility against privacy loss per run, with the model means on every row."""
    keys = run_keys(utility.columns, keys)
    both = merge_results(
        utility.select(*keys, value), privacy.select(*keys, loss), keys
    )
    groups = [k for k in keys if k != "sim"]
    return with_group_stats(
        both, groups, {f"mean_{value}": F.avg(value), f"mean_{loss}": F.avg(loss)}
    )
