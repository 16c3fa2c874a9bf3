"""Survival curves and their comparison.

Rows are counted per stratum and follow-up day first. Afterwards a stratum has at
most one row per day of the study's follow-up, so ordinary windows are bounded
however many persons there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncohort.functions.columns import ratio, run_keys
from syncohort.functions.special import chi2_upper_tail_1df
from syncohort.lineage import cut
from syncohort.operators.cohort import spread_over_runs, with_age_group
from syncohort.operators.stats import percentile_type2
from syncohort.settings import RUN

STRATA = ("age_grp", "sex", "stage")

#: 95% point of chi-square with one degree of freedom, a fixed value.
CHI2_95_1DF = 3.841458820694124


def exits_by_day(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """Persons leaving and events per stratum and follow-up time."""
    return frame.groupBy(*by, "t").agg(
        F.count("*").alias("leaving"), F.sum("status").alias("events")
    )


def risk_set(exits: DataFrame, by: Sequence[str], count: str = "leaving", name: str = "at_risk"):
    """Persons still under observation just before each time."""
    order = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(count).over(Window.partitionBy(*by))
    return exits.withColumn(name, total - F.coalesce(F.sum(count).over(order), F.lit(0)))


def _product_limit(exits: DataFrame, by: Sequence[str]) -> DataFrame:
    table = risk_set(exits, by)
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    logs = F.sum(
        F.when(
            F.col("events") < F.col("at_risk"),
            F.ln(F.lit(1.0) - ratio("events", "at_risk")),
        )
    ).over(upto)
    extinct = F.max(F.col("events") >= F.col("at_risk")).over(upto)
    return table.withColumn(
        "survivor", F.when(extinct, F.lit(0.0)).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))
    )


def kaplan_meier(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """Product-limit survivor function: (by, t, leaving, events, at_risk, survivor)."""
    return _product_limit(exits_by_day(frame, by), by)


def survival_at_horizon(
    real: DataFrame,
    synthetic: DataFrame,
    horizon: float = 5.0,
    keys: Sequence[str] = RUN,
    strata: Sequence[str] = STRATA,
) -> DataFrame:
    """Survivor share at `horizon` per stratum for both sources and their distance.

    A group not followed up to the horizon has no estimate, which counts as 0.
    """
    exits, groups = _both_sources(real, synthetic, keys, strata)
    curve = _product_limit(exits, [*groups, "synth"])
    point = curve.groupBy(*groups, "synth").agg(
        F.when(F.max("t") < horizon, F.lit(0.0))
        .otherwise(
            F.coalesce(F.min(F.when(F.col("t") <= horizon, F.col("survivor"))), F.lit(1.0))
        )
        .alias("survivor")
    )
    return (
        point.groupBy(*groups)
        .agg(
            F.max(F.when(F.col("synth") == 0, F.col("survivor"))).alias("s_real"),
            F.max(F.when(F.col("synth") == 1, F.col("survivor"))).alias("s_synth"),
        )
        .withColumn("abs_diff", F.abs(F.col("s_real") - F.col("s_synth")))
    )


def _both_sources(real, synthetic, keys, strata):
    """Exits per day of both sources, real counts spread over the runs."""
    keys = run_keys(synthetic.columns, keys)
    real, synthetic = with_age_group(real), with_age_group(synthetic)
    own = run_keys(real.columns, keys)
    real_exits = spread_over_runs(exits_by_day(real, [*own, *strata]), synthetic, keys)
    exits = real_exits.withColumn("synth", F.lit(0)).unionByName(
        exits_by_day(synthetic, [*keys, *strata]).withColumn("synth", F.lit(1))
    )
    return exits, [*keys, *strata]


def survival_difference(
    real: DataFrame,
    synthetic: DataFrame,
    horizon: float = 5.0,
    keys: Sequence[str] = RUN,
    strata: Sequence[str] = STRATA,
) -> DataFrame:
    """Mean and median absolute difference over strata present in both sources."""
    keys = run_keys(synthetic.columns, keys)
    # One row per stratum of a run, read twice below.
    points = cut(
        survival_at_horizon(real, synthetic, horizon, keys, strata).filter(
            F.col("abs_diff").isNotNull()
        ),
        "strata",
    )
    means = points.groupBy(*keys).agg(
        F.avg("abs_diff").alias("mean_diff"), F.count("*").alias("strata")
    )
    medians = percentile_type2(points, keys, "abs_diff", {"med_diff": 50}, splits=None)
    return means.join(medians, keys)


def logrank(
    real: DataFrame,
    synthetic: DataFrame,
    keys: Sequence[str] = RUN,
    strata: Sequence[str] = STRATA,
    with_p: bool = True,
) -> DataFrame:
    """Two-sample log-rank statistic of real against synthetic per stratum."""
    exits, groups = _both_sources(real, synthetic, keys, strata)
    synth = F.col("synth") == 1
    days = exits.groupBy(*groups, "t").agg(
        F.sum("leaving").alias("leaving"),
        F.sum("events").alias("d"),
        F.sum(F.when(synth, F.col("leaving")).otherwise(0)).alias("leaving_1"),
        F.sum(F.when(synth, F.col("events")).otherwise(0)).alias("d_1"),
    )
    days = risk_set(days, groups, "leaving", "n")
    days = risk_set(days, groups, "leaving_1", "n_1")
    n, n1, d = (F.col(c).cast("double") for c in ("n", "n_1", "d"))
    excess = F.when(F.col("d") > 0, F.col("d_1") - d * n1 / n).otherwise(0.0)
    spread = F.when(
        (F.col("d") > 0) & (F.col("n") > 1),
        d * n1 * (n - n1) * (n - d) / F.nullif(n * n * (n - F.lit(1.0)), F.lit(0.0)),
    ).otherwise(0.0)
    out = days.groupBy(*groups).agg(F.sum(excess).alias("o_minus_e"), F.sum(spread).alias("v"))
    out = out.withColumn(
        "chi2", F.pow("o_minus_e", F.lit(2.0)) / F.when(F.col("v") > 1e-12, F.col("v"))
    )
    return out.withColumn("p", chi2_upper_tail_1df("chi2")) if with_p else out


def logrank_share(
    real: DataFrame,
    synthetic: DataFrame,
    keys: Sequence[str] = RUN,
    strata: Sequence[str] = STRATA,
) -> DataFrame:
    """Share of strata with p < 0.05; a stratum without a test counts as not below."""
    keys = run_keys(synthetic.columns, keys)
    tests = logrank(real, synthetic, keys, strata, with_p=False)
    below = F.coalesce(F.col("chi2") > CHI2_95_1DF, F.lit(False))
    return tests.groupBy(*keys).agg(
        F.avg(below.cast("double")).alias("p05"), F.count("*").alias("strata")
    )
