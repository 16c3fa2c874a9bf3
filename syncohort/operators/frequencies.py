"""Saturated models: frequency tables, and draws of them.

Every table is as long as the covariate patterns allow, not as the data; the
data is read once per table, by an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncohort.functions.columns import as_column
from syncohort.functions.ordered import running_totals
from syncohort.operators.stats import with_group_stats

#: Interval starts in years; the last interval is open.
CUTS = (0.0, 0.5, 1.0, 2.0, 3.0)


def draw_numbers(draws: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(draws)))


def class_counts(
    cohort: DataFrame, keys: Sequence[str], variable: str, parents: Sequence[str] = ()
) -> DataFrame:
    """Count of every value for every observed parent pattern, zeros included."""
    seen = cohort.groupBy(*keys, *parents, variable).agg(F.count("*").alias("n"))
    values = seen.select(*keys, variable).distinct()
    patterns = seen.select(*keys, *parents).distinct()
    grid = patterns.join(values, list(keys)) if parents else values
    return grid.join(seen, [*keys, *parents, variable], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def class_probabilities(
    counts: DataFrame, keys: Sequence[str], variable: str, parents: Sequence[str] = (),
    weight: str | Column = "n",
) -> DataFrame:
    """Conditional shares of `weight` within each parent pattern."""
    weighted = counts.withColumn("_w", as_column(weight).cast("double"))
    total = with_group_stats(weighted, [*keys, *parents], {"_total": F.sum("_w")})
    return total.withColumn("p", F.col("_w") / F.col("_total")).drop("_w", "_total", "n")


def perturbed_draws(
    counts: DataFrame,
    keys: Sequence[str],
    variable: str,
    parents: Sequence[str],
    draws: int,
    weight: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """`draws` versions of a table from a weight that is a function of (n, value, h)."""
    numbered = counts.withColumn("h", draw_numbers(draws))
    weights = weight(F.col("n"), F.col(variable), F.col("h"))
    return class_probabilities(numbered, [*keys, "h"], variable, parents, weights)


def _seeded_gamma(shape: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(
        [np.random.default_rng(abs(int(s))).gamma(float(a)) for a, s in zip(shape, seed)],
        dtype=float,
    )


gamma_draw = F.pandas_udf(_seeded_gamma, T.DoubleType())


def dirichlet_draws(
    counts: DataFrame,
    keys: Sequence[str],
    variable: str,
    parents: Sequence[str],
    draws: int,
    seed: int = 0,
) -> DataFrame:
    """Draws from the posterior of a frequency table under a flat prior."""
    numbered = counts.withColumn("h", draw_numbers(draws))
    own_seed = F.xxhash64(F.lit(variable), F.lit(seed), "h", *keys, *parents, variable)
    return class_probabilities(
        numbered.withColumn("_g", gamma_draw(F.col("n") + 1, own_seed)),
        [*keys, "h"], variable, parents, "_g",
    ).drop("_g")


def interval_index(t: str | Column, cuts: Sequence[float] = CUTS) -> Column:
    """Index of the interval (start, end] that holds `t`."""
    t = as_column(t)
    out = F.lit(0)
    for index, cut in enumerate(cuts[1:], start=1):
        out = F.when(t > F.lit(float(cut)), F.lit(index)).otherwise(out)
    return out


def interval_exposure(t: str | Column, cuts: Sequence[float] = CUTS) -> Column:
    """Years spent in each interval up to `t`, as an array."""
    t = as_column(t)
    ends = [*cuts[1:], None]
    return F.array(
        *[
            F.greatest(
                (t if end is None else F.least(t, F.lit(float(end)))) - F.lit(float(start)),
                F.lit(0.0),
            )
            for start, end in zip(cuts, ends)
        ]
    )


def event_exposure(
    cohort: DataFrame, by: Sequence[str], cuts: Sequence[float] = CUTS
) -> DataFrame:
    """Events and person-years per pattern and interval."""
    spent = interval_exposure("t", cuts)
    own = interval_index("t", cuts)
    wide = cohort.groupBy(*by).agg(
        *[F.sum(spent[j]).alias(f"_e{j}") for j in range(len(cuts))],
        *[
            F.sum(F.when(own == j, F.col("status")).otherwise(0)).alias(f"_d{j}")
            for j in range(len(cuts))
        ],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(j).alias("interval"),
                F.col(f"_d{j}").alias("d"),
                F.col(f"_e{j}").alias("exposure"),
            )
            for j in range(len(cuts))
        ]
    )
    return wide.select(*by, F.inline(cells))


def perturbed_rates(
    table: DataFrame, draws: int, rate: Callable[[Column, Column, Column, Column], Column]
) -> DataFrame:
    """`draws` hazards per cell from a function of (events, exposure, interval, h)."""
    numbered = table.withColumn("h", draw_numbers(draws))
    value = rate(F.col("d"), F.col("exposure"), F.col("interval"), F.col("h"))
    return numbered.withColumn("rate", value).drop("d", "exposure")


def gamma_rates(
    table: DataFrame, by: Sequence[str], draws: int, seed: int = 0
) -> DataFrame:
    """Hazard draws from the gamma posterior with a half event in one year as prior."""
    numbered = table.withColumn("h", draw_numbers(draws))
    own_seed = F.xxhash64(F.lit("rate"), F.lit(seed), "h", *by, "interval")
    value = gamma_draw(F.col("d") + 0.5, own_seed) / (F.col("exposure") + F.lit(1.0))
    return numbered.withColumn("rate", value).drop("d", "exposure")


def cumulative_classes(
    probabilities: DataFrame, keys: Sequence[str], variable: str, parents: Sequence[str] = ()
) -> DataFrame:
    """Probabilities packed per parent pattern: `<variable>_cdf`, an array of (upper, value).

    A pattern has as many entries as there are classes.
    """
    running = running_totals(
        probabilities, [*keys, *parents], [variable], {"upper": "p"}, splits=None
    )
    return running.groupBy(*keys, *parents).agg(
        F.sort_array(F.collect_list(F.struct("upper", F.col(variable).alias("value")))).alias(
            f"{variable}_cdf"
        )
    )


def packed_rates(rates: DataFrame, by: Sequence[str], name: str = "rates") -> DataFrame:
    """Hazards of one pattern as an array along the intervals."""
    return rates.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("interval", "rate"))), lambda c: c["rate"]
        ).alias(name)
    )
