"""Drawing synthetic cohorts.

Every draw is a function of the row's number and its run, so runs are columns of
one job and a lost partition is redrawn identically.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.functions.columns import DAYS_PER_YEAR, as_column, run_keys, year_group
from syncohort.functions.draws import hash_uniform
from syncohort.functions.ordered import row_numbers
from syncohort.lineage import cut
from syncohort.operators.cohort import lookup_join, survival_set
from syncohort.operators.frequencies import (
    CUTS,
    class_counts,
    class_probabilities,
    cumulative_classes,
    event_exposure,
    packed_rates,
)
from syncohort.settings import RUN, StudySettings

#: Purpose -> uniform column for a row. The default hashes run, row and purpose.
Uniform = Callable[[int], Column]


def default_uniform(keys: Sequence[str], row: str) -> Uniform:
    return lambda purpose: hash_uniform(*keys, row, purpose)


def with_runs(frame: DataFrame, models: Sequence[int], sims: int) -> DataFrame:
    """Repeat a frame for every model and run."""
    return frame.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn(
        "sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))
    )


def spread(slots: DataFrame) -> DataFrame:
    """`slots` dealt evenly over all cores by their `id`.

    A slot has few bytes but long draws in many runs, and Spark sizes tasks by bytes.
    """
    return slots.repartition(4 * slots.sparkSession.sparkContext.defaultParallelism, "id")


def bootstrap(
    cohort: DataFrame,
    models: Sequence[int] = (6,),
    sims: int = 1,
    site: str = "site",
    members: Column | None = None,
    uniform: Callable[[Column, Column, Column], Column] | None = None,
    order: Sequence[str] = ("id",),
) -> DataFrame:
    """As many draws with replacement as the cohort has rows, for every run.

    Slots and rows are numbered without a one-task sort; a slot's pick is a
    uniform row number, so the join is free of hot keys. With `members` only
    those rows can be picked while the number of slots stays the same.
    """
    slots = row_numbers(cohort.select(site, *order), [site], order, "slot")
    pool = cohort if members is None else cohort.filter(members)
    rows = row_numbers(pool, [site], order, "_pick")
    sizes = pool.groupBy(site).agg(F.count("*").alias("_size"))
    slots = with_runs(slots.select(site, "slot"), models, sims).join(sizes, site)
    if uniform is None:
        u = hash_uniform(site, "model", "sim", "slot", 11)
    else:
        u = uniform(F.col("model"), F.col("sim"), F.col("slot"))
    pick = (F.floor(u * F.col("_size")) + 1).cast("bigint")
    drawn = slots.select(site, "model", "sim", "slot", pick.alias("_pick")).join(
        rows, [site, "_pick"]
    )
    return drawn.drop("_pick")


def holdout_split(
    cohort: DataFrame, share: float = 0.2, uniform: Column | None = None,
    keys: Sequence[str] = ("site", "sim"),
) -> DataFrame:
    """Flag a share of the rows as held out, anew for each run."""
    keys = run_keys(cohort.columns, keys)
    u = hash_uniform(*keys, "id", 13) if uniform is None else uniform
    return cohort.withColumn("holdout", (u < F.lit(share)).cast("int"))


def draw_class(cdf: str | Column, u: Column) -> Column:
    """First class whose cumulative probability exceeds `u`; the last one at the end."""
    cdf = as_column(cdf)
    hit = F.get(F.filter(cdf, lambda c: c["upper"] > u), F.lit(0))["value"]
    return F.coalesce(hit, F.element_at(cdf, -1)["value"])


def draw_categorical(
    rows: DataFrame, variable: str, parents: Sequence[str], cdfs: DataFrame, u: Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add `variable` drawn from the packed probabilities of the row's pattern.

    A pattern without probabilities stops the job.
    """
    return (
        lookup_join(rows, cdfs, [*keys, *parents])
        .withColumn(variable, draw_class(f"{variable}_cdf", u))
        .drop(f"{variable}_cdf")
    )


def draw_survival_time(
    rates: str | Column, u: Column, cuts: Sequence[float] = CUTS, limit: float = 21.0
) -> Column:
    """Time at which the piecewise linear cumulative hazard reaches -ln(u), in whole days.

    Never reached before `limit` means `limit`.
    """
    rates = as_column(rates)
    target = -F.ln(F.greatest(u, F.lit(1e-300)))
    time = F.lit(None).cast("double")
    reached = F.lit(0.0)
    steps = []
    for j, start in enumerate(cuts):
        rate = F.get(rates, F.lit(j))
        end = cuts[j + 1] if j + 1 < len(cuts) else limit
        gain = rate * F.lit(float(end - start))
        steps.append((float(start), rate, reached, gain))
        reached = reached + gain
    for start, rate, before, gain in reversed(steps):
        inside = F.lit(start) + (target - before) / F.nullif(rate, F.lit(0.0))
        time = F.when((target >= before) & (target < before + gain), inside).otherwise(time)
    years = F.least(F.coalesce(time, F.lit(float(limit))), F.lit(float(limit)))
    return F.greatest(F.ceil(years * F.lit(DAYS_PER_YEAR)), F.lit(1)).cast("int")


def survival_days(
    rates: np.ndarray, cell: np.ndarray, u: np.ndarray, cuts: Sequence[float], limit: float
) -> np.ndarray:
    """`draw_survival_time` in numpy; `rates` has a row of hazards for every `cell`."""
    ends = [*cuts[1:], limit]
    target = -np.log(np.maximum(u, 1e-300))
    total = [np.zeros(len(rates))]
    for rate, start, end in zip(rates.T, cuts, ends):
        total.append(total[-1] + rate * float(end - start))
    if all((late >= early).all() and np.isfinite(late).all() for early, late in zip(total, total[1:])):
        # The hazard never falls: the interval is the number of those that were passed.
        at = np.zeros(len(u), np.int64)
        for upto in total[1:]:
            at += target >= upto[cell]
        known = np.append(np.array(total[:-1]).T, np.zeros((len(rates), 1)), axis=1)
        slope = np.append(rates, np.ones((len(rates), 1)), axis=1)
        place = cell * slope.shape[1] + at
        time = np.append(cuts, limit)[at] + np.where(
            at < len(cuts), (target - known.ravel()[place]) / slope.ravel()[place], 0.0
        )
        return whole_days(time, limit)
    reached = np.zeros(len(rates))
    time = np.full(len(u), float(limit))
    left = np.arange(len(u))
    for rate, start, end in zip(rates.T, cuts, ends):
        before, reached = reached, reached + rate * float(end - start)
        at, wanted = cell[left], target[left]
        inside = (wanted >= before[at]) & (wanted < reached[at])
        own = at[inside]
        with np.errstate(invalid="ignore"):
            time[left[inside]] = start + (wanted[inside] - before[own]) / rate[own]
        left = left[~inside]
    return whole_days(time, limit)


def whole_days(years: np.ndarray, limit: float) -> np.ndarray:
    return np.maximum(np.ceil(np.minimum(years, limit) * DAYS_PER_YEAR), 1).astype(np.int32)


def diagnosis_dates(groups: Sequence[int], settings: StudySettings) -> list[np.ndarray]:
    """Per year group the days, counted from 1970, that `draw_diagnosis_date` draws from."""
    cutoff = date.fromisoformat(settings.cutoff)
    leap_day = (cutoff.month, cutoff.day) == (2, 29)
    cutoff_day = (cutoff.replace(year=2001, day=28 if leap_day else cutoff.day) - date(2001, 1, 1)).days
    out = []
    for group in groups:
        full = min(settings.year_group, max(cutoff.year - group, 0))
        count = full * 365 + (cutoff_day if full < settings.year_group else 0)
        days = [date(2001, 1, 1) + timedelta(i % 365) for i in range(max(count, 1))]
        out.append(
            np.array(
                [
                    d.replace(year=group + i // 365).toordinal() - date(1970, 1, 1).toordinal()
                    for i, d in enumerate(days)
                ],
                np.int32,
            )
        )
    return out


def draw_diagnosis_date(
    group: str | Column, u: Column, settings: StudySettings
) -> Column:
    """A day of the year group, uniform over the days of 365-day years before the cutoff."""
    group = as_column(group)
    cutoff = date.fromisoformat(settings.cutoff)
    # Position of the cutoff in a year without 29 February.
    leap_day = (cutoff.month, cutoff.day) == (2, 29)
    cutoff_day = (cutoff.replace(year=2001, day=28 if leap_day else cutoff.day) - date(2001, 1, 1)).days
    full = F.least(F.lit(settings.year_group), F.greatest(F.lit(cutoff.year) - group, F.lit(0)))
    partial = F.when(full < settings.year_group, F.lit(cutoff_day)).otherwise(F.lit(0))
    index = F.floor(u * (full * F.lit(365) + partial)).cast("int")
    template = F.date_add(F.lit("2001-01-01").cast("date"), F.pmod(index, F.lit(365)))
    year = (group + F.floor(index / F.lit(365))).cast("int")
    return F.make_date(year, F.month(template), F.dayofmonth(template))


def saturated_model(
    cohort: DataFrame,
    submodels: Sequence[tuple[str, Sequence[str]]],
    rate_by: Sequence[str],
    keys: Sequence[str] = ("site",),
    cuts: Sequence[float] = CUTS,
) -> tuple[dict[str, tuple[Sequence[str], DataFrame]], DataFrame]:
    """Conditional frequencies of each variable and hazards per interval.

    A cell without exposure has hazard 0. All tables are written, so that Spark knows how
    small they are and sends them to the rows that look them up.
    """
    tables = {}
    for variable, parents in submodels:
        shares = class_probabilities(
            class_counts(cohort, keys, variable, parents), keys, variable, parents
        )
        cdfs = cumulative_classes(shares.filter("p > 0"), keys, variable, parents)
        tables[variable] = (list(parents), cut(cdfs, "cdfs"))
    spent = event_exposure(cohort, [*keys, *rate_by], cuts)
    rate = F.coalesce(F.col("d") / F.nullif(F.col("exposure"), F.lit(0.0)), F.lit(0.0))
    rates = packed_rates(spent.withColumn("rate", rate), [*keys, *rate_by])
    return tables, cut(rates, "rates")


def synthesize(
    rows: DataFrame,
    tables: Mapping[str, tuple[Sequence[str], DataFrame]],
    rates: DataFrame,
    rate_by: Sequence[str],
    settings: StudySettings,
    uniform: Uniform | None = None,
    keys: Sequence[str] = ("site",),
    cuts: Sequence[float] = CUTS,
) -> DataFrame:
    """Complete synthetic cohort: covariates in sequence, survival time, diagnosis date,
    censoring at the cutoff.

    `rows` holds one row per person to draw, with its run keys and `id`.
    """
    if uniform is None:
        uniform = default_uniform(run_keys(rows.columns, RUN), "id")
    out = rows
    purpose = 0
    for variable, (parents, cdfs) in tables.items():
        purpose += 1
        out = draw_categorical(out, variable, parents, cdfs, uniform(purpose), keys)
    out = lookup_join(out, rates, [*keys, *rate_by])
    days = draw_survival_time("rates", uniform(purpose + 1), cuts, settings.max_follow_up)
    out = out.withColumn("_days", days).drop("rates")
    out = out.withColumn(
        "diag_date", draw_diagnosis_date("daar_grp", uniform(purpose + 2), settings)
    )
    # Written out: no later filter can then be moved below the chain of draws.
    return finish_draws(cut(out, "drawn"), settings)


def finish_draws(drawn: DataFrame, settings: StudySettings) -> DataFrame:
    """Exit date, censoring at the cutoff and analysis time for rows with `_days`."""
    dated = drawn.withColumn("exit", F.date_add("diag_date", F.col("_days"))).drop("_days")
    out = survival_set(dated.withColumn("status", F.lit(1)), settings)
    return out.withColumns(
        {
            "daar": F.year("diag_date"),
            "daar_grp": year_group(F.year("diag_date"), settings.year_group),
        }
    )
