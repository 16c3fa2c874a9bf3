"""From a registry extract to a survival cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.functions.columns import (
    age_group,
    bin_index,
    clip,
    decode,
    recode_missing,
    run_keys,
    year_group,
    years_between,
)
from syncohort.functions.ordered import row_numbers, running_totals
from syncohort.lineage import join_constants
from syncohort.operators.stats import percentile_type2
from syncohort.settings import RUN, StudySettings


def harmonise(extract: DataFrame, names: Mapping[str, str], male: str | None = None) -> DataFrame:
    """Rename source fields; `male` names the letter that means sex = 1."""
    out = extract.withColumnsRenamed(dict(names))
    if male is not None:
        out = out.withColumn("sex", (F.col("sex") == F.lit(male)).cast("int"))
    return out


def cutoff_date(settings: StudySettings) -> Column:
    return F.lit(settings.cutoff).cast("date")


def filter_registry(extract: DataFrame, settings: StudySettings) -> DataFrame:
    """Drop the emigrated and keep diagnoses inside the study window."""
    year = F.year("diag_date")
    kept = extract.filter(
        (F.col("vital").isNull() | (F.col("vital") != "E"))
        & year.between(settings.start_year, settings.end_year)
        & (F.col("diag_date") < cutoff_date(settings))
    )
    if settings.max_age is not None:
        kept = kept.filter(F.col("age") <= settings.max_age)
    return kept


def administrative_censoring(cohort: DataFrame, settings: StudySettings) -> DataFrame:
    """Letter and date of the vital status capped at the cutoff.

    A missing status date counts as later than any date.
    """
    late = F.col("vital_date").isNull() | (F.col("vital_date") > cutoff_date(settings))
    return cohort.withColumns(
        {
            "vital": F.when(late, F.lit("B")).otherwise(F.col("vital")),
            "vital_date": F.when(late, cutoff_date(settings)).otherwise(F.col("vital_date")),
        }
    )


def event_flag(cohort: DataFrame) -> DataFrame:
    return cohort.withColumn("status", F.coalesce(F.col("vital") == "D", F.lit(False)).cast("int"))


def status_letter(status: str | Column = "status") -> Column:
    """1 -> D, 0 -> B; anything else stops the job."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == 1, F.lit("D")).when(status == 0, F.lit("B")).otherwise(
        F.raise_error(F.lit("status must be 0 or 1")).cast("string")
    )


def drop_lost_to_follow_up(cohort: DataFrame, settings: StudySettings) -> DataFrame:
    return cohort.filter(~((F.col("exit") < cutoff_date(settings)) & (F.col("status") == 0)))


def survival_set(cohort: DataFrame, settings: StudySettings) -> DataFrame:
    """Analysis time in years, failure capped at the cutoff, valid follow-up only."""
    cutoff = cutoff_date(settings)
    return (
        cohort.withColumn(
            "status",
            F.when(F.col("exit") > cutoff, F.lit(0)).otherwise(F.col("status")),
        )
        .withColumn("exit", F.least(F.col("exit"), cutoff))
        .filter(F.col("exit") > F.col("diag_date"))
        .withColumn("t", years_between("diag_date", "exit"))
    )


def prepare_cohort(extract: DataFrame, settings: StudySettings) -> DataFrame:
    """The whole preparation: filters, recodes, year groups, censoring, analysis time."""
    kept = administrative_censoring(filter_registry(extract, settings), settings)
    flagged = event_flag(kept).withColumn("exit", F.col("vital_date"))
    shaped = drop_lost_to_follow_up(flagged, settings).withColumns(
        {
            "stage": recode_missing("stage"),
            "daar": F.year("diag_date"),
            "daar_grp": year_group(F.year("diag_date"), settings.year_group),
        }
    )
    return survival_set(shaped, settings).drop("vital", "vital_date")


def with_surrogate_id(
    cohort: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "id"
) -> DataFrame:
    """Consecutive ids along a stated unique order, without a one-task sort."""
    return row_numbers(cohort, keys, order, name)


def with_group_id(frame: DataFrame, columns: Sequence[str], name: str = "grp") -> DataFrame:
    """Dense id 1..k over the distinct tuples of `columns`, in sorted order."""
    ids = row_numbers(frame.select(*columns).distinct(), [], list(columns), name)
    return join_constants(frame, ids, columns)


def spread_over_runs(
    real: DataFrame, synthetic: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """Give rows with fewer run keys the keys of every run they belong to.

    Meant for aggregated real tables: the copies are of counts, not of persons.
    """
    present = run_keys(synthetic.columns, keys)
    missing = [k for k in present if k not in real.columns]
    if not missing:
        return real
    shared = run_keys(real.columns, present)
    return join_constants(real, synthetic.select(*present).distinct(), shared)



def union_with_source(
    real: DataFrame, synthetic: DataFrame, flag: str = "synth", keys: Sequence[str] = RUN
) -> DataFrame:
    """Stack real (0) and synthetic (1) rows, aligning columns.

    Operators that only need counts combine them after aggregation instead.
    """
    spread = spread_over_runs(real, synthetic, keys)
    return spread.withColumn(flag, F.lit(0)).unionByName(
        synthetic.withColumn(flag, F.lit(1)), allowMissingColumns=True
    )


def with_run_minimum_delta(
    frame: DataFrame, columns: Sequence[str] = ("diag_date", "exit"), keys: Sequence[str] = RUN
) -> DataFrame:
    """Days since the earliest date of the run, as `<column>_delta`.

    The minimum is aggregated and joined back: a window over the run would
    gather the run in one task.
    """
    keys = run_keys(frame.columns, keys)
    starts = frame.groupBy(*keys).agg(*[F.min(c).alias(f"_start_{c}") for c in columns])
    return join_constants(frame, starts, keys).select(
        *[c for c in frame.columns if c not in columns],
        *[F.datediff(c, f"_start_{c}").alias(f"{c}_delta") for c in columns],
    )


def with_equal_width_bins(
    frame: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = RUN,
    pieces: int = 19,
    suffix: str = "_grp",
) -> DataFrame:
    """`floor(value / width)`, the width from the range over both sources of a run."""
    keys = run_keys(frame.columns, keys)
    widths = frame.groupBy(*keys).agg(
        *[
            ((F.max(c) - F.min(c)).cast("double") / F.lit(float(pieces))).alias(f"_width_{c}")
            for c in columns
        ]
    )
    return (
        join_constants(frame, widths, keys)
        .withColumns({f"{c}{suffix}": bin_index(c, f"_width_{c}") for c in columns})
        .drop(*[f"_width_{c}" for c in columns])
    )


def with_age_group(frame: DataFrame, name: str = "age_grp") -> DataFrame:
    return frame.withColumn(name, age_group("age"))


def decode_labels(frame: DataFrame, code: str, labels: Mapping[int, str], name: str) -> DataFrame:
    return frame.withColumn(name, decode(code, labels))


def winsorize(
    frame: DataFrame, columns: Sequence[str], percent: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Clip to the `percent` and `100 - percent` percentiles, or to min and max for 0."""
    keys = list(keys)
    cells = F.array(
        *[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    )
    # One pass over all columns: the column is a further key.
    long = frame.select(*keys, F.inline(cells))
    groups = [*keys, "_column"]
    if percent > 0:
        limits = percentile_type2(long, groups, "_value", {"_low": percent, "_high": 100 - percent})
    else:
        limits = long.groupBy(*groups).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    wide = limits.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("_column", F.struct("_low", "_high")))
        ).alias("_limits")
    )  # an entry per column

    def adjusted(column: str) -> Column:
        limit = F.try_element_at(F.col("_limits"), F.lit(column))
        return clip(F.col(column).cast("double"), limit["_low"], limit["_high"])

    return (
        join_constants(frame, wide, keys)
        .withColumns({f"{c}_adj": adjusted(c) for c in columns})
        .drop("_limits")
    )


def one_hot(frame: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    return frame.withColumns(
        {
            f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int")
            for v in values
        }
    )


def ordinal_encode(
    frame: DataFrame,
    column: str,
    fitted_on: DataFrame,
    name: str,
    keys: Sequence[str] = (),
    unknown: int = 9,
    splits: int | None = None,
) -> DataFrame:
    """Category -> position among the sorted categories of `fitted_on`.

    Give `splits` for a column with very many categories.
    """
    keys = list(keys)
    categories = fitted_on.select(*keys, column).filter(F.col(column).isNotNull()).distinct()
    codes = running_totals(
        categories, keys, [column], {"_code": F.lit(1).cast("bigint")}, splits=splits
    )
    return (
        join_constants(frame, codes, [*keys, column], "left")
        .withColumn(name, F.coalesce(F.col("_code") - 1, F.lit(unknown)))
        .drop("_code")
    )


def standard_scale(
    frame: DataFrame, columns: Sequence[str], fitted_on: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """z-scores with mean and population sd of `fitted_on`; a zero sd counts as 1."""
    keys = run_keys(fitted_on.columns, keys)
    measures = fitted_on.groupBy(*keys).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_sd_{c}") for c in columns],
    )

    def scaled(c: str) -> Column:
        sd = F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1.0))
        return (F.col(c).cast("double") - F.col(f"_mean_{c}")) / sd

    return (
        join_constants(frame, measures, keys)
        .withColumns({f"{c}_z": scaled(c) for c in columns})
        .drop(*[f"_{m}_{c}" for m in ("mean", "sd") for c in columns])
    )


def column_ranges(
    frames: Sequence[DataFrame], columns: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Minimum and span of each column over several frames, one row per run."""
    partial = None
    for frame in frames:
        part = frame.groupBy(*keys).agg(
            *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in columns],
            *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in columns],
        )
        partial = part if partial is None else partial.unionByName(part)
    merged = partial.groupBy(*keys).agg(
        *[F.min(f"_lo_{c}").alias(f"_lo_{c}") for c in columns],
        *[F.max(f"_hi_{c}").alias(f"_hi_{c}") for c in columns],
    )
    return merged.select(
        *keys,
        *[F.col(f"_lo_{c}").alias(f"_min_{c}") for c in columns],
        *[(F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).alias(f"_span_{c}") for c in columns],
    )


def range_scale(
    frame: DataFrame,
    columns: Sequence[str],
    fitted_on: Sequence[DataFrame],
    keys: Sequence[str] = RUN,
    suffix: str = "_scaled",
) -> DataFrame:
    """Divide by the range over all of `fitted_on`; a range of 0 gives 0."""
    keys = run_keys(frame.columns, keys)
    ranges = column_ranges(fitted_on, columns, keys)

    def scaled(c: str) -> Column:
        span = F.col(f"_span_{c}")
        value = (F.col(c).cast("double") - F.col(f"_min_{c}")) / F.nullif(span, F.lit(0.0))
        return F.when(span > 0, value).when(F.col(c).isNotNull(), F.lit(0.0))

    return (
        join_constants(frame, ranges, keys)
        .withColumns({f"{c}{suffix}": scaled(c) for c in columns})
        .drop(*[f"_{m}_{c}" for m in ("min", "span") for c in columns])
    )


def data_contract(
    cohort: DataFrame, settings: StudySettings, keys: Sequence[str] = RUN
) -> DataFrame:
    """Number of rows that break each rule, one row per run and rule."""
    keys = run_keys(cohort.columns, keys)
    rules = {
        "sequence_missing": F.greatest(*[F.col(v).isNull().cast("int") for v in settings.sequence]),
        "stage_out_of_range": (~F.col("stage").isin(list(settings.stages))).cast("int"),
        "diagnosis_not_before_cutoff": (F.col("diag_date") >= cutoff_date(settings)).cast("int"),
        "status_not_binary": (~F.col("status").isin(0, 1)).cast("int"),
        "no_follow_up": (F.col("t") <= 0).cast("int"),
    }
    counts = cohort.groupBy(*keys).agg(
        *[F.sum(F.coalesce(c, F.lit(1))).alias(n) for n, c in rules.items()]
    )
    return counts.unpivot([F.col(k) for k in keys], list(rules), "rule", "violations")


def unmatched_rows(data: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Contract of a lookup join: rows of `data` without a partner."""
    return data.join(lookup.select(*on).distinct(), list(on), "left_anti")


def lookup_join(data: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every data row gets its lookup row; unused lookup rows are dropped.

    A data row without a partner stops the job.
    """
    marked = lookup.withColumn("_found", F.lit(True))
    return (
        data.join(marked, list(on), "left")
        .withColumn(
            "_found",
            F.when(F.col("_found"), F.lit(True)).otherwise(
                F.raise_error(F.lit("row without lookup partner")).cast("boolean")
            ),
        )
        .filter("_found")
        .drop("_found")
    )


def cross_grid(frame: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """Every row with every combination of the given array columns."""
    for name, values in axes.items():
        frame = frame.withColumn(name, F.explode(values))
    return frame


def expand_rows(frame: DataFrame, copies: int | str | Column, name: str = "copy") -> DataFrame:
    """Each row `copies` times, numbered from 1; rows with no copies disappear."""
    if isinstance(copies, int):
        copies = F.lit(copies)
    elif isinstance(copies, str):
        copies = F.col(copies)
    return frame.filter(copies >= 1).withColumn(name, F.explode(F.sequence(F.lit(1), copies)))


def split_holdout(cohort: DataFrame, flag: str = "holdout") -> tuple[DataFrame, DataFrame]:
    """(members, held out)."""
    return cohort.filter(F.col(flag) == 0), cohort.filter(F.col(flag) == 1)
