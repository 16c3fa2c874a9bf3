"""Cohorts, run matrices and report rows on disk.

Many runs live in one table partitioned by site, model and sim, so a filter on
a run prunes files; the run matrix and the report text are exchange formats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncohort.functions.columns import format_day, parse_day, recode_missing, year_group
from syncohort.settings import RUN
from syncohort.sources.schemas import COHORT_CSV, RUN_FIELDS


def read_cohort(
    spark: SparkSession,
    path: str,
    schema: T.StructType = COHORT_CSV,
    run_partitions: bool = False,
    missing_stage: int = 999,
) -> DataFrame:
    """Headered comma CSV of a real, synthetic or holdout cohort, dates parsed.

    With `run_partitions` the folder is laid out by site/model/sim and those
    keys come back as columns.
    """
    if run_partitions:
        schema = T.StructType([*schema.fields, *RUN_FIELDS])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return raw.withColumns(
        {
            "stage": recode_missing("stage", missing_stage),
            "diag_date": parse_day("diag_date"),
            "exit": parse_day("exit"),
        }
    ).withColumn("daar", F.year("diag_date"))


def write_cohort_csv(cohort: DataFrame, path: str, missing_stage: int = 999) -> None:
    """Comma CSV with header, missing stage as an empty field, one folder per run."""
    names = [f.name for f in COHORT_CSV.fields]
    if "holdout" in cohort.columns:
        names.append("holdout")
    if "daar_grp" not in cohort.columns:
        cohort = cohort.withColumn("daar_grp", year_group(F.year("diag_date")))
    text = cohort.withColumns(
        {
            "stage": F.nullif(F.col("stage"), F.lit(missing_stage)),
            "diag_date": format_day("diag_date"),
            "exit": format_day("exit"),
        }
    )
    keys = [k for k in RUN if k in cohort.columns]
    writer = text.select(*names, *keys).write.mode("errorifexists")
    if keys:
        writer = writer.partitionBy(*keys)
    writer.csv(path, header=True)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, partitioned by the run keys that are present."""
    keys = [k for k in RUN if k in frame.columns]
    writer = frame.write.mode(mode)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(path)


def read_metric_matrix(
    spark: SparkSession,
    path: str,
    models: int,
    value: str = "value",
    classes: int | None = None,
) -> DataFrame:
    """Headerless `;` matrix as a long table `(sim, model, value)`.

    The line number is the run, so each file is read as one text (as many lines
    as runs) and its lines are numbered. With `classes` the first column is a
    class code and every run has that many lines; the table gains `class`.
    """
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
        .filter(F.trim("text") != "")
    )
    cells = lines.withColumn("cells", F.split("text", ";").cast("array<double>"))
    first = 0 if classes is None else 1
    ids = [(F.floor(F.col("line") / F.lit(classes or 1)) + 1).cast("int").alias("sim")]
    if classes is not None:
        ids.append(F.col("cells")[0].cast("int").alias("class"))
    wide = cells.select(
        *ids, *[F.col("cells")[first + m].alias(str(m)) for m in range(models)]
    )
    return unpivot_matrix(wide, [c for c in wide.columns if not c.isdigit()], models, value)


def unpivot_matrix(
    wide: DataFrame, ids: Sequence[str], models: int, value: str = "value"
) -> DataFrame:
    columns = [F.col(f"`{m}`") for m in range(models)]
    return wide.unpivot([F.col(i) for i in ids], columns, "model", value).withColumn(
        "model", F.col("model").cast("int")
    )


def matrix_from_metrics(
    metrics: DataFrame, models: int, value: str = "value", ids: Sequence[str] = ("sim",)
) -> DataFrame:
    """Long `(sim, model, value)` -> one row per run, one column per model."""
    wide = metrics.groupBy(*ids).pivot("model", list(range(models))).agg(F.first(value))
    return wide.select(*ids, *[F.col(f"`{m}`") for m in range(models)])


def write_metric_matrix(
    metrics: DataFrame, path: str, models: int, value: str = "value", klass: str | None = None
) -> None:
    """One line per run (and class), in run order, in one file.

    The matrix has as many lines as there are runs, which the study fixes.
    """
    ids = ["sim"] if klass is None else ["sim", klass]
    wide = matrix_from_metrics(metrics, models, value, ids)
    ordered = wide.coalesce(1).sortWithinPartitions(*ids).drop("sim")
    ordered.write.mode("errorifexists").csv(path, sep=";", header=False)


def write_report_rows(rows: DataFrame, path: str, column: str = "str") -> None:
    """One line of text per model, no header."""
    rows.select(column).write.mode("errorifexists").text(path)
