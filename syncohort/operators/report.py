"""Result tables and report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncohort.functions.columns import decode, format_fixed
from syncohort.operators.attack import relative_rate
from syncohort.operators.stats import (
    merge_results,
    summary_median_iqr,
    summary_median_range,
)
from syncohort.settings import MODEL_LABELS


def report_rows(table: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """` & name & a & b \\\\` per model."""
    cells = [decode("model", MODEL_LABELS), *[F.col(c) for c in columns]]
    shown = [F.coalesce(c, F.lit("")) for c in cells]
    text = F.concat(F.lit(" & "), F.concat_ws(" & ", *shown), F.lit(" \\\\"))
    return table.select(*keep, text.alias("str"))


def similarity_table(
    matches: DataFrame,
    closest: DataFrame,
    identifiability: DataFrame,
    keys: Sequence[str] = ("site", "model"),
) -> DataFrame:
    """Identical matches in percent, distance to closest record and identifiability."""
    keys = list(keys)

    def summary(frame: DataFrame, value: str) -> DataFrame:
        return summary_median_iqr(frame, keys, value, 3).select(*keys, F.col("text").alias(value))

    percent = matches.withColumn("ims", F.col("ims") * F.lit(100.0))
    table = merge_results(summary(percent, "ims"), summary(closest, "dcr"), keys)
    return merge_results(table, summary(identifiability, "id_score"), keys)


def attribute_inference_table(
    members: DataFrame,
    held_out: DataFrame,
    rate: str = "tpr",
    keys: Sequence[str] = ("site", "model"),
    classes: Sequence[int] = (1, 2, 3, 9),
) -> DataFrame:
    """Mean absolute and relative rates per model, two columns per class."""
    keys = list(keys)
    on = [*keys, "sim", "class"]
    both = merge_results(
        members.select(*on, F.col(rate).alias("rate")),
        held_out.select(*on, F.col(rate).alias("baseline")),
        on,
    ).withColumn("relative", relative_rate("rate", "baseline"))
    means = both.groupBy(*keys, "class").agg(
        format_fixed(F.avg("rate")).alias("abs"), format_fixed(F.avg("relative")).alias("rel")
    )
    wide = means.groupBy(*keys).pivot("class", list(classes)).agg(
        F.first("abs").alias("abs"), F.first("rel").alias("rel")
    )
    return wide.select(
        *keys,
        *[F.col(f"`{c}_{kind}`").alias(f"{kind}_{c}") for c in classes for kind in ("abs", "rel")],
    )


def membership_table(
    evaluations: DataFrame,
    metrics: Sequence[str] = ("epsilon", "tpr_1", "tpr_2", "tpr_3"),
    keys: Sequence[str] = ("site", "model"),
) -> DataFrame:
    """Median (min, max) of each attack measure, one column per measure."""
    keys = list(keys)
    long = evaluations.unpivot([F.col(k) for k in keys], list(metrics), "metric", "value")
    table = summary_median_range(long, [*keys, "metric"], "value", 3)
    wide = table.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("text"))
    return wide.select(*keys, *metrics)
