"""ROC measures and inference attacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.functions.columns import ratio, run_keys
from syncohort.functions.draws import hash_uniform
from syncohort.functions.ordered import running_totals
from syncohort.functions.special import binomial_lower, binomial_upper
from syncohort.lineage import cut, join_constants
from syncohort.settings import RUN


def roc_points(
    scores: DataFrame,
    keys: Sequence[str] = RUN,
    score: str = "score",
    positive: str = "member",
) -> DataFrame:
    """True and false positives above every distinct score, from high to low.

    Rows are counted per distinct score before they are put in order. The origin
    (nothing flagged) is not a row; `tpr_at_fpr` accounts for it.
    """
    keys = run_keys(scores.columns, keys)
    counts = (
        scores.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.col(positive).cast("bigint")).alias("pos"),
            F.sum((1 - F.col(positive)).cast("bigint")).alias("neg"),
        )
    )
    sizes = counts.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    running = running_totals(counts, keys, ["score"], {"tp": "pos", "fp": "neg"}, descending=True)
    return running.join(sizes, keys).withColumns(
        {"tpr": ratio("tp", "positives"), "fpr": ratio("fp", "negatives")}
    )


def roc_auc(points: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Area under the curve; ties count one half."""
    keys = run_keys(points.columns, keys)
    area = F.col("neg").cast("double") * (
        (F.col("tp") - F.col("pos")).cast("double") + F.col("pos") / F.lit(2.0)
    )
    return points.groupBy(*keys).agg(
        (
            F.sum(area)
            / F.nullif(
                F.first("positives").cast("double") * F.first("negatives").cast("double"),
                F.lit(0.0),
            )
        ).alias("auc")
    )


def tpr_at_fpr(
    points: DataFrame,
    keys: Sequence[str] = RUN,
    levels: Sequence[float] = (0.0, 0.001, 0.01),
) -> DataFrame:
    """Largest true positive rate with a false positive rate up to each level."""
    keys = run_keys(points.columns, keys)
    best = [
        F.coalesce(F.max(F.when(F.col("fpr") <= level, F.col("tpr"))), F.lit(0.0)).alias(
            f"tpr_{i}"
        )
        for i, level in enumerate(levels, start=1)
    ]
    return points.groupBy(*keys).agg(*best)


#: Boxes that the corners of a curve are bounded in.
BOXES = 4096


def epsilon_corners(points: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, positives, negatives, tp, fp): thresholds that can have the largest bound.

    The bound grows with true and falls with false positives. So per count of one kind
    only the best count of the other matters, and of a box of neighbouring corners none
    is better than its most true with its fewest false positives. A box counts only
    where that reaches the largest bound of the corners that stand first in a box.
    """
    keys = run_keys(points.columns, keys)
    sizes = ["positives", "negatives"]
    usable = points.filter((F.col("fp") > 0) & (F.col("tp") > 0))
    corners = usable.groupBy(*keys, *sizes, "fp").agg(F.max("tp").alias("tp"))
    corners = corners.groupBy(*keys, *sizes, "tp").agg(F.min("fp").alias("fp"))
    box = F.floor(F.col("tp") * F.lit(BOXES) / F.col("positives")).alias("_box")
    boxes = corners.groupBy(*keys, *sizes, box).agg(
        F.max("tp").alias("_most"),
        F.min("fp").alias("_fewest"),
        F.max_by("tp", -F.col("fp")).alias("_first"),
    )
    shared = binomial_upper("_fewest", "negatives")
    bounded = cut(
        boxes.select(
            *keys, "_box",
            F.ln(binomial_lower("_most", "positives") / shared).alias("_possible"),
            F.ln(binomial_lower("_first", "positives") / shared).alias("_sure"),
        ),
        "boxes",
    )
    sure = bounded.groupBy(*keys).agg(F.max("_sure").alias("_least"))
    open_ = (
        join_constants(bounded, sure, keys)
        .filter(F.col("_possible") >= F.col("_least") - F.lit(1e-12))
        .select(*keys, "_box")
    )
    return corners.select("*", box).join(open_, [*keys, "_box"], "left_semi").drop("_box")


def empirical_epsilon(points: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Largest lower bound of epsilon over all thresholds, floored at 0."""
    keys = run_keys(points.columns, keys)
    bound = F.ln(binomial_lower("tp", "positives") / binomial_upper("fp", "negatives"))
    found = (
        epsilon_corners(points, keys)
        .withColumn("bound", bound)
        .groupBy(*keys)
        .agg(F.max("bound").alias("bound"))
    )
    return (
        points.select(*keys).distinct().join(found, keys, "left")
        .select(*keys, F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(0.0)).alias("epsilon"))
    )


def evaluate_scores(
    scores: DataFrame,
    keys: Sequence[str] = RUN,
    score: str = "score",
    positive: str = "member",
    levels: Sequence[float] = (0.0, 0.001, 0.01),
) -> DataFrame:
    """AUC, true positive rates and epsilon of one attack, one row per run.

    Rows without a score are in no curve; `unscored` says how many a run has, and a run of
    which no row has a score keeps its row, without measures. Scores and curve are written
    out: scores are expensive to compute again, and the three measures read the same curve.
    """
    keys = run_keys(scores.columns, keys)
    scores = cut(scores.select(*keys, score, positive), "scores")
    points = cut(roc_points(scores, keys, score, positive), "roc")
    unscored = scores.groupBy(*keys).agg(F.count_if(F.col(score).isNull()).alias("unscored"))
    return (
        unscored.join(roc_auc(points, keys), keys, "left")
        .join(tpr_at_fpr(points, keys, levels), keys, "left")
        .join(empirical_epsilon(points, keys), keys, "left")
    )


def split_reference(
    real: DataFrame, uniform: Column | None = None, keys: Sequence[str] = RUN
) -> tuple[DataFrame, DataFrame]:
    """(test set, reference): a random half of the held-out rows becomes the reference.

    The draw depends on the row and its run only.
    """
    if uniform is None:
        uniform = hash_uniform(*run_keys(real.columns, keys), "id", 17)
    is_reference = (F.col("holdout") == 1) & (uniform < F.lit(0.5))
    marked = real.withColumn("_reference", is_reference)
    return (
        marked.filter(~F.col("_reference")).drop("_reference"),
        marked.filter("_reference").drop("_reference"),
    )


def with_member(scores: DataFrame) -> DataFrame:
    return scores.withColumn("member", 1 - F.col("holdout"))


def relative_rate(rate: str, baseline: str) -> Column:
    """Gain over the held-out baseline as a share of what was left to gain."""
    left = F.lit(1.0) - F.col(baseline)
    return (F.col(rate) - F.col(baseline)) / F.nullif(left, F.lit(0.0))


def class_scores(
    predictions: DataFrame,
    ids: Sequence[str],
    truth: str,
    probability: str,
    classes: Sequence[int],
) -> DataFrame:
    """One row per record and class: score of the class and whether it is the true one."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(probability)[i].alias("score"),
                (F.col(truth) == F.lit(c)).cast("int").alias("hit"),
            )
            for i, c in enumerate(classes)
        ]
    )
    return predictions.select(*ids, F.inline(cells))


def accuracy(predictions: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy")
    )
