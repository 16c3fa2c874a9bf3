"""Classifiers fitted run by run, on rows whose answer is known."""

import pytest
from pyspark.sql import functions as F

from syncohort.operators import attack, models
from syncohort.plans.derived import STUDY

RUN = ["site", "model", "sim"]


def rows(spark, count, shift):
    frame = spark.range(count).withColumn("sim", F.explode(F.array(F.lit(1), F.lit(2))))
    return frame.select(
        F.lit("main").alias("site"), F.lit(0).alias("model"), "sim", "id",
        *[
            (F.pmod(F.xxhash64("id", "sim", F.lit(c), F.lit(shift)), F.lit(50))
             + F.when(F.col("sim") == 2, shift).otherwise(0)).cast("double").alias(c)
            for c in STUDY.numeric
        ],
        *[(F.col("id") % 2).cast("int").alias(c) for c in STUDY.categorical if c != "stage"],
        F.lit(1).alias("stage"),
    )


def test_real_rows_with_fewer_keys(spark):
    real = rows(spark, 10, 0).filter("sim = 1").drop("model", "sim")
    out = models.per_run(real, rows(spark, 10, 0), lambda r, s: r.select("id"))
    assert sorted(map(tuple, out.select("sim", "id").collect())) == [
        (s, i) for s in (1, 2) for i in range(10)
    ]


def test_a_stopped_study_goes_on(spark, tmp_path):
    real, synthetic = rows(spark, 10, 0), rows(spark, 10, 0)
    seen = []

    def fit(stop):
        def one(r, s):
            sim = s.first().sim
            seen.append(sim)
            if sim == stop:
                raise RuntimeError("stopped")
            return r.select("id")

        return one

    with pytest.raises(RuntimeError, match="stopped"):
        models.per_run(real, synthetic, fit(2), at_once=1, path=str(tmp_path))
    out = models.per_run(real, synthetic, fit(None), at_once=1, path=str(tmp_path))
    assert seen == [1, 2, 2]  # the run that ended is not fitted again
    assert sorted(map(tuple, out.select("sim", "id").collect())) == [(s, i) for s in (1, 2) for i in range(10)]
    models.per_run(real, synthetic, fit(None), path=str(tmp_path))
    assert seen == [1, 2, 2]


def test_rows_without_a_score_are_counted(spark):
    data = [(1, 0.5, 1), (1, None, 0), (1, 0.1, 0), (1, 0.9, 1), (2, None, 1), (2, None, 0)]
    scores = spark.createDataFrame(data, "sim int, score double, member int")
    got = {r.sim: r for r in attack.evaluate_scores(scores, ["sim"]).collect()}
    assert (got[1].unscored, got[1].auc) == (1, 1.0) and (got[2].unscored, got[2].auc) == (2, None)
