import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncohort.functions.draws import hash_normal, hash_uniform, portable_uniform
from syncohort.operators import models
from syncohort.operators import synthesis as synth
from syncohort.settings import StudySettings

SETTINGS = StudySettings()


def people(spark, n=400):
    return spark.range(n).select(
        F.lit("m").alias("site"), "id", (40 + F.col("id") * 7 % 45).cast("int").alias("age"),
        (F.col("id") % 2).cast("int").alias("sex"),
        F.element_at(F.array(*[F.lit(s) for s in SETTINGS.stages]), (F.col("id") % 4 + 1).cast("int"))
        .alias("stage"),
        (2010 + F.col("id") % 3 * 2).cast("int").alias("daar_grp"),
        (F.col("id") % 3 != 0).cast("int").alias("status"),
        (0.1 + F.col("id") * 13 % 50 / 10).alias("t"),
    )


def test_bootstrap_size_and_partitioning(spark):
    cohort = people(spark)
    seen = []
    for parts in (1, 4, 8):
        drawn = synth.bootstrap(cohort.repartition(parts), sims=2)
        seen.append(sorted((r["sim"], r["slot"], r["id"]) for r in drawn.collect()))
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0]) == 800
    assert 0.55 < len({(s, i) for s, _, i in seen[0]}) / 800 < 0.72  # 1 - 1/e of the rows


def test_only_members_are_drawn(spark):
    drawn = synth.bootstrap(people(spark), sims=1, members=F.col("id") % 5 != 0)
    assert drawn.count() == 400
    assert drawn.filter("id % 5 = 0").count() == 0


def test_uniforms(spark):
    frame = spark.range(20000).select(
        hash_uniform("id", 1).alias("a"), portable_uniform("id", 1).alias("b"),
        portable_uniform("id", 2).alias("c"), hash_normal("id", 5).alias("z"),
    ).toPandas()
    for c in ("a", "b", "c"):
        assert 0 <= frame[c].min() and frame[c].max() < 1
        assert abs(frame[c].mean() - 0.5) < 0.01
    assert abs(np.corrcoef(frame["b"], frame["c"])[0, 1]) < 0.03
    assert abs(frame["z"].mean()) < 0.03 and abs(frame["z"].std() - 1) < 0.02


def test_class_draw_follows_the_cumulative_shares(spark):
    cdf = F.array(
        F.struct(F.lit(0.2).alias("upper"), F.lit(1).alias("value")),
        F.struct(F.lit(0.9).alias("upper"), F.lit(2).alias("value")),
        F.struct(F.lit(1.0).alias("upper"), F.lit(9).alias("value")),
    )
    frame = spark.createDataFrame([(u,) for u in (0.0, 0.19, 0.2, 0.89, 0.95, 1.0)], "u double")
    got = [r[0] for r in frame.select(synth.draw_class(cdf, F.col("u"))).collect()]
    assert got == [1, 1, 2, 2, 9, 9]


def test_survival_time_inverts_the_hazard(spark):
    rates = F.array(*[F.lit(r) for r in (0.0, 0.5, 0.0, 0.2, 0.1)])
    frame = spark.createDataFrame(
        [(math.exp(-h),) for h in (0.1, 0.25, 0.26, 0.45, 1.0, 50.0)], "u double"
    )
    got = [r[0] for r in frame.select(synth.draw_survival_time(rates, F.col("u"))).collect()]
    years = [0.7, None, 2.05, 3.0, 8.5, 21.0]
    for days, want in zip(got, years):
        if want is not None:
            assert days == pytest.approx(math.ceil(want * 365.25 - 1e-6), abs=1)


def test_dates_fall_in_their_group_and_before_the_cutoff(spark):
    settings = StudySettings(cutoff="2011-03-01")
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 2 == 0, 2008).otherwise(2010).alias("g")
    )
    dates = rows.select(
        "g", synth.draw_diagnosis_date("g", hash_uniform("id", 3), settings).alias("d")
    ).collect()
    assert all(r["d"] < dt.date(2011, 3, 1) and r["d"].year - r["g"] in (0, 1) for r in dates)
    assert not any((r["d"].month, r["d"].day) == (2, 29) for r in dates)
    assert max(r["d"] for r in dates) == dt.date(2011, 2, 28)


def test_saturated_synthesis_keeps_the_margins(spark):
    cohort = people(spark, 2000)
    settings = StudySettings(start_year=2010, end_year=2015)
    submodels = (("age", ()), ("sex", ()), ("stage", ("sex",)), ("daar_grp", ()))
    tables, rates = synth.saturated_model(cohort, submodels, ["sex"])
    rows = synth.with_runs(cohort.select("site", "id"), [0], 2)
    drawn = synth.synthesize(rows, tables, rates, ["sex"], settings)
    got = drawn.groupBy("sim").agg(
        F.avg("age").alias("age"), F.avg("sex").alias("sex"), F.count("*").alias("n"),
        F.avg((F.col("stage") == 999).cast("double")).alias("missing"),
    ).collect()
    assert len(got) == 2
    for row in got:
        assert row["n"] == 2000
        assert abs(row["age"] - 62) < 1.5 and abs(row["sex"] - 0.5) < 0.05
        assert abs(row["missing"] - 0.25) < 0.05
    assert drawn.filter("exit > date '2021-12-31' OR diag_date >= exit").count() == 0


def test_terms_of_the_specifications():
    predictors = ["age", "sex", "stage"]
    assert models.model_terms(models.MODEL_LEVELS[0], predictors) == []
    assert models.model_terms(models.MODEL_LEVELS[1], predictors) == [("age",), ("sex",), ("stage",)]
    assert ("age", "stage") in models.model_terms(models.MODEL_LEVELS[2], predictors)
    assert ("age", "sex") not in models.model_terms(models.MODEL_LEVELS[2], predictors)
    assert ("age", "sex", "stage") in models.model_terms(models.MODEL_LEVELS[4], predictors)


def test_multinomial_margins_are_the_shares(spark):
    fit = models.fit_categorical(people(spark), "sex", [], {})
    assert fit.classes == [0, 1]
    assert fit.beta[0, 0] == pytest.approx(0.0)
    assert fit.covariance[0, 0] == pytest.approx(4 / 400)


def test_main_effect_logit_reproduces_cell_shares(spark):
    cohort = people(spark).withColumn(
        "y", F.when((F.col("id") % 10 < 3) & (F.col("sex") == 1), 2).otherwise(1)
    )
    fit = models.fit_categorical(cohort, "y", [("sex",)], {"sex": models.dummies("sex", [0, 1])})
    logit = fit.beta[0].sum()
    share = cohort.filter("sex = 1").agg(F.avg((F.col("y") == 2).cast("double"))).first()[0]
    assert 1 / (1 + math.exp(-logit)) == pytest.approx(share, abs=1e-3)


def test_coefficient_draws_have_the_fit_s_moments():
    fit = models.Fit(np.array([1.0, -2.0, 3.0]), np.array([[0.5, 0.2, 0], [0.2, 0.4, 0], [0, 0, 0]]))
    draws, _ = models.draw_coefficients(fit, 20000, seed=1)
    assert np.allclose(draws.mean(axis=0), fit.beta, atol=0.02)
    assert np.allclose(np.cov(draws.T), fit.covariance, atol=0.02)
    assert np.allclose(draws[:, 2], 3.0)


def test_age_regression_reproduces_the_distribution(spark):
    cohort = people(spark)
    fit = models.fit_continuous(cohort)
    assert fit.rmse < 1.5
    assert fit.limits == (40.0, 84.0)


def test_lookup_tables_are_written_and_slots_spread(spark):
    """Draws read written tables of known size, and few bytes of slots still fill all cores."""
    cohort = spark.range(1000).select(
        F.lit("m").alias("site"), "id", (F.col("id") % 7).cast("int").alias("age"),
        (F.col("id") % 2).cast("int").alias("status"), F.lit(1.5).alias("t"),
    )
    tables, rates = synth.saturated_model(cohort, (("age", ()),), ("status",))
    for table in (tables["age"][1], rates):
        assert table.inputFiles()
    slots = synth.spread(cohort.select("site", "id"))
    assert slots.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    held = slots.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in held) < 1000 / 4
