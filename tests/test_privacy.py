import pytest
from pyspark.sql import functions as F

from syncohort.operators import frequencies as freq
from syncohort.operators import privacy

KEYS = ["site"]
SUBMODELS = (("age", ()), ("sex", ()), ("stage", ("sex",)), ("daar_grp", ("stage",)))


def people(spark, extra=()):
    rows = [
        ("m", i, 60 + i % 3, i % 2, [1, 2, 3, 999][(i // 2) % 4], 2000 + 2 * (i % 2), (i // 3) % 2,
         0.2 + (i * 7 % 40) / 10)
        for i in range(240)
    ]
    return spark.createDataFrame(
        rows + list(extra),
        "site string, id long, age int, sex int, stage int, daar_grp int, status int, t double",
    )


def inputs(cohort, draws=6):
    tables = []
    for variable, parents in SUBMODELS:
        counts = freq.class_counts(cohort, KEYS, variable, parents)
        tables.append(
            (variable, parents, freq.dirichlet_draws(counts, KEYS, variable, parents, draws))
        )
    by = ["site", "sex", "stage"]
    rates = freq.gamma_rates(freq.event_exposure(cohort, by), by, draws)
    return privacy.covariate_probability(privacy.scenario_grid(cohort), tables, KEYS), rates


def evidence(cohort, p_cov, rates, loglik):
    return privacy.candidate_evidence(cohort, p_cov, rates, loglik, KEYS)


def test_posteriors_sum_to_one_and_loss_is_not_negative(spark):
    cohort = people(spark)
    p_cov, rates = inputs(cohort)
    found = evidence(cohort, p_cov, rates, privacy.synthetic_loglik(cohort, p_cov, rates, keys=KEYS))
    sums = privacy.candidate_posterior(found, (), KEYS).groupBy("id").agg(
        F.sum("probability").alias("a"), F.sum("prior").alias("b"), F.sum("prob_prior").alias("c"),
        F.count("*").alias("n"), F.max("rank").alias("r"), F.sum("correct").alias("t"),
    )
    for row in sums.collect():
        assert (row["a"], row["b"], row["c"]) == pytest.approx((1.0, 1.0, 1.0))
        assert (row["n"], row["r"], row["t"]) == (4, 4, 1)
    assert privacy.maximum_local_privacy_loss(found, KEYS).first()["ll_diff"] >= 0


def test_no_loss_when_the_table_says_nothing_about_the_draws(spark):
    cohort = people(spark)
    p_cov, rates = inputs(cohort)
    flat = p_cov.select("site", "h").distinct().withColumn("log_p", F.lit(-123.0))
    found = evidence(cohort, p_cov, rates, flat)
    assert privacy.maximum_local_privacy_loss(found, KEYS).first()["ll_diff"] < 1e-9


def test_zero_probability_makes_the_table_impossible(spark):
    cohort = people(spark)
    p_cov, rates = inputs(cohort)
    broken = p_cov.withColumn(
        "p_cov", F.when((F.col("h") == 2) & (F.col("stage") == 1), 0.0).otherwise(F.col("p_cov"))
    )
    table = privacy.synthetic_loglik(cohort, broken, rates, keys=KEYS)
    assert {r["h"]: r["log_p"] is None for r in table.collect()} == {
        h: h == 2 for h in range(1, 7)
    }


def test_invalid_draws_are_replaced_from_the_surplus(spark):
    cohort = people(spark)
    p_cov, rates = inputs(cohort)
    broken = rates.withColumn(
        "rate", F.when((F.col("h") == 2) & (F.col("interval") == 0), 0.0).otherwise(F.col("rate"))
    )
    kept, kept_rates = privacy.valid_draws(p_cov, broken, 4, KEYS)
    assert sorted(r[0] for r in kept.select("h").distinct().collect()) == [1, 2, 3, 4]
    assert kept_rates.filter("rate <= 0").count() == 0
    second = kept.filter("h = 2").agg(F.sum("p_cov")).first()[0]
    assert second == pytest.approx(p_cov.filter("h = 3").agg(F.sum("p_cov")).first()[0])


def test_planted_outlier_is_the_riskiest(spark):
    # The draws disagree only about the one person of age 63, so nobody else can lose.
    cohort = people(spark, [("m", 999, 63, 1, 999, 2002, 1, 2.5)])
    p_cov, rates = inputs(cohort)
    same = p_cov.filter("h = 1").drop("h").withColumn("h", freq.draw_numbers(6))
    told = (F.col("age") == 63) & (F.col("stage") == 1)
    varied = same.withColumn(
        "p_cov", F.when(told, F.col("p_cov") * F.col("h")).otherwise(F.col("p_cov"))
    )
    hazards = rates.filter("h = 1").drop("h").withColumn("h", freq.draw_numbers(6))
    loglik = varied.select("site", "h").distinct().withColumn("log_p", F.col("h") * -2.0)
    found = evidence(cohort, varied, hazards, loglik)
    assert privacy.riskiest_person(found, KEYS).first()["id"] == 999
    losses = {r["id"]: r["loss"] for r in privacy.person_loss(found, KEYS).collect()}
    assert losses[999] > 0.1
    assert max(v for k, v in losses.items() if k != 999) < 1e-9


def test_sweep_runs_from_zero_to_one(spark):
    cohort = people(spark)
    p_cov, rates = inputs(cohort)
    found = evidence(cohort, p_cov, rates, privacy.synthetic_loglik(cohort, p_cov, rates, keys=KEYS))
    band = privacy.prior_sweep(found, KEYS).orderBy("prior").collect()
    assert len(band) == 101
    assert band[0]["ymax"] == 0.0 and band[-1]["ymax"] == 1.0
    assert all(r["ymin"] <= r["ymax"] for r in band)
    assert all(r["ymax"] - r["ymin"] > 0.01 - 1e-12 for r in band if r["ymax"] > 0.01)
