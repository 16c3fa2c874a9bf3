"""Rows without a partner are reported or kept, never dropped."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from syncohort.functions import special
from syncohort.operators import density, distance, privacy, stats

PERSONS = "site string, model int, sim int, id long, age int, sex int, daar_grp int, stage int, t double, status int"


@pytest.fixture(scope="module")
def persons(spark):
    rows = [("a", 1, 1, 1, 50, 0, 2000, 1, 0.6, 1), ("a", 1, 1, 2, 60, 1, 2000, 2, 0.7, 0)]
    return spark.createDataFrame(rows, PERSONS)


def tables(spark, patterns, stages):
    cov = [("a", 1, 1, age, sex, 2000, s, 1, 0.25) for age, sex in patterns for s in (1, 2)]
    rates = [("a", 1, 1, sex, s, j, 1, 0.5) for sex in (0, 1) for s in stages for j in range(6)]
    return (
        spark.createDataFrame(cov, "site string, model int, sim int, age int, sex int, daar_grp int, stage int, h int, p_cov double"),
        spark.createDataFrame(rates, "site string, model int, sim int, sex int, stage int, interval int, h int, rate double"),
    )


def test_loglik_is_missing_where_a_rate_is(spark, persons):
    both = [(50, 0), (60, 1)]
    known = privacy.synthetic_loglik(persons, *tables(spark, both, (1, 2))).first().log_p
    assert known is not None and known < 0
    lacking = privacy.synthetic_loglik(persons, *tables(spark, both, (1,))).collect()
    assert [r.log_p for r in lacking] == [None]
    pattern = privacy.synthetic_loglik(persons, *tables(spark, both[:1], (1, 2))).collect()
    assert [r.log_p for r in pattern] == [None]


def test_persons_without_probability_stop_the_job(spark, persons):
    cov, rates = tables(spark, [(50, 0), (60, 1)], (1, 2))
    assert privacy.candidate_ratio(persons, cov, rates).select("id").distinct().count() == 2
    cov, rates = tables(spark, [(50, 0)], (1, 2))
    with pytest.raises(Exception, match="row without lookup partner"):
        privacy.candidate_ratio(persons, cov, rates).collect()


def test_too_few_valid_draws_stop_the_job(spark):
    cov = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.0), (1, 3, 0.2)], "sim int, h int, p_cov double")
    rates = spark.createDataFrame([(1, h, 0.1) for h in (1, 2, 3)], "sim int, h int, rate double")
    kept, _ = privacy.valid_draws(cov, rates, 2, ("sim",))
    assert sorted(r.p_cov for r in kept.collect()) == [0.2, 0.5]
    with pytest.raises(Exception, match="fewer than 3 valid draws"):
        privacy.valid_draws(cov, rates, 3, ("sim",))[0].collect()


def test_incomplete_samples_stay(spark):
    schema = "site string, model int, sim int, id long, x double, y double"
    data = spark.createDataFrame([("a", 1, 1, 1, 0.0, 0.0), ("a", 1, 1, 2, 1.0, 1.0)], schema)
    samples = spark.createDataFrame([("a", 1, 1, 7, 0.1, 0.0), ("a", 1, 1, 8, None, 0.0)], schema)
    got = distance.nearest_records(data, samples, ["x", "y"], [])
    assert sorted((r.id, r.rank, r.neighbour) for r in got.collect()) == [(7, 1, 1), (8, 1, None)]


def test_median_run_ties(spark):
    rows = [(1, s, v) for s, v in ((1, 0.1), (2, 0.1 + 0.2), (3, 0.7), (4, 0.5))]
    frame = spark.createDataFrame(rows, "model int, sim int, v double")
    assert stats.median_run(frame, ["model"], "v").first().sim == 2


def test_normal_quantiles():
    p = np.concatenate([10.0 ** -np.arange(1, 300, 7), np.linspace(0.001, 0.999, 999), 1 - 10.0 ** -np.arange(1, 15)])
    want = np.array([NormalDist().inv_cdf(x) for x in p])
    assert np.allclose(special.normal_quantiles(p), want, rtol=1e-9, atol=1e-12)
    assert np.isnan(special.normal_quantiles(np.array([0.0, 1.0, -1.0, np.nan]))).all()


def test_normal_quantile_column(spark):
    p = [10.0**-k for k in range(1, 300, 7)] + [k / 1000 for k in range(1, 1000)] + [1 - 10.0**-k for k in range(1, 15)]
    frame = spark.createDataFrame([(x,) for x in p], "p double").select(special.normal_quantile("p").alias("z"))
    got = np.array([r.z for r in frame.collect()])
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=1e-13, atol=1e-14)
    outside = spark.createDataFrame([(x,) for x in (0.0, 1.0, -1.0, 2.0, None)], "p double")
    assert {r[0] for r in outside.select(special.normal_quantile("p")).collect()} == {None}


def test_runs_and_samples_without_a_density_stay(spark):
    """Run 2 has no spread in y, and one sample of run 1 lacks a value."""
    data = [("a", 1, s, i, float(i * i % 7), float(i % 5) if s == 1 else 1.0) for s in (1, 2) for i in range(12)]
    schema = "site string, model int, sim int, id long, x double, y double"
    samples = spark.createDataFrame([*data, ("a", 1, 1, 99, None, 1.0)], schema)
    found = density.log_density(spark.createDataFrame(data, schema), samples, ["x", "y"]).collect()
    assert len(found) == 25
    assert all((r.log_density is None) == (r.sim == 2 or r.id == 99) for r in found)


def test_log_gamma():
    x = np.concatenate([np.linspace(0.05, 30, 600), [1e3, 1e6, 1e12]])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(special._log_gamma(x), want, rtol=1e-12, atol=1e-11)
