"""Fits on patterns, against frequencies, known optima and each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncohort.functions.splines import spline_basis, spline_values
from syncohort.operators import models, newton
from syncohort.operators.frequencies import event_exposure
from syncohort.settings import StudySettings

SCHEMA = "fit string, label double, n double, x array<double>"


def gradient_at(problem, rows, beta):
    """Of the plain log likelihood, in the original design."""
    total = np.zeros_like(beta)
    for label, n, x in rows:
        x = np.array(x)
        if problem.classes:
            raised = np.exp(np.append(0.0, beta @ x))
            hit = np.arange(problem.classes) == label
            total += np.outer((n * (hit - raised / raised.sum()))[1:], x)
        else:
            total += (label - n * math.exp(beta[0] @ x)) * x
    return total


def random_problem(rng, classes, width, patterns=60):
    out = []
    for _ in range(patterns):
        x = [*rng.normal(size=width - 1).round(2).tolist(), 1.0]
        if classes:
            out += [(float(k), float(rng.integers(1, 9)), x) for k in range(classes)]
        else:
            out.append((float(rng.integers(0, 6)), float(rng.uniform(0.5, 3)), x))
    return out


def test_all_problems_reach_their_optimum_together(spark, monkeypatch):
    monkeypatch.setattr(newton, "BLOCK", 16)
    rng = np.random.default_rng(0)
    problems = {
        "binary": newton.Problem(2, 4), "three": newton.Problem(3, 6), "rate": newton.Problem(0, 5),
        "constant": newton.Problem(4, 1), "flat rate": newton.Problem(0, 1), "single": newton.Problem(1, 2),
    }
    data = {f: random_problem(rng, p.classes, p.width) for f, p in problems.items()}
    rows = spark.createDataFrame([(f, *r) for f, d in data.items() for r in d], SCHEMA)
    found = newton.solve(rows, problems, ridge=0.0)
    for fit, problem in problems.items():
        solved = found[fit]
        assert solved.converged and solved.steps < 15
        assert solved.beta.shape == (problem.vectors, problem.width)
        assert np.abs(gradient_at(problem, data[fit], solved.beta)).max(initial=0) < 1e-3
    # Covariance: the inverse of the numerical second derivative.
    problem, solved, step = problems["rate"], found["rate"], 1e-5
    second = [
        (gradient_at(problem, data["rate"], solved.beta - e) - gradient_at(problem, data["rate"], solved.beta + e))[0] / (2 * step)
        for e in step * np.eye(5)[:, None, :]
    ]
    assert np.allclose(solved.covariance, np.linalg.inv(second), rtol=1e-4)


def test_separated_and_constant_columns_stay_finite(spark):
    rows = [("a", float(k), 50.0, [float(k), 2.0, float(-k), 1.0]) for k in (0, 1)]
    found = newton.solve(spark.createDataFrame(rows, SCHEMA), {"a": newton.Problem(2, 4)})["a"]
    assert found.converged and np.isfinite(found.beta).all() and np.isfinite(found.covariance).all()
    logit = found.beta[0] @ np.array([1.0, 2.0, -1.0, 1.0])
    assert logit > 5


def test_too_few_steps_are_reported(spark):
    rows = [("a", float(k), 9.0 + 20 * k * x, [x, 1.0]) for k in (0, 1) for x in (0.0, 1.0, 3.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert not newton.solve(frame, {"a": newton.Problem(2, 2)}, max_steps=1)["a"].converged


def test_problem_without_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    found = newton.solve(frame, {"a": newton.Problem(2, 2), "b": newton.Problem(1, 2)})
    assert not found["a"].converged and found["b"].converged


def test_spline_values_equal_the_columns(spark):
    points, knots = [-1.0, 0.0, 0.3, 0.5, 0.9, 2.0], [0.0, 0.25, 0.5, 1.0]
    frame = spark.createDataFrame([(p,) for p in points], "v double")
    want = [list(r) for r in frame.select(*spline_basis("v", knots)).collect()]
    assert np.allclose(spline_values(np.array(points), knots), want)


def people(spark, n, follow_up):
    return spark.range(n).select(
        F.lit("m").alias("site"), "id", (50 + F.col("id") % 7).cast("int").alias("age"),
        (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("sex"),
        F.element_at(F.array(*[F.lit(s) for s in (1, 2, 3, 999)]), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) + 1).cast("int")).alias("stage"),
        (2010 + F.col("id") % 3 * 2).cast("int").alias("daar_grp"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) != 0).cast("int").alias("status"),
        (F.ceil(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(7600)) / 7600.0 * 365.25 * follow_up) / 365.25 + 1 / 365.25).alias("t"),
    )


def test_every_interval_has_its_share_of_events(spark):
    cohort = people(spark, 4000, 21.0).cache()
    for number in (1, 5):
        level = models.MODEL_LEVELS[number]
        scale = models.time_scale(cohort, level)
        assert len(scale.cuts) == level.df and max(scale.cuts) > 10
        events = {r.interval: r.d for r in event_exposure(cohort, ["site"], scale.cuts).collect()}
        mean = sum(events.values()) / level.df
        assert all(0.8 * mean < d < 1.2 * mean for d in events.values())
        assert [len(w) for w in scale.weights] == [level.df] * level.df_tvc


def test_saturated_hazard_is_events_over_exposure(spark):
    cohort = people(spark, 3000, 21.0).cache()
    level = models.ModelLevel("main", df=5, tvc=("sex",), df_tvc=4)
    scale = models.time_scale(cohort, level)
    codings = {"sex": models.dummies("sex", [0, 1])}
    fit = models.fit_survival(cohort, level, codings, scale, ridge=0.0)
    assert fit.converged
    beta = F.array(*[F.lit(float(b)) for b in fit.beta])
    terms, varying = models.survival_parts(level, codings)
    hazards = models.interval_hazards(beta, F.array(*terms), F.array(*varying), (1, 1), scale)
    found = {
        (r.sex, r.interval): r.rate
        for r in cohort.select("sex").distinct().select("sex", F.posexplode(hazards).alias("interval", "rate")).collect()
    }
    for r in event_exposure(cohort, ["sex"], scale.cuts).collect():
        assert found[r.sex, r.interval] == pytest.approx(r.d / r.exposure, rel=1e-6)


def test_no_events_give_one_interval(spark):
    cohort = people(spark, 50, 5.0).withColumn("status", F.lit(0))
    assert models.time_scale(cohort, models.MODEL_LEVELS[3]) == models.TimeScale((0.0,), ())


def test_saturated_classes_are_the_shares(spark):
    cohort = people(spark, 2000, 5.0).cache()
    codings = {"sex": models.dummies("sex", [0, 1]), "stage": models.dummies("stage", [1, 2, 3, 999])}
    terms = [("sex",), ("stage",), ("sex", "stage")]
    fit = models.fit_categorical(cohort, "daar_grp", terms, codings, ridge=0.0)
    design = [*models.term_columns(terms, codings), F.lit(1.0)]
    rows = cohort.groupBy("sex", "stage").agg(
        *[F.avg((F.col("daar_grp") == c).cast("double")).alias(f"p{c}") for c in fit.classes],
        F.first(F.array(*design)).alias("x"),
    )
    for r in rows.collect():
        raised = np.exp(np.append(0.0, fit.beta @ np.array(r.x)))
        assert np.allclose(raised / raised.sum(), [r[f"p{c}"] for c in fit.classes], atol=1e-7)


def test_chains_fit_all_levels(spark):
    cohort = people(spark, 800, 8.0).cache()
    settings = StudySettings()
    chains = models.fit_chains(cohort, settings, [0, 1, 3])
    one = models.fit_categorical(cohort, "stage", chains[1].terms["stage"], chains[1].codings)
    assert np.allclose(one.beta, chains[1].fits["stage"].beta, atol=1e-6)
    assert all(c.converged for c in chains.values())
