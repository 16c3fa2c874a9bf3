"""Privacy loss of a fitted model against the same sums written out in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncohort.lineage import cut, scratch_path
from syncohort.operators import fitted_privacy as fp
from syncohort.operators import models, privacy
from syncohort.operators.draw_store import DrawStore
from syncohort.settings import StudySettings

DRAWS = 3
SETTINGS = StudySettings()


def people(spark, n):
    """No covariate tells another one, so every effect is finite."""
    def any_of(purpose, values):
        pick = F.pmod(F.xxhash64("id", F.lit(purpose)), F.lit(len(values))) + 1
        return F.element_at(F.array(*[F.lit(v) for v in values]), pick.cast("int"))

    return spark.range(n).select(
        F.lit("m").alias("site"), "id", any_of(1, range(50, 70)).alias("age"),
        any_of(2, (0, 1)).alias("sex"), any_of(3, SETTINGS.stages).alias("stage"),
        any_of(4, (2010, 2012, 2014)).alias("daar_grp"), any_of(5, (0, 1)).alias("status"),
        any_of(6, [0.1 + i / 10 for i in range(45)]).alias("t"),
    )


@pytest.fixture(scope="module")
def study(spark):
    cohort = cut(people(spark, 300), "cohort")
    chains = models.fit_chains(cohort, SETTINGS, [2])
    requests = fp.draw_requests(spark, "m", [2], 1, DRAWS)
    draws = cut(fp.coefficient_draws(requests, chains), "draws")
    return cohort, chains[2], draws


def store_of(spark, chain, draws):
    store = DrawStore(spark, scratch_path(spark, "draws"), fp.draws_schema({2: chain}))
    store.put(draws)
    return store


def test_draws_repeat_and_differ(spark, study):
    _, chain, draws = study
    again = fp.coefficient_draws(fp.draw_requests(spark, "m", [2], 1, DRAWS), {2: chain})
    assert again.orderBy("h").collect() == draws.orderBy("h").collect()
    betas = [tuple(r["beta_t"]) for r in draws.collect()]
    assert len(set(betas)) == DRAWS
    long = fp.long_coefficients(draws)
    width = sum(f.beta.size for f in chain.fits.values())
    assert long.count() == DRAWS * width


def plain_age_draws(draws, knots):
    """Age coefficients on the plain spline basis."""
    scale = (knots[-1] - knots[0]) ** 2
    cubic = range(1, len(knots) - 1)
    beta = F.transform("beta_age", lambda b, i: F.when(i.isin(*cubic), b / F.lit(scale)).otherwise(b))
    return draws.select("site", "model", "sim", "h", "rmse", beta.alias("beta"))


def test_loss_equals_the_written_out_sums(spark, study):
    cohort, chain, draws = study
    vectors, knots = {r["h"]: r for r in draws.collect()}, chain.fits["age"].knots
    ages = {
        (r["h"], r["age"]): r["p"]
        for r in privacy.continuous_probability(plain_age_draws(draws, knots), knots).collect()
    }
    candidates = cohort.drop("stage").withColumn(
        "stage", F.explode(F.array(*[F.lit(s) for s in SETTINGS.stages]))
    ).join(cohort.select("id", F.col("stage").alias("true")), "id")
    designs = {v: [*models.term_columns(t, chain.codings), F.lit(1.0)] for v, t in chain.terms.items()}
    n = len(chain.cuts)
    rows = candidates.select(
        "*", *[F.array(*[c.cast("double") for c in d]).alias(f"d_{v}") for v, d in designs.items()]
    )
    design = models.survival_design(chain.level, chain.codings, chain.scale)
    for j in range(n):
        step = rows.withColumn("interval", F.lit(j))
        rows = step.withColumn(f"x_{j}", F.array(*[c.cast("double") for c in design]))
        rows = rows.drop("interval")
    rows = rows.collect()
    ends = [*chain.cuts[1:], np.inf]

    def log_p(row, h, with_age):
        draw, total = vectors[h], 0.0
        for v in chain.terms:
            x, classes = np.array(row[f"d_{v}"]), chain.fits[v].classes
            eta = np.append(0.0, np.array(draw[f"beta_{v}"]).reshape(-1, len(x)) @ x)
            total += eta[classes.index(row[v])] - np.log(np.exp(eta).sum())
        if with_age:
            total += np.log(ages[h, row["age"]])
        for j, (lo, hi) in enumerate(zip(chain.cuts, ends)):
            eta = np.array(row[f"x_{j}"]) @ np.array(draw["beta_t"])
            total -= np.exp(eta) * max(min(row["t"], hi) - lo, 0.0)
            if row["status"] and lo < row["t"] <= hi:
                total += eta
        return total

    true = [r for r in rows if r["stage"] == r["true"]]
    table = np.array([sum(log_p(r, h, True) for r in true) for h in range(1, DRAWS + 1)])
    own = {r["id"]: np.array([log_p(r, h, False) for h in range(1, DRAWS + 1)]) for r in true}
    scores = {}
    for r in rows:
        ratio = np.array([log_p(r, h, False) for h in range(1, DRAWS + 1)]) - own[r["id"]]
        scores.setdefault(r["id"], []).append(
            np.logaddexp.reduce(ratio + table) - np.logaddexp.reduce(ratio)
        )
    expected = {i: max(s) - min(s) for i, s in scores.items()}

    # The cohort itself stands for the synthetic table.
    synthetic = cohort.withColumns({"model": F.lit(2), "sim": F.lit(1)})
    store = store_of(cohort.sparkSession, chain, draws)
    found = fp.chain_evidence(cohort, synthetic, {2: chain}, store)
    losses = {r["id"]: r["loss"] for r in privacy.person_loss(found).collect()}
    assert losses == pytest.approx(expected, rel=1e-5, abs=1e-6)


def test_one_vector_is_replaced_alone(spark, study):
    _, chain, draws = study
    store = store_of(spark, chain, draws)
    before = {r["h"]: r for r in store.manifest().collect()}
    assert set(before) == set(range(1, DRAWS + 1)) and {r["attempt"] for r in before.values()} == {0}
    old = {r["h"]: r["beta_t"] for r in store.read().collect()}
    request = cut(store.read().filter("h = 3").select("site", "model", "sim", "h", F.lit(1).alias("attempt")), "redraw")
    store.put(fp.coefficient_draws(request, {2: chain}))
    after = {r["h"]: r for r in store.manifest().collect()}
    new = {r["h"]: r["beta_t"] for r in store.read().collect()}
    assert set(after) == set(before) and after[3]["attempt"] == 1 and new[3] != old[3]
    for h in set(before) - {3}:
        assert after[h] == before[h] and new[h] == old[h]


def test_invalid_vectors_are_redrawn_until_all_are_valid(spark, study):
    """A tenth of a run's vectors has infinite hazards: they go, the others stay."""
    cohort, chain, _ = study
    draws = fp.coefficient_draws(fp.draw_requests(spark, "m", [2], 2, 20), {2: chain})
    broken = F.transform("beta_t", lambda b: F.lit(1e6))
    draws = draws.withColumn(
        "beta_t", F.when((F.col("sim") == 1) & F.col("h").isin(4, 9), broken).otherwise(F.col("beta_t"))
    )
    store = store_of(spark, chain, draws)
    kept = {(r["sim"], r["h"]): r["beta_t"] for r in store.read().collect()}
    synthetic = cohort.withColumn("model", F.lit(2)).withColumn("sim", F.explode(F.array(F.lit(1), F.lit(2))))
    cells = cut(fp.scenario_cells(cohort, synthetic, {2: chain}), "cells")
    first = fp.table_likelihood(cells, store.read(), {2: chain}).collect()
    assert {(r["sim"], r["h"]) for r in first if r["bad"]} == {(1, 4), (1, 9)}
    found = fp.valid_draws(store, cells, {2: chain}).collect()
    assert sorted((r["sim"], r["h"]) for r in found) == [(s, h) for s in (1, 2) for h in range(1, 21)]
    assert all(r["bad"] == 0 and r["n"] == 300 and r["log_p"] < 0 for r in found)
    attempts = {(r["sim"], r["h"]): r["attempt"] for r in store.manifest().collect()}
    assert {k for k, a in attempts.items() if a} == {(1, 4), (1, 9)}
    for r in store.read().collect():
        if (r["sim"], r["h"]) not in ((1, 4), (1, 9)):
            assert r["beta_t"] == kept[r["sim"], r["h"]]
    whole = {(r["sim"], r["h"]): r["log_p"] for r in first if not r["bad"]}
    assert all(whole[r["sim"], r["h"]] == r["log_p"] for r in found if (r["sim"], r["h"]) in whole)


def test_a_vector_that_stays_invalid_stops_the_job(spark, study):
    cohort, chain, draws = study
    store = store_of(spark, chain, draws.withColumn("beta_t", F.transform("beta_t", lambda b: F.lit(1e6))))
    cells = cut(fp.scenario_cells(cohort, cohort.withColumns({"model": F.lit(2), "sim": F.lit(1)}), {2: chain}), "cells")
    with pytest.raises(ArithmeticError, match="stays invalid"):
        fp.valid_draws(store, cells, {2: chain}, attempts=0)


def test_planted_outlier_is_riskiest(spark):
    """Only one person is 69 years old, and of a stage that lives long."""
    usual = people(spark, 400).filter("id <> 0").withColumns(
        {"age": F.least("age", F.lit(60)), "stage": F.when(F.col("stage") == 1, 2).otherwise(F.col("stage"))}
    )
    usual = usual.unionByName(people(spark, 400).filter("stage = 1 and id <> 0").withColumn("age", F.least("age", F.lit(52))).withColumn("id", F.col("id") + 1000))
    odd = people(spark, 1).withColumns({"age": F.lit(69), "stage": F.lit(1), "t": F.lit(4.6), "status": F.lit(0)})
    cohort = cut(usual.unionByName(odd), "cohort")
    chains = models.fit_chains(cohort, SETTINGS, [3])
    synthetic = cohort.withColumns({"model": F.lit(3), "sim": F.lit(1)})
    store = DrawStore(spark, scratch_path(spark, "draws"), fp.draws_schema(chains))
    store.put(fp.coefficient_draws(fp.draw_requests(spark, "m", [3], 1, 50), chains))
    found = cut(fp.chain_evidence(cohort, synthetic, chains, store), "evidence")
    assert privacy.riskiest_person(found).first()["id"] == 0
    assert found.count() == cohort.count()


def test_rows_outside_the_grid_leave_no_likelihood(spark, study):
    cohort, chain, draws = study
    synthetic = cohort.withColumns({"model": F.lit(2), "sim": F.lit(1)})
    far = synthetic.limit(1).withColumn("age", F.lit(99))
    found = fp.chain_evidence(cohort, synthetic.unionByName(far), {2: chain}, store_of(spark, chain, draws))
    assert {c["loglik"] for r in found.select("cand").collect() for c in r["cand"]} == {None}
    empty = fp.chain_evidence(cohort.filter("id < 0"), synthetic, {2: chain}, store_of(spark, chain, draws))
    assert empty.collect() == []


def test_fits_leave_held_out_rows_alone(spark):
    """Men are held out: nobody drawn is one, and there are as many persons as in the cohort."""
    cohort = people(spark, 200)
    drawn = models.synthesize_fitted(cohort, SETTINGS, [1], 2, "m", members=F.col("sex") == 0)
    rows = drawn.groupBy("sim").agg(F.count("*").alias("n"), F.max("sex").alias("sex")).collect()
    assert [(r["n"], r["sex"]) for r in rows] == [(200, 0), (200, 0)]


def test_slots_are_not_sent_whole_to_every_task(spark, monkeypatch):
    """The coefficients go to the persons: no side that is broadcast holds the persons' runs."""
    monkeypatch.setattr(models, "finish_draws", lambda drawn, settings: drawn)
    drawn = models.synthesize_fitted(people(spark, 200), SETTINGS, [1], 3, "m")
    plan = drawn._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and drawn.count() == 600
    draws = [r["sim"] for r in drawn.select("sim").distinct().collect()]
    assert sorted(draws) == [1, 2, 3]
    assert "Generate" not in plan.toString()  # slots are not repeated before they meet the runs
    assert "LogicalRDD" not in plan.toString()  # written coefficients, whose size is known
