"""Draws and evidence of many rows at once against one row at a time, in numpy."""

from datetime import date
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from syncohort.functions import draws
from syncohort.operators import evidence, models, synthesis
from syncohort.settings import StudySettings


def test_classes_and_hazards_of_each_row():
    """Every row has its own coefficients: classes by cumulative share, hazards by interval."""
    rng = np.random.default_rng(2)
    level = models.ModelLevel("main", df=3, tvc=("sex",), df_tvc=1)
    scale = models.TimeScale((0.0, 1.0, 2.5), ((0.0, 0.4, 1.0),))
    chain = SimpleNamespace(
        level=level, scale=scale, terms={"stage": [("sex",)]},
        fits={"age": models.Fit(None, None, limits=(40, 90), knots=[-2.0, 0.0, 2.0]),
              "stage": models.Fit(None, None, [1, 2, 3, 999])},
    )
    drawer = models._Drawer(chain, {})
    n = 60
    x, u, sex = rng.normal(size=(n, 2)), rng.random(n), rng.integers(0, 2, n).astype(float)
    beta, hazard = rng.normal(size=(n, 6)), rng.normal(size=(n, 5))
    got = drawer.category("stage", beta, x, u)
    rates = drawer.hazards(hazard, {"sex": [sex]})
    for k in range(n):
        weights = np.exp([0.0, *(beta[k].reshape(3, 2) @ x[k])])
        assert got[k] == [1, 2, 3, 999][np.searchsorted(np.cumsum(weights / weights.sum()), u[k])]
        b = hazard[k]
        eta = b[4] + b[2] * sex[k] + np.array([0.0, b[0], b[1]]) + b[3] * sex[k] * np.array([0.0, 0.4, 1.0])
        assert rates[k] == pytest.approx(np.exp(eta))
    far = drawer.age(np.array([[1.0, 0.0, 500.0], [1.0, 0.0, -500.0]]), np.zeros(2))
    assert far.tolist() == [90, 40]


def test_ratios_of_each_person():
    """Hazards summed interval by interval; one beyond a person's time does not matter."""
    rng = np.random.default_rng(3)
    cuts = (0.0, 1.0, 2.0)
    scenarios = np.array([(50, 0, 1996, s) for s in (1, 2)])
    rates, logs = rng.random((2, 4, 3)), np.log(rng.random((2, 4)))
    rates[0, 1, 2] = np.inf
    persons = pd.DataFrame(
        {"id": range(5), "age": 50, "sex": 0, "daar_grp": 1996, "stage": [1, 2, 1, 2, 1],
         "status": [1, 0, 1, 1, 0], "t": [0.0, 0.5, 1.0, 1.7, 2.4]}
    )
    tables = evidence.Tables(scenarios, logs, rates, cuts)
    (_, _, got), = evidence.log_ratios(persons, tables)
    for k, p in enumerate(persons.itertuples()):
        spent = np.clip(p.t - np.array(cuts), 0, [1.0, 1.0, np.inf])
        own = max(int((p.t > np.array(cuts)).sum()) - 1, 0)
        passed = np.where(spent > 0, np.where(spent > 0, rates, 0) * spent, 0.0).sum(2)
        with np.errstate(all="ignore"):
            value = logs - passed + p.status * np.log(rates[..., own])
            value = np.where(np.isfinite(value), value, np.nan)
            want = value - value[p.stage - 1]
        assert got[k] == pytest.approx(want, nan_ok=True)


def test_hashes_and_draws_equal_the_columns(spark):
    """What numpy draws from (site, run, row, purpose) is what the column expressions draw."""
    ids = np.array([1, 2, 77, 10**12, -5])
    rows = spark.createDataFrame([("north", 3, 41, int(i)) for i in ids], "site string, model int, sim int, id long")
    keys = ["site", "model", "sim", "id"]
    want = rows.select(
        "id", F.xxhash64("site").alias("start"), draws.hash_normal(*keys, 0).alias("z"),
        draws.hash_uniform(*keys, 99).alias("u"),
    ).toPandas().set_index("id").loc[ids]
    start = want["start"].to_numpy()[:1].view(np.uint64)
    bits = draws.hashed_long(ids, draws.hashed_int(41, draws.hashed_int(3, start)))
    assert draws.uniform_of(draws.hashed_int(99, bits)).tolist() == want["u"].tolist()
    assert draws.normal_of(draws.hashed_int(0, bits)) == pytest.approx(want["z"].to_numpy(), abs=1e-13)


def test_days_equal_the_columns(spark):
    """Survival times, also without hazard in an interval, and diagnosis dates."""
    rng = np.random.default_rng(4)
    cuts, u = (0.0, 0.5, 2.0), rng.random(300)
    for rates in (rng.random((6, 3)), np.array([[0.3, 0.0, 0.2], [0.0] * 3, [np.inf, 1.0, 1.0]] * 2)):
        cell = rng.integers(0, 6, 300)
        frame = spark.createDataFrame(
            [(k, rates[c].tolist(), float(v)) for k, (c, v) in enumerate(zip(cell, u))],
            "k int, rates array<double>, u double",
        )
        want = frame.select("k", synthesis.draw_survival_time("rates", F.col("u"), cuts, 9.0).alias("d"))
        got = synthesis.survival_days(rates, cell, u, cuts, 9.0)
        assert [r.d for r in want.orderBy("k").collect()] == got.tolist()
    groups = [2016, 2018, 2020]
    for cutoff in ("2021-12-31", "2020-02-29"):
        settings = StudySettings(cutoff=cutoff)
        dates = synthesis.diagnosis_dates(groups, settings)
        frame = spark.createDataFrame(
            [(g, float(v)) for g in groups for v in u[:100]], "g int, u double"
        ).withColumn("d", synthesis.draw_diagnosis_date("g", F.col("u"), settings))
        for g, v, d in frame.collect():
            days = dates[groups.index(g)]
            assert (d - date(1970, 1, 1)).days == days[int(np.floor(v * len(days)))]


def test_shared_combinations_draw_the_same_rows(spark, monkeypatch):
    """Shares and hazards per combination of values give what each row's design gives."""
    level = models.ModelLevel("inter", ("age", "sex"), (), 3, ("sex",), 1)
    rng = np.random.default_rng(5)
    scale = models.TimeScale((0.0, 1.0, 2.5), ((0.0, 0.4, 1.0),))
    terms = {"sex": [("age",)], "daar_grp": [("age",), ("sex",), ("age", "sex")]}
    classes = {"sex": [0, 1], "daar_grp": [1996, 1998]}
    fits = {v: models.Fit(None, None, c) for v, c in classes.items()}
    fits["age"] = models.Fit(None, None, limits=(60, 63), knots=[-2.0, 0.0, 2.0])
    chain = SimpleNamespace(level=level, scale=scale, terms=terms, fits=fits)
    ages = np.arange(59, 65)
    coded = {"age": (ages, (ages[:, None] - 60) / 10), "sex": (np.array([0, 1]), np.array([[0.0], [1.0]])),
             "daar_grp": (np.array([1996, 1998]), np.array([[0.0], [1.0]]))}
    drawer = models._Drawer(chain, coded)
    order = ["age", "sex", "daar_grp"]
    width = {"age": 3, "sex": 2, "daar_grp": 4, "t": 2 + 4 + 1 + 1}
    betas = {v: rng.normal(size=n) for v, n in width.items()} | {"age": np.array([1.5, 0.3, 61.5])}
    bits = draws.hashed_long(np.arange(500), np.array([7], np.uint64))
    settings = StudySettings(start_year=1995, end_year=1999, cutoff="1999-12-31")
    dates = synthesis.diagnosis_dates(classes["daar_grp"], settings)
    once, each = (models._Run(drawer, order, betas, rows) for rows in (500, 1))
    assert once.rates is not None and each.rates is None
    for a, b in zip(once(bits, dates, settings), each(bits, dates, settings), strict=True):
        assert a.to_pylist() == b.to_pylist()
