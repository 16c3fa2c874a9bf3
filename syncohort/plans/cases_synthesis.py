"""Synthesis queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncohort.functions.columns import dot
from syncohort.functions.draws import portable_uniform, portable_uniform_sql
from syncohort.functions.special import QUANTILE_CENTRE, QUANTILE_TAILS
from syncohort.functions.splines import spline_basis
from syncohort.lineage import cut, scratch_path
from syncohort.operators import (
    attack,
    boosting,
    fitted_privacy,
    models,
    privacy,
    report,
    survival,
    utility,
)
from syncohort.operators import frequencies as freq
from syncohort.operators import synthesis as synth
from syncohort.operators.cohort import spread_over_runs, with_run_minimum_delta
from syncohort.operators.draw_store import DrawStore
from syncohort.operators.stats import with_group_stats
from syncohort.plans.cases import case
from syncohort.plans.derived import STUDY, attack_table, cohort
from syncohort.settings import RUN

SIMS = 3
SUBMODELS = (("age", ()), ("sex", ()), ("stage", ("sex",)), ("daar_grp", ("stage",)))
RATE_BY = ("sex", "stage")
#: Purposes of the uniforms, in the order the chain uses them.
PURPOSE = {"age": 1, "sex": 2, "stage": 3, "daar_grp": 4, "t": 5, "diag_date": 6}


def _site(spark, folder):
    return cohort(spark, folder).withColumn("site", F.lit("main"))


def _stream(purpose: int):
    return (F.col("model") * 10 + F.col("sim")) * 100 + purpose


def _uniform(purpose: int):
    return portable_uniform("id", _stream(purpose))


def _u(row: str, purpose: int) -> str:
    return portable_uniform_sql(row, f"(model * 10 + sim) * 100 + {purpose}")


SLOTS_SQL = f"""
slots AS (SELECT model, sim, row_number() OVER (PARTITION BY model, sim ORDER BY id) AS slot
  FROM cohort, (SELECT unnest([6]) AS model), (SELECT unnest(range(1, {SIMS + 1})) AS sim))"""


def _bootstrap_sql(where: str) -> str:
    return (
        SLOTS_SQL
        + f""",
pool AS (SELECT *, row_number() OVER (ORDER BY id) AS pick FROM cohort {where}),
drawn AS (SELECT 'main' AS site, model, sim, slot, pool.* FROM slots JOIN pool ON pick =
    CAST(floor({_u("slot", 11)} * (SELECT count(*) FROM pool)) AS BIGINT) + 1)"""
    )


def _slot_uniform(model, sim, slot):
    return portable_uniform(slot, (model * 10 + sim) * 100 + 11)


@case(
    "bootstrap",
    "site:s model:i sim:i slot:i id:i age:i stage:i t:f9",
    "SELECT * FROM drawn",
    _bootstrap_sql(""),
)
def _(spark, folder):
    """As many draws with replacement as persons, three runs."""
    return synth.bootstrap(_site(spark, folder), sims=SIMS, uniform=_slot_uniform)


@case(
    "bootstrap_members",
    "site:s model:i sim:i slot:i id:i age:i stage:i t:f9",
    "SELECT * FROM drawn",
    _bootstrap_sql("WHERE id % 5 <> 0"),
)
def _(spark, folder):
    """Only members are drawn, as often as there are persons in all."""
    return synth.bootstrap(
        _site(spark, folder), sims=SIMS, uniform=_slot_uniform, members=F.col("id") % 5 != 0
    )


@case(
    "holdout_split",
    "sim:i id:i holdout:i",
    f"SELECT sim, id, CASE WHEN {portable_uniform_sql('id', 'sim')} < 0.2::DOUBLE THEN 1 ELSE 0 "
    f"END AS holdout FROM cohort, (SELECT unnest(range(1, {SIMS + 1})) AS sim)",
)
def _(spark, folder):
    """A fifth of the rows held out, anew for each run."""
    runs = cohort(spark, folder).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(SIMS))))
    return synth.holdout_split(runs, 0.2, portable_uniform("id", F.col("sim")))


_KNOTS = (40.0, 52.0, 64.0, 76.0, 89.0)


def _spline_sql(i: int) -> str:
    k, lo, hi = _KNOTS[i], _KNOTS[0], _KNOTS[-1]
    share = (hi - k) / (hi - lo)
    cube = "power(greatest(age - {0}, 0), 3)"
    return (
        f"{cube.format(k)} - {share!r}::DOUBLE * {cube.format(lo)} - "
        f"(1 - {share!r}::DOUBLE) * {cube.format(hi)} AS s{i}"
    )


@case(
    "spline_basis",
    "id:i s0:f6 s1:f6 s2:f6 s3:f6",
    "SELECT id, age AS s0, " + ", ".join(_spline_sql(i) for i in (1, 2, 3)) + " FROM cohort",
)
def _(spark, folder):
    columns = spline_basis("age", _KNOTS)
    return cohort(spark, folder).select(
        "id", *[c.alias(f"s{i}") for i, c in enumerate(columns)]
    )


@case(
    "saturated_categorical",
    "sex:i stage:i p:f9",
    "SELECT sex, stage, count(*) / CAST(sum(count(*)) OVER (PARTITION BY sex) AS DOUBLE) AS p "
    "FROM cohort GROUP BY sex, stage",
)
def _(spark, folder):
    counts = freq.class_counts(_site(spark, folder), ["site"], "stage", ["sex"])
    return freq.class_probabilities(counts, ["site"], "stage", ["sex"])


SPENT_SQL = """
spent AS (SELECT sex, stage, j, sum(CASE WHEN
    (CASE WHEN t > 3 THEN 4 WHEN t > 2 THEN 3 WHEN t > 1 THEN 2 WHEN t > 0.5 THEN 1 ELSE 0 END) = j
    THEN status ELSE 0 END) AS d, sum(greatest((CASE WHEN j = 4 THEN t ELSE
    least(t, [0.5, 1.0, 2.0, 3.0][j + 1]) END) - [0.0, 0.5, 1.0, 2.0, 3.0][j + 1], 0)) AS e
  FROM cohort, (SELECT unnest(range(0, 5)) AS j) GROUP BY ALL)"""


@case(
    "saturated_hazard",
    "sex:i stage:i interval:i d:i exposure:f9",
    "SELECT sex, stage, j AS interval, d, e AS exposure FROM spent",
    SPENT_SQL,
)
def _(spark, folder):
    """Events and person-years per pattern and interval."""
    return freq.event_exposure(_site(spark, folder), ["site", *RATE_BY])


def _cdf_sql(variable: str, parents: tuple[str, ...]) -> str:
    p = "".join(f"{c}, " for c in parents)
    by = f"PARTITION BY {', '.join(parents)} " if parents else ""
    return f"""
c_{variable} AS (SELECT {p}{variable} AS v_{variable}, sum(n / all_n) OVER
    ({by}ORDER BY {variable}) AS upper FROM (SELECT {p}{variable}, CAST(count(*) AS DOUBLE) AS n,
    sum(count(*)) OVER ({by}) AS all_n FROM cohort GROUP BY {p}{variable}))"""


def _draw_sql(variable: str, parents: tuple[str, ...], source: str) -> str:
    on = " AND ".join(f"r.{c} = c.{c}" for c in parents) or "true"
    return f"""
r_{variable} AS (SELECT r.*, v AS {variable} FROM {source} r JOIN (
    SELECT r.model, r.sim, r.id, coalesce(min(CASE WHEN upper > {_u("r.id", PURPOSE[variable])}
        THEN v_{variable} END), max(v_{variable})) AS v
    FROM {source} r JOIN c_{variable} c ON {on} GROUP BY r.model, r.sim, r.id) d
  ON d.model = r.model AND d.sim = r.sim AND d.id = r.id)"""


CHAIN_SQL = (
    f"""
r0 AS (SELECT model, sim, row_number() OVER (PARTITION BY model, sim ORDER BY id) AS id
  FROM cohort, (SELECT unnest([0]) AS model), (SELECT unnest(range(1, {SIMS + 1})) AS sim)),"""
    + ",".join(_cdf_sql(v, p) for v, p in SUBMODELS)
    + ","
    + ",".join(
        _draw_sql(v, p, source)
        for (v, p), source in zip(SUBMODELS, ["r0", "r_age", "r_sex", "r_stage"])
    )
    + ","
    + SPENT_SQL
    + f""",
hazards AS (SELECT sex, stage, j, coalesce(d / nullif(e, 0), 0) AS rate,
    [0.0, 0.5, 1.0, 2.0, 3.0][j + 1]::DOUBLE AS t0,
    [0.5, 1.0, 2.0, 3.0, 21.0][j + 1]::DOUBLE AS t1 FROM spent),
cumulated AS (SELECT *, rate * (t1 - t0) AS gain, coalesce(sum(rate * (t1 - t0)) OVER
    (PARTITION BY sex, stage ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM hazards),
r_t AS (SELECT r.*, days FROM r_daar_grp r JOIN (SELECT r.model, r.sim, r.id,
    greatest(ceil(least(coalesce(min(CASE WHEN target >= before AND target < before + gain
      THEN t0 + (target - before) / rate END), 21), 21) * 365.25::DOUBLE), 1) AS days
    FROM (SELECT *, -ln(greatest({_u("id", PURPOSE["t"])}, 1e-300)) AS target FROM r_daar_grp) r
    JOIN cumulated c ON c.sex = r.sex AND c.stage = r.stage GROUP BY r.model, r.sim, r.id) d
  ON d.model = r.model AND d.sim = r.sim AND d.id = r.id),
r_index AS (SELECT *, CAST(floor({_u("id", PURPOSE["diag_date"])} * (least(2, greatest(1999
    - daar_grp, 0)) * 365 + CASE WHEN least(2, greatest(1999 - daar_grp, 0)) < 2 THEN 364 ELSE 0
    END)) AS INTEGER) AS k FROM r_t),
r_date AS (SELECT *, make_date(CAST(daar_grp + k // 365 AS INTEGER),
    month(DATE '2001-01-01' + k % 365), day(DATE '2001-01-01' + k % 365)) AS diag_date
  FROM r_index),
r_exit AS (SELECT *, diag_date + CAST(days AS INTEGER) AS raw_exit FROM r_date),
synthetic AS (SELECT 'main' AS site, model, sim, id, age, sex, stage, daar_grp, days, diag_date,
    CASE WHEN raw_exit > DATE '1999-12-31' THEN 0 ELSE 1 END AS status,
    least(raw_exit, DATE '1999-12-31') AS exit,
    date_diff('day', diag_date, least(raw_exit, DATE '1999-12-31')) / 365.25::DOUBLE AS t
  FROM r_exit)"""
)


def _slots(people):
    slots = synth.row_numbers(people.select("site", F.col("id").alias("_id")), ["site"], ["_id"], "id")
    return synth.with_runs(synth.spread(slots.drop("_id")), [0], SIMS)


@case(
    "draw_categorical",
    "model:i sim:i id:i age:i sex:i stage:i daar_grp:i",
    "SELECT * FROM r_daar_grp",
    CHAIN_SQL,
)
def _(spark, folder):
    """The covariate chain."""
    people = cut(_site(spark, folder), "cohort")
    tables, _ = synth.saturated_model(people, SUBMODELS, RATE_BY)
    rows = _slots(people)
    for variable, (parents, cdfs) in tables.items():
        rows = synth.draw_categorical(
            rows, variable, parents, cdfs, _uniform(PURPOSE[variable]), ["site"]
        )
    return rows


@case(
    "draw_survival_time",
    "model:i sim:i id:i days:i",
    f"SELECT model, sim, id, greatest(ceil(least(coalesce(min(CASE WHEN target >= before AND "
    "target < before + gain THEN t0 + (target - before) / rate END), 21), 21) * 365.25::DOUBLE), "
    f"1) AS days FROM (SELECT c.*, model, sim, -ln(greatest({_u('id', PURPOSE['t'])}, 1e-300)) "
    f"AS target FROM cohort c, (SELECT unnest([0]) AS model), (SELECT unnest(range(1, "
    f"{SIMS + 1})) AS sim)) r JOIN cumulated c ON c.sex = r.sex AND c.stage = r.stage "
    "GROUP BY model, sim, id",
    CHAIN_SQL,
)
def _(spark, folder):
    """Survival times for the real covariates."""
    people = cut(_site(spark, folder), "cohort")
    _, rates = synth.saturated_model(people, (), RATE_BY)
    rows = synth.with_runs(people, [0], SIMS).join(rates, ["site", *RATE_BY])
    return rows.withColumn(
        "days", synth.draw_survival_time("rates", _uniform(PURPOSE["t"]))
    )


@case(
    "draw_diagnosis_date",
    "model:i sim:i id:i daar_grp:i diag_date:s",
    f"SELECT *, make_date(CAST(daar_grp + k // 365 AS INTEGER), month(DATE '2001-01-01' + "
    "k % 365), day(DATE '2001-01-01' + k % 365)) AS diag_date FROM (SELECT * EXCLUDE (diag_date), "
    f"CAST(floor({_u('id', PURPOSE['diag_date'])} * (least(2, greatest(1999 - daar_grp, 0)) * 365 "
    "+ CASE WHEN least(2, greatest(1999 - daar_grp, 0)) < 2 THEN 364 ELSE 0 END)) AS INTEGER) AS "
    f"k FROM cohort, (SELECT unnest([0]) AS model), (SELECT unnest(range(1, {SIMS + 1})) AS sim))",
)
def _(spark, folder):
    """Dates for the real year groups, all before the cutoff."""
    rows = synth.with_runs(_site(spark, folder), [0], SIMS)
    return rows.withColumn(
        "diag_date",
        synth.draw_diagnosis_date("daar_grp", _uniform(PURPOSE["diag_date"]), STUDY),
    )


@case(
    "synthesize_saturated",
    "site:s model:i sim:i id:i age:i sex:i stage:i daar_grp:i diag_date:s exit:s status:i t:f9",
    "SELECT * FROM synthetic",
    CHAIN_SQL,
)
def _(spark, folder):
    """Complete synthetic cohorts from frequency tables."""
    people = cut(_site(spark, folder), "cohort")
    tables, rates = synth.saturated_model(people, SUBMODELS, RATE_BY)
    return synth.synthesize(_slots(people), tables, rates, RATE_BY, STUDY, _uniform)


def _ratio_sql(top: tuple, bottom: tuple, x: str) -> str:
    """Quotient of two polynomials in x, coefficients from the constant up."""
    def horner(values):
        out = f"{values[-1]!r}::DOUBLE"
        for v in reversed(values[:-1]):
            out = f"({out} * {x} + {v!r}::DOUBLE)"
        return out

    return f"{horner(top)} / {horner((1.0, *bottom))}"


@case(
    "unique_rank_normal_score",
    "id:i age:i score:f9",
    "SELECT id, age, CASE WHEN abs(q) <= 0.425 THEN q * "
    + _ratio_sql(*QUANTILE_CENTRE, "(0.180625::DOUBLE - q * q)")
    + " ELSE sign(q) * "
    + _ratio_sql(*QUANTILE_TAILS, "(sqrt(-ln(0.5::DOUBLE - abs(q))) - 1.6::DOUBLE)")
    + " END AS score FROM (SELECT id, age, (row_number() OVER (ORDER BY age, id) - 0.5::DOUBLE) "
    "/ count(*) OVER () - 0.5::DOUBLE AS q FROM cohort)",
)
def _(spark, folder):
    return models.normal_scores(_site(spark, folder), "age")


def _coefficients(spark, fits):
    """One row per submodel and coefficient, with its standard error and one draw."""
    rows = []
    for name, fit in fits.items():
        draws, _ = models.draw_coefficients(fit, 50, seed=7)
        errors = fit.covariance.diagonal() ** 0.5
        for i, (b, e) in enumerate(zip(fit.beta.ravel(), errors)):
            rows.append((name, i, float(b), float(e), float(draws[:, i].mean())))
    schema = T.StructType(
        [
            T.StructField("submodel", T.StringType()),
            T.StructField("term", T.IntegerType()),
            *[T.StructField(n, T.DoubleType()) for n in ("beta", "se", "mean_draw")],
        ]
    )
    return spark.createDataFrame(rows, schema)


_FIT_COLUMNS = "submodel:s term:i beta:f4 se:f4 mean_draw:f4"


@case("fit_categorical", _FIT_COLUMNS)
def _(spark, folder):
    """Multinomial logit of stage on age splines and sex, with coefficient draws."""
    people = cut(_site(spark, folder), "cohort")
    level = models.MODEL_LEVELS[2]
    codings = models.cohort_codings(people, level, STUDY)
    terms = models.model_terms(level, ["age", "sex"])
    return _coefficients(spark, {"stage": models.fit_categorical(people, "stage", terms, codings)})


@case(
    "saturated_shares",
    "sex:i stage:i daar_grp:i p:f6",
    "SELECT sex, stage, g.daar_grp, count(*) FILTER (cohort.daar_grp = g.daar_grp) / "
    "CAST(count(*) AS DOUBLE) AS p FROM cohort, (SELECT DISTINCT daar_grp FROM cohort) g "
    "GROUP BY sex, stage, g.daar_grp",
)
def _(spark, folder):
    """A logit with all interactions predicts the share of every class in every pattern."""
    people = cut(_site(spark, folder), "cohort")
    codings = {
        "sex": models.dummies("sex", [0, 1]), "stage": models.dummies("stage", STUDY.stages),
    }
    terms = [("sex",), ("stage",), ("sex", "stage")]
    fit = models.fit_categorical(people, "daar_grp", terms, codings, ridge=0.0)
    design = F.array(*models.term_columns(terms, codings), F.lit(1.0))
    betas = spark.createDataFrame(
        [(c, [0.0] * fit.beta.shape[1]) for c in fit.classes[:1]]
        + [(c, [float(x) for x in b]) for c, b in zip(fit.classes[1:], fit.beta)],
        "daar_grp int, b array<double>",
    )
    patterns = people.select("sex", "stage").distinct().select("sex", "stage", design.alias("x"))
    # Patterns and classes, both bounded by the covariates.
    scored = (
        patterns.withColumn("daar_grp", F.explode(F.array(*[F.lit(c) for c in fit.classes])))
        .join(betas, "daar_grp")
        .withColumn("e", F.exp(dot(F.col("b"), F.col("x"))))
    )
    total = with_group_stats(scored, ["sex", "stage"], {"total": F.sum("e")})
    return total.select("sex", "stage", "daar_grp", (F.col("e") / F.col("total")).alias("p"))


_EVENT_CUTS = ", ".join(
    f"CASE WHEN n * {p} % 100 = 0 THEN (x[n * {p} // 100] + x[n * {p} // 100 + 1]) / 2 "
    f"ELSE x[n * {p} // 100 + 1] END AS c{i}"
    for i, p in enumerate((20, 40, 60, 80), start=1)
)


@case(
    "saturated_hazards",
    "sex:i interval:i since:f9 rate:f6",
    "SELECT sex, j AS interval, any_value(lo) AS since, sum(CASE WHEN t > lo AND t <= hi THEN status "
    "ELSE 0 END) / sum(greatest(least(t, hi) - lo, 0)) AS rate FROM cohort, spans GROUP BY sex, j",
    f"""
events AS (SELECT list(t ORDER BY t) AS x, count(*) AS n FROM cohort WHERE status = 1),
borders AS (SELECT {_EVENT_CUTS} FROM events),
spans AS (SELECT j, [0.0::DOUBLE, c1, c2, c3, c4][j + 1] AS lo,
    [c1, c2, c3, c4, 1e9::DOUBLE][j + 1] AS hi
  FROM borders, (SELECT unnest(range(0, 5)) AS j))
""",
)
def _(spark, folder):
    """A hazard with an effect of sex in every interval is events over person-years, in
    intervals that hold a fifth of the events each."""
    people = cut(_site(spark, folder), "cohort")
    level = models.ModelLevel("main", df=5, tvc=("sex",), df_tvc=4)
    codings = {"sex": models.dummies("sex", [0, 1])}
    scale = models.time_scale(people, level)
    fit = models.fit_survival(people, level, codings, scale, ridge=0.0)
    terms, varying = models.survival_parts(level, codings)
    rates = models.interval_hazards(
        F.array(*[F.lit(float(b)) for b in fit.beta]), F.array(*terms), F.array(*varying), (1, 1), scale
    )
    since = F.array(*[F.lit(float(c)) for c in scale.cuts])
    return people.select("sex").distinct().select("sex", F.posexplode(rates).alias("interval", "rate")).withColumn(
        "since", F.get(since, F.col("interval"))
    )


@case("fit_continuous", _FIT_COLUMNS)
def _(spark, folder):
    """Age on splines of its normal score."""
    return _coefficients(spark, {"age": models.fit_continuous(_site(spark, folder))})


@case("fit_survival", _FIT_COLUMNS)
def _(spark, folder):
    """Piecewise exponential hazard with time-varying effects of age and stage."""
    people = cut(_site(spark, folder), "cohort")
    level = models.MODEL_LEVELS[2]
    codings = models.cohort_codings(people, level, STUDY)
    return _coefficients(spark, {"t": models.fit_survival(people, level, codings)})


@case(
    "synthesize_fitted",
    "site:s model:i sim:i id:i age:i sex:i stage:i daar:i diag_date:s exit:s status:i t:f6",
)
def _(spark, folder):
    """Synthetic cohorts of all runs of all six fitted models."""
    people = _site(spark, folder)
    return models.synthesize_fitted(people, STUDY, models=range(6), sims=STUDY.runs, site="main")


@case(
    "synthesize_holdout",
    "site:s model:i sim:i id:i age:i sex:i stage:i daar:i diag_date:s exit:s status:i t:f6",
)
def _(spark, folder):
    """The same from fits to the rows that are not held out, as many persons as the cohort."""
    people = _site(spark, folder)
    return models.synthesize_fitted(
        people, STUDY, models=range(6), sims=STUDY.runs, site="main", members=F.col("id") % 5 != 0
    )


@case("discriminator_auc", "site:s model:i sim:i auc:f6 pmse:f6 tested:i rounds:i")
def _(spark, folder):
    """Boosted trees against every run: AUC, mean squared propensity error, rounds of ten folds."""
    real, synthetic = attack_table(spark, folder)
    scores = cut(boosting.discriminator_scores(real, synthetic, STUDY), "scores")
    auc = attack.roc_auc(attack.roc_points(scores))
    sizes = scores.groupBy(*RUN).agg(F.count("*").alias("tested"), F.max("rounds").alias("rounds"))
    return auc.join(utility.pmse(scores, RUN, "score"), list(RUN)).join(sizes, list(RUN))


@case(
    "attribute_inference",
    "site:s model:i sim:i holdout:i class:i auc:f6 tpr_1:f6 tpr_2:f6 tpr_3:f6 accuracy:f6",
)
def _(spark, folder):
    """Stage guessed from identifiers, for members and held-out rows of every run."""
    predictions = models.per_run(
        *attack_table(spark, folder),
        lambda real, synthetic: models.attribute_predictions(synthetic, real, STUDY).select(
            "id", "holdout", "stage", "guess", "probs"
        ),
    )
    groups = [*RUN, "holdout"]
    long = attack.class_scores(predictions, [*groups, "id"], "stage", "probs", STUDY.stages)
    by = [*groups, "class"]
    points = cut(attack.roc_points(long, by, positive="hit"), "roc")
    return (
        attack.roc_auc(points, by)
        .join(attack.tpr_at_fpr(points, by), by)
        .join(attack.accuracy(predictions, groups, "stage", "guess"), groups)
    )


def _discriminated(real, synthetic):
    """Propensity error of boosted trees for every run."""
    scores = boosting.discriminator_scores(real, synthetic, STUDY)
    return utility.pmse(scores, RUN, "score")


@case("utility_table_discriminator", "site:s model:i str:s")
def _(spark, folder):
    """All utility metrics in one report row per model, with the trees' propensity error."""
    real, synthetic = attack_table(spark, folder)
    table = utility.utility_table(
        utility.jsd_total(utility.jsd_univariate(real, synthetic)),
        utility.pcd(real, synthetic),
        _discriminated(real, synthetic),
        survival.survival_difference(real, synthetic, 2.0),
    )
    return report.report_rows(table, ["jsd", "pcd", "pmse", "mean_diff"], ["site", "model"])


@case("trade_off_fitted", "site:s model:i sim:i pmse:f6 ll_diff:f6 mean_pmse:f6 mean_ll_diff:f6")
def _(spark, folder):
    """Trees' propensity error against privacy loss, for every run of the fitted models."""
    people = cut(_site(spark, folder), "cohort")
    chains = models.fit_chains(people, STUDY, range(6))
    synthetic = cut(
        models.synthesize_fitted(people, STUDY, range(6), SIMS, "main", chains=chains), "synthetic"
    )
    store = DrawStore(spark, scratch_path(spark, "draws"), fitted_privacy.draws_schema(chains))
    requests = fitted_privacy.draw_requests(spark, "main", range(6), SIMS, STUDY.draws)
    store.put(fitted_privacy.coefficient_draws(requests, chains))
    evidence = fitted_privacy.chain_evidence(people, synthetic, chains, store)
    loss = privacy.maximum_local_privacy_loss(evidence)
    both = with_run_minimum_delta(
        synthetic.withColumn("real", F.lit(0)).unionByName(
            spread_over_runs(people, synthetic).withColumn("real", F.lit(1)), allowMissingColumns=True
        ),
        ["exit"],
        RUN,
    )
    both = cut(both, "both")
    score = _discriminated(both.filter("real = 1").drop("real"), both.filter("real = 0").drop("real"))
    return utility.trade_off(score, loss, "pmse", "ll_diff")


@case(
    "attribute_inference_table_forest",
    "site:s model:i " + " ".join(f"{k}_{c}:s" for c in STUDY.stages for k in ("abs", "rel")),
)
def _(spark, folder):
    """Rates of the forest's guesses for members against those for held-out rows."""
    predictions = models.per_run(
        *attack_table(spark, folder),
        lambda real, synthetic: models.attribute_predictions(synthetic, real, STUDY).select(
            "id", "holdout", "stage", "guess", "probs"
        ),
    )
    by = [*RUN, "holdout", "class"]
    long = attack.class_scores(predictions, [*RUN, "holdout", "id"], "stage", "probs", STUDY.stages)
    rates = cut(
        attack.tpr_at_fpr(attack.roc_points(long, by, positive="hit"), by, STUDY.fpr_levels), "rates"
    )
    members, held_out = (rates.filter(F.col("holdout") == h).drop("holdout") for h in (0, 1))
    return report.attribute_inference_table(members, held_out, "tpr_3", classes=STUDY.stages)
