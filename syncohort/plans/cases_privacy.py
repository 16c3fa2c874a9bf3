"""Privacy loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncohort.lineage import cut, scratch_path
from syncohort.operators import fitted_privacy, models, privacy, utility
from syncohort.operators import frequencies as freq
from syncohort.operators.draw_store import DrawStore
from syncohort.plans.cases import case
from syncohort.plans.cases_utility import PMSE_SQL, cell_propensity
from syncohort.plans.derived import SIMS, STUDY, cohort, run_table
from syncohort.settings import RUN

DRAWS = STUDY.draws
K = "site, model, sim"
SUBMODELS = (("age", ()), ("sex", ()), ("stage", ("sex",)), ("daar_grp", ("stage",)))


def _weight(n, value, h):
    """Counts plus one and a small part that changes with the draw."""
    return n + F.lit(1.0) + F.lit(0.1) * F.pmod(h * 7 + value * 3, F.lit(5))


def _rate(d, exposure, interval, h):
    return (d + F.lit(0.5) + F.lit(0.05) * F.pmod(h * 3 + interval, F.lit(4))) / (
        exposure + F.lit(1.0)
    )


class Inputs:
    """Real and synthetic rows, p_cov on the scenario grid, hazards, and p(Z) per draw."""

    def __init__(self, spark, folder, draws=DRAWS):
        runs = cut(run_table(spark, folder), "runs")
        self.real = runs.filter("synth = 0").drop("synth")
        self.synthetic = runs.filter("synth = 1").drop("synth")
        tables = []
        for variable, parents in SUBMODELS:
            counts = freq.class_counts(self.real, RUN, variable, parents)
            table = freq.perturbed_draws(counts, RUN, variable, parents, draws, _weight)
            tables.append((variable, parents, table))
        spent = freq.event_exposure(self.real, [*RUN, "sex", "stage"])
        # Small tables by pattern and draw, used by several later steps.
        grid = privacy.scenario_grid(self.real)
        self.p_cov = cut(privacy.covariate_probability(grid, tables), "p_cov")
        self.rates = cut(freq.perturbed_rates(spent, draws, _rate), "rates")

    def loglik(self):
        return privacy.synthetic_loglik(self.synthetic, self.p_cov, self.rates)

    def evidence(self):
        return privacy.candidate_evidence(self.real, self.p_cov, self.rates, self.loglik())


def _draw_sql(variable: str, parents: tuple[str, ...]) -> str:
    p = "".join(f", {c}" for c in parents)
    return f"""
n_{variable} AS (SELECT {K}{p}, {variable}, count(*) AS n FROM rl GROUP BY ALL),
d_{variable} AS (SELECT *, w / sum(w) OVER (PARTITION BY {K}, h{p}) AS p_{variable} FROM (
  SELECT {K}{p}, {variable}, h, coalesce(n, 0) + 1.0::DOUBLE
      + 0.1::DOUBLE * ((h * 7 + {variable} * 3) % 5) AS w
  FROM (SELECT DISTINCT {K}{p} FROM rl) JOIN (SELECT DISTINCT {K}, {variable} FROM rl)
    USING ({K}) LEFT JOIN n_{variable} USING ({K}{p}, {variable}),
    (SELECT unnest(range(1, {DRAWS + 1})) AS h)))"""


OVERLAP = (
    "greatest((CASE WHEN j = 4 THEN t ELSE least(t, [0.5, 1.0, 2.0, 3.0][j + 1]) END)"
    " - [0.0, 0.5, 1.0, 2.0, 3.0][j + 1], 0)"
)
INTERVAL = (
    "(CASE WHEN t > 3 THEN 4 WHEN t > 2 THEN 3 WHEN t > 1 THEN 2 WHEN t > 0.5 THEN 1 ELSE 0 END)"
)

GRID_SQL = f"""
rl AS (SELECT * FROM runs WHERE synth = 0),
limits AS (SELECT {K}, min(age) AS a0, max(age) AS a1, min(sex) AS s0, max(sex) AS s1,
    min(daar_grp) AS g0, max(daar_grp) AS g1, count(DISTINCT daar_grp) AS ng,
    count(DISTINCT stage) AS ns FROM rl GROUP BY ALL),
grid AS (SELECT {K}, age, sex, CAST(round(g0 + (g1 - g0) / CAST(greatest(ng - 1, 1) AS DOUBLE) * g)
      AS BIGINT) AS daar_grp, CASE WHEN s = 4 THEN 999 ELSE s END AS stage
  FROM (SELECT *, unnest(range(1, ns + 1)) AS s FROM (SELECT *, unnest(range(0, ng)) AS g FROM
    (SELECT *, unnest(range(s0, s1 + 1)) AS sex FROM
     (SELECT *, unnest(range(a0, a1 + 1)) AS age FROM limits)))))"""

MODEL_SQL = (
    GRID_SQL
    + ","
    + ",".join(_draw_sql(v, p) for v, p in SUBMODELS)
    + f""",
p_cov AS (SELECT {K}, age, sex, daar_grp, stage, h,
    p_age * p_sex * p_stage * p_daar_grp AS p_cov
  FROM grid JOIN d_age USING ({K}, age) JOIN d_sex USING ({K}, h, sex)
    JOIN d_stage USING ({K}, h, sex, stage) JOIN d_daar_grp USING ({K}, h, stage, daar_grp)),
spent AS (SELECT {K}, synth, sex, stage, j, sum(CASE WHEN {INTERVAL} = j THEN status ELSE 0 END)
    AS d, sum({OVERLAP}) AS e FROM runs, (SELECT unnest(range(0, 5)) AS j) GROUP BY ALL),
rates AS (SELECT {K}, sex, stage, j, h,
    (d + 0.5::DOUBLE + 0.05::DOUBLE * ((h * 3 + j) % 4)) / (e + 1) AS rate
  FROM spent, (SELECT unnest(range(1, {DRAWS + 1})) AS h) WHERE synth = 0),
log_p AS (SELECT {K}, h, lc + lt AS log_p FROM
  (SELECT {K}, h, sum(n * ln(p_cov)) AS lc FROM (SELECT {K}, age, sex, daar_grp, stage,
      count(*) AS n FROM runs WHERE synth = 1 GROUP BY ALL)
    JOIN p_cov USING ({K}, age, sex, daar_grp, stage) GROUP BY ALL)
  JOIN (SELECT {K}, h, sum(d * ln(rate) - rate * e) AS lt FROM (SELECT * FROM spent
      WHERE synth = 1) JOIN rates USING ({K}, sex, stage, j) GROUP BY ALL) USING ({K}, h))"""
)

RATIO_SQL = (
    MODEL_SQL
    + f""",
cand AS (SELECT {K}, id, age, sex, daar_grp, status, t, rl.stage AS stage_id, c.stage AS stage
  FROM rl, (SELECT unnest([1, 2, 3, 999]) AS stage) c),
hazard AS (SELECT {K}, id, stage, h, sum(rate * {OVERLAP}) AS spent,
    max(CASE WHEN j = {INTERVAL} THEN rate END) AS rate
  FROM cand JOIN rates USING ({K}, sex, stage) GROUP BY ALL),
log_pi AS (SELECT {K}, id, stage, stage_id, h,
    ln(p_cov) + status * ln(rate) - spent AS l FROM cand JOIN p_cov USING
    ({K}, age, sex, daar_grp, stage) JOIN hazard USING ({K}, id, stage, h)),
log_ratio AS (SELECT *, l - max(CASE WHEN stage = stage_id THEN l END)
    OVER (PARTITION BY {K}, id, h) AS lr FROM log_pi)"""
)

POSTERIOR_SQL = (
    RATIO_SQL
    + f""",
sums AS (SELECT {K}, id, stage, any_value(stage_id) AS stage_id, sum(exp(lr)) AS r
  FROM log_ratio GROUP BY {K}, id, stage),
weighted AS (SELECT {K}, id, stage, lr - ln(r) + log_p AS x FROM log_ratio
  JOIN sums USING ({K}, id, stage) JOIN log_p USING ({K}, h)),
tops AS (SELECT *, max(x) OVER (PARTITION BY {K}, id, stage) AS top FROM weighted),
evidence AS (SELECT {K}, id, stage, any_value(top) + ln(sum(exp(x - top))) AS loglik
  FROM tops GROUP BY {K}, id, stage),
posted AS (SELECT {K}, id, stage, CASE WHEN stage = stage_id THEN 1 ELSE 0 END AS correct,
    loglik, exp(loglik - max(loglik) OVER w) AS e, r / sum(r) OVER w AS prior
  FROM evidence JOIN sums USING ({K}, id, stage) WINDOW w AS (PARTITION BY {K}, id)),
shares AS (SELECT *, e / sum(e) OVER w AS probability FROM posted
  WINDOW w AS (PARTITION BY {K}, id)),
posterior AS (SELECT *, probability * prior / sum(probability * prior) OVER w AS prob_prior
  FROM shares WINDOW w AS (PARTITION BY {K}, id)),
losses AS (SELECT {K}, id, max(loglik) - min(loglik) AS loss,
    max(CASE WHEN correct = 1 THEN probability END) AS p_true, max(probability) AS p_max
  FROM posterior GROUP BY {K}, id),
mlpl AS (SELECT {K}, max(p_true) AS bayesian, max(loss) AS ll_diff, max(p_max) AS bayesian_max
  FROM losses GROUP BY {K})"""
)


@case(
    "scenario_grid",
    "site:s model:i sim:i age:i sex:i daar_grp:i stage:i",
    "SELECT * FROM grid",
    GRID_SQL,
)
def _(spark, folder):
    return privacy.scenario_grid(run_table(spark, folder).filter("synth = 0"))


@case(
    "candidate_table",
    "id:i k_id:i stage_id:i stage:i correct:i",
    "SELECT id, k_id, stage AS stage_id, [1, 2, 3, 999][k_id] AS stage, "
    "CASE WHEN stage = [1, 2, 3, 999][k_id] THEN 1 ELSE 0 END AS correct "
    "FROM cohort, (SELECT unnest([1, 2, 3, 4]) AS k_id)",
)
def _(spark, folder):
    return privacy.candidate_table(cohort(spark, folder))


@case(
    "covariate_probability",
    "site:s model:i sim:i age:i sex:i daar_grp:i stage:i h:i p_cov:f12",
    "SELECT * FROM p_cov",
    MODEL_SQL,
)
def _(spark, folder):
    return Inputs(spark, folder).p_cov


@case(
    "softmax_probability",
    "age:i sex:i h:i class:i p:f9",
    "SELECT age, sex, h, class, exp(eta) / sum(exp(eta)) OVER (PARTITION BY age, sex, h) AS p "
    "FROM (SELECT g.age, g.sex, h, class, b0 + 0.01::DOUBLE * h * g.sex + "
    "0.002::DOUBLE * (class % 4) * g.age AS eta FROM (SELECT DISTINCT age, sex FROM cohort) g, "
    "(SELECT stage AS class, ln(count(*) / CAST((SELECT count(*) FROM cohort WHERE stage = 1) "
    f"AS DOUBLE)) AS b0 FROM cohort GROUP BY stage), (SELECT unnest(range(1, {DRAWS + 1})) AS h))",
)
def _(spark, folder):
    """Multinomial logit probabilities from log ratios of stage counts."""
    people = cohort(spark, folder).withColumn("site", F.lit("main"))
    counts = people.groupBy("site", F.col("stage").alias("class")).agg(F.count("*").alias("n"))
    base = counts.filter("class = 1").select("site", F.col("n").alias("n1"))
    betas = counts.join(base, "site").withColumn("h", freq.draw_numbers(DRAWS)).select(
        "site", "h", "class",
        F.array(
            F.ln(F.col("n") / F.col("n1")),
            F.lit(0.01) * F.col("h"),
            F.lit(0.002) * (F.col("class") % 4),
        ).alias("beta"),
    )
    grid = people.select("site", "age", "sex").distinct()
    return privacy.softmax_probability(grid, betas, [F.lit(1.0), F.col("sex"), F.col("age")])


@case(
    "continuous_probability",
    "h:i age:i p:f9",
    "SELECT h, age, sum((CASE WHEN abs(c) < 1.8 THEN exp(-0.5 * power((age - mu) / rmse, 2)) "
    "ELSE (" + " + ".join(
        f"exp(-0.5 * power((age + {-0.45 + 0.1 * j:.2f} - mu) / rmse, 2))" for j in range(10)
    ) + ") / 10 END) / (rmse * sqrt(2 * pi())) * exp(-0.5 * x * x) / sqrt(2 * pi()) * 0.01) AS p "
    "FROM targets JOIN grid USING (h) WHERE abs(x - c) <= 2.0::DOUBLE GROUP BY h, age",
    f"""
fit AS (SELECT h, avg(age) AS b2, stddev_pop(age) * (1 + h / 100.0::DOUBLE) AS b0,
    0.1::DOUBLE * h AS b1, 2.0::DOUBLE + h / 10.0::DOUBLE AS rmse
  FROM cohort, (SELECT unnest(range(1, {DRAWS + 1})) AS h) GROUP BY h),
grid AS (SELECT h, rmse, x, b0 * x + b1 * (power(greatest(x, 0), 3)
    - 0.5 * power(greatest(x + 2, 0), 3) - 0.5 * power(greatest(x - 2, 0), 3)) + b2 AS mu
  FROM (SELECT *, -4.5::DOUBLE + (i + 0.5::DOUBLE) * 0.01::DOUBLE AS x
        FROM fit, (SELECT unnest(range(0, 900)) AS i))),
predicted AS (SELECT h, CAST(round(mu) AS BIGINT) AS pred, avg(x) AS c FROM grid GROUP BY ALL),
targets AS (SELECT h, a.age, c FROM (SELECT h, min(pred) AS lo, max(pred) AS hi FROM predicted
    GROUP BY h) s JOIN predicted p USING (h), (SELECT unnest(range(7, 90)) AS age) a
    WHERE p.pred = greatest(least(a.age, s.hi), s.lo))
""",
)
def _(spark, folder):
    """Age probabilities from a spline through the cohort's mean and spread."""
    people = cohort(spark, folder).withColumn("site", F.lit("main"))
    stats = people.groupBy("site").agg(F.avg("age").alias("m"), F.stddev_pop("age").alias("s"))
    draws = stats.withColumn("h", freq.draw_numbers(DRAWS)).select(
        "site",
        "h",
        F.array(
            F.col("s") * (F.lit(1.0) + F.col("h") / 100.0), F.lit(0.1) * F.col("h"), F.col("m")
        ).alias("beta"),
        (F.lit(2.0) + F.col("h") / 10.0).alias("rmse"),
    )
    return privacy.continuous_probability(draws, [-2.0, 0.0, 2.0])


@case(
    "time_probability",
    "site:s model:i sim:i id:i h:i p_td:f9",
    f"SELECT {K}, id, h, exp(status * ln(rate) - spent) AS p_td FROM cand JOIN hazard "
    f"USING ({K}, id, stage) WHERE stage = stage_id",
    RATIO_SQL,
)
def _(spark, folder):
    inputs = Inputs(spark, folder)
    return privacy.time_probability(inputs.real, inputs.rates)


@case(
    "synthetic_loglik", "site:s model:i sim:i h:i log_p:f6", "SELECT * FROM log_p", MODEL_SQL
)
def _(spark, folder):
    return Inputs(spark, folder).loglik()


@case(
    "candidate_ratio",
    "site:s model:i sim:i id:i stage:i h:i ratio:f6",
    f"SELECT {K}, id, stage, h, exp(lr) AS ratio FROM log_ratio",
    RATIO_SQL,
)
def _(spark, folder):
    inputs = Inputs(spark, folder)
    return privacy.candidate_ratio(inputs.real, inputs.p_cov, inputs.rates)


@case(
    "importance_weights",
    "site:s model:i sim:i id:i stage:i correct:i loglik:f6",
    "SELECT * FROM posterior",
    POSTERIOR_SQL,
)
def _(spark, folder):
    evidence = Inputs(spark, folder).evidence()
    return evidence.select(*RUN, "id", F.inline("cand"))


@case(
    "candidate_posterior",
    "site:s model:i sim:i id:i stage:i correct:i probability:f6",
    "SELECT * FROM posterior",
    POSTERIOR_SQL,
)
def _(spark, folder):
    return privacy.candidate_posterior(Inputs(spark, folder).evidence())


@case(
    "model_prior",
    "site:s model:i sim:i id:i stage:i prior:f6 prob_prior:f6",
    "SELECT * FROM posterior",
    POSTERIOR_SQL,
)
def _(spark, folder):
    return privacy.candidate_posterior(Inputs(spark, folder).evidence())


@case(
    "candidate_rank",
    "site:s model:i sim:i id:i stage:i rank:i rank_prior:i",
    "SELECT *, row_number() OVER (PARTITION BY site, model, sim, id ORDER BY probability DESC, "
    "correct DESC, stage) AS rank, row_number() OVER (PARTITION BY site, model, sim, id "
    "ORDER BY prob_prior DESC, correct DESC, stage) AS rank_prior FROM posterior",
    POSTERIOR_SQL,
)
def _(spark, folder):
    return privacy.candidate_posterior(Inputs(spark, folder).evidence())


@case(
    "mlpl",
    "site:s model:i sim:i bayesian:f6 ll_diff:f6 bayesian_max:f6",
    "SELECT * FROM mlpl",
    POSTERIOR_SQL,
)
def _(spark, folder):
    return privacy.maximum_local_privacy_loss(Inputs(spark, folder).evidence())


@case(
    "trade_off",
    "site:s model:i sim:i pmse:f9 ll_diff:f6 mean_pmse:f9 mean_ll_diff:f6",
    f"SELECT *, avg(pmse) OVER (PARTITION BY site, model) AS mean_pmse, avg(ll_diff) OVER "
    f"(PARTITION BY site, model) AS mean_ll_diff FROM pmse FULL OUTER JOIN mlpl USING ({K})",
    PMSE_SQL.strip().rstrip(",") + "," + POSTERIOR_SQL,
)
def _(spark, folder):
    """Utility against privacy loss per run, with the model means on every row."""
    loss = privacy.maximum_local_privacy_loss(Inputs(spark, folder).evidence())
    score = utility.pmse(cell_propensity(run_table(spark, folder)))
    return utility.trade_off(score, loss, "pmse", "ll_diff")


@case(
    "representative_run",
    "site:s model:i sim:i ll_diff:f6 med:f6",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, model ORDER BY "
    "abs(ll_diff - med), sim) AS rn FROM (SELECT *, median(ll_diff) OVER (PARTITION BY site, "
    "model) AS med FROM mlpl)) WHERE rn = 1",
    POSTERIOR_SQL,
)
def _(spark, folder):
    losses = privacy.maximum_local_privacy_loss(Inputs(spark, folder).evidence())
    return privacy.representative_run(losses)


@case(
    "prior_sweep",
    "site:s model:i sim:i id:i prior:f6 ymin:f6 ymax:f6",
    f"SELECT {K}, id, a AS prior, CASE WHEN hi - lo < 0.01 THEN greatest(hi - 0.01, 0) ELSE lo END "
    f"AS ymin, hi AS ymax FROM (SELECT {K}, id, a, min(y) AS lo, max(y) AS hi FROM ("
    f"SELECT {K}, id, a, t.probability * a / nullif(t.probability * a + "
    f"w.probability * (1 - a), 0) AS y FROM (SELECT * FROM posterior WHERE correct = 1) t "
    f"JOIN (SELECT * FROM posterior WHERE correct = 0) w USING ({K}, id) JOIN worst "
    f"USING ({K}, id), (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS a)) GROUP BY ALL)",
    POSTERIOR_SQL
    + f""",
worst AS (SELECT {K}, id FROM (SELECT *, row_number() OVER (PARTITION BY {K}
    ORDER BY round(loss, 9) DESC, id) AS rn FROM losses) WHERE rn = 1)""",
)
def _(spark, folder):
    return privacy.prior_sweep(Inputs(spark, folder).evidence())


@case(
    "two_model_posterior",
    "site:s l_first:f6 l_second:f6 distance:f6 p_second:f6",
    "SELECT 'main' AS site, l_first, l_second, abs(l_first - l_second) AS distance, "
    "1 / (1 + exp(l_first - l_second)) AS p_second FROM (SELECT sum(ln(f0.p) + status * "
    "ln(f0.rate) - f0.rate * t) AS l_first, sum(ln(f1.p) + status * ln(f1.rate) - f1.rate * t) "
    "AS l_second FROM cohort JOIN f0 ON f0.grp = sex JOIN f1 ON f1.grp = sex)",
    ", ".join(
        f"f{g} AS (SELECT grp, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p, "
        "sum(status) / sum(t) AS rate FROM (SELECT CASE WHEN id = (SELECT min(id) FROM cohort "
        f"WHERE t = (SELECT max(t) FROM cohort)) THEN {g} ELSE sex END AS grp, status, t "
        "FROM cohort) GROUP BY grp)"
        for g in (0, 1)
    ),
)
def _(spark, folder):
    """The longest-lived person counted in either group: two worlds, one table to judge by."""
    people = cut(cohort(spark, folder).withColumn("site", F.lit("main")), "people")
    longest = people.groupBy("site").agg(
        F.min(F.struct((-F.col("t")).alias("t"), "id")).alias("best")
    ).select("site", F.col("best.id").alias("outlier"))
    scored = people
    for world, name in ((0, "p_first"), (1, "p_second")):
        moved = people.join(longest, "site").withColumn(
            "grp", F.when(F.col("id") == F.col("outlier"), F.lit(world)).otherwise(F.col("sex"))
        )
        cells = moved.groupBy("site", "grp").agg(
            F.count("*").alias("n"), (F.sum("status") / F.sum("t")).alias(f"rate_{name}")
        )
        sizes = people.groupBy("site").agg(F.count("*").alias("all"))
        fit = cells.join(sizes, "site").select(
            "site", F.col("grp").alias("sex"), f"rate_{name}",
            (F.col("n") / F.col("all")).alias(f"share_{name}"),
        )
        rate = F.col(f"rate_{name}")
        density = F.when(F.col("status") == 1, rate).otherwise(F.lit(1.0)) * F.exp(
            -rate * F.col("t")
        )
        scored = scored.join(fit, ["site", "sex"]).withColumn(
            name, F.col(f"share_{name}") * density
        )
    return privacy.two_model_posterior(scored, "p_first", "p_second")


@case("redraw_invalid", "site:s model:i sim:i h:i log_p:f6")
def _(spark, folder):
    """A surplus of posterior draws; the first valid ones are kept and renumbered."""
    runs = cut(run_table(spark, folder), "runs")
    real, synthetic = runs.filter("synth = 0"), runs.filter("synth = 1")
    tables = []
    for variable, parents in SUBMODELS:
        counts = freq.class_counts(real, RUN, variable, parents)
        draws = freq.dirichlet_draws(counts, RUN, variable, parents, DRAWS + 3)
        tables.append((variable, parents, draws))
    by = [*RUN, "sex", "stage"]
    rates = freq.gamma_rates(freq.event_exposure(real, by), by, DRAWS + 3)
    p_cov = privacy.covariate_probability(privacy.scenario_grid(real), tables)
    p_cov, rates = privacy.valid_draws(cut(p_cov, "p_cov"), cut(rates, "rates"), DRAWS)
    return privacy.synthetic_loglik(synthetic, p_cov, rates)


def _fitted_site(spark, folder):
    return cut(cohort(spark, folder).withColumn("site", F.lit("main")), "cohort")


@case("coefficient_draws", "site:s model:i sim:i h:i attempt:i submodel:s term:i beta:f6")
def _(spark, folder):
    """Coefficient vectors of all six fitted models from their store, one row a coefficient."""
    chains = models.fit_chains(_fitted_site(spark, folder), STUDY, range(6))
    store = DrawStore(
        spark, scratch_path(spark, "draws"), fitted_privacy.draws_schema(chains)
    )
    requests = fitted_privacy.draw_requests(spark, "main", range(6), SIMS, STUDY.draws)
    store.put(fitted_privacy.coefficient_draws(requests, chains))
    found = store.manifest().select(*RUN, "h", "attempt")
    return fitted_privacy.long_coefficients(store.read()).join(found, [*RUN, "h"])


@case("mlpl_fitted", "site:s model:i sim:i bayesian:f6 ll_diff:f6 bayesian_max:f6")
def _(spark, folder):
    """Largest privacy loss of every run of all six fitted models."""
    evidence = fitted_privacy.fitted_evidence(
        _fitted_site(spark, folder), STUDY, range(6), SIMS, "main"
    )
    return privacy.maximum_local_privacy_loss(evidence)
