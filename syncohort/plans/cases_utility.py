"""Survival, utility, similarity and attack metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncohort.functions.draws import portable_uniform, portable_uniform_sql
from syncohort.lineage import cut
from syncohort.operators import attack, density, distance, report, survival, utility
from syncohort.operators.stats import with_group_stats
from syncohort.plans.cases import case
from syncohort.plans.derived import (
    STUDY,
    attack_table,
    cohort,
    real_and_synthetic,
    run_table,
)
from syncohort.settings import RUN

HORIZON = 2.0
K = "site, model, sim"
G = "site, model, sim, age_grp, sex, stage"

AGE_GRP = (
    "CASE WHEN age <= 0 THEN 0 WHEN age <= 40 THEN 1 WHEN age <= 50 THEN 2 WHEN age <= 60 THEN 3 "
    "WHEN age <= 70 THEN 4 WHEN age <= 80 THEN 5 ELSE 6 END"
)

SURVIVAL_SQL = f"""
grouped AS (SELECT *, {AGE_GRP} AS age_grp FROM runs),
days AS (SELECT {G}, synth, t, count(*) AS n, sum(status) AS d FROM grouped GROUP BY ALL),
risk AS (SELECT *, sum(n) OVER (PARTITION BY {G}, synth ORDER BY t DESC) AS at_risk FROM days),
points AS (SELECT {G}, synth, CASE WHEN max(t) < 2 THEN 0
    WHEN bool_or(d >= at_risk AND t <= 2) THEN 0
    ELSE exp(coalesce(sum(CASE WHEN t <= 2 AND d < at_risk
                               THEN ln(1 - d / CAST(at_risk AS DOUBLE)) END), 0)) END AS s
  FROM risk GROUP BY ALL),
strata AS (SELECT {G}, max(s) FILTER (synth = 0) AS s_real, max(s) FILTER (synth = 1) AS s_synth
  FROM points GROUP BY ALL),
surv AS (SELECT {K}, avg(abs(s_real - s_synth)) AS mean_diff,
    median(abs(s_real - s_synth)) AS med_diff, count(*) AS strata
  FROM strata WHERE s_real IS NOT NULL AND s_synth IS NOT NULL GROUP BY ALL)
"""

LOGRANK_SQL = f"""
grouped AS (SELECT *, {AGE_GRP} AS age_grp FROM runs),
days AS (SELECT {G}, t, count(*) AS n, sum(status) AS d, sum(synth) AS n1,
    sum(status * synth) AS d1 FROM grouped GROUP BY ALL),
risk AS (SELECT {G}, CAST(d AS DOUBLE) AS d, CAST(d1 AS DOUBLE) AS d1,
    CAST(sum(n) OVER w AS DOUBLE) AS n, CAST(sum(n1) OVER w AS DOUBLE) AS n1 FROM days
  WINDOW w AS (PARTITION BY {G} ORDER BY t DESC)),
test AS (SELECT {G}, sum(CASE WHEN d > 0 THEN d1 - d * n1 / n ELSE 0 END) AS o_minus_e,
    sum(CASE WHEN d > 0 AND n > 1 THEN d * n1 * (n - n1) * (n - d) / (n * n * (n - 1)) ELSE 0 END)
      AS v FROM risk GROUP BY ALL),
chi AS (SELECT *, CASE WHEN v > 1e-12 THEN o_minus_e * o_minus_e / v END AS chi2 FROM test)
"""

JSD_SQL = f"""
cells AS (
  SELECT {K}, synth, variable, value, variable IN ('age', 't') AS binned FROM
  (SELECT {K}, synth, CAST(stage AS DOUBLE) AS stage, CAST(sex AS DOUBLE) AS sex,
      CAST(daar AS DOUBLE) AS daar, CAST(status AS DOUBLE) AS status, CAST(age AS DOUBLE) AS age, t
   FROM runs) UNPIVOT (value FOR variable IN (stage, sex, daar, status, age, t))),
widths AS (SELECT *, (max(value) OVER w - min(value) OVER w) / 19 AS width FROM cells
  WINDOW w AS (PARTITION BY {K}, variable)),
counts AS (SELECT {K}, variable, CASE WHEN binned THEN floor(value / width) ELSE value END AS cell,
    count_if(synth = 0) AS a, count_if(synth = 1) AS b FROM widths GROUP BY ALL),
shares AS (SELECT *, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM counts
  WINDOW w AS (PARTITION BY {K}, variable)),
jsd AS (SELECT {K}, variable, sqrt(greatest(0, sum(
    0.5 * (CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / ln(2) ELSE 0 END)
    + 0.5 * (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) / ln(2) ELSE 0 END)))) AS jsd
  FROM shares GROUP BY ALL),
jsd_run AS (SELECT {K}, sum(jsd) AS jsd FROM jsd GROUP BY ALL)
"""

_DUMMIES = [f"stage_{s}" for s in STUDY.stages]
_VARS = [*_DUMMIES, "age", "daar", "sex", "t", "status"]
_PAIRS = [
    (a, b)
    for i, a in enumerate(_VARS)
    for b in _VARS[i + 1 :]
    if not (a in _DUMMIES and b in _DUMMIES)
]
PCD_SQL = f"""
coded AS (SELECT *, {", ".join(f"CASE WHEN stage = {s} THEN 1 ELSE 0 END AS stage_{s}"
                               for s in STUDY.stages)} FROM runs),
corrs AS (SELECT {K}, {", ".join(
    f"corr({a}, {b}) FILTER (synth = {z}) AS c{z}_{i}"
    for i, (a, b) in enumerate(_PAIRS) for z in (0, 1))} FROM coded GROUP BY ALL),
pcd AS (SELECT {K}, sqrt(2 * ({" + ".join(
    f"power(c0_{i} - c1_{i}, 2)" for i in range(len(_PAIRS)))})) AS pcd FROM corrs)
"""

PMSE_SQL = f"""
propensity AS (SELECT {K}, id, cell_synth / CAST(cell AS DOUBLE) AS prob FROM (
  SELECT {K}, id, sum(synth) OVER w AS cell_synth, count(*) OVER w AS cell FROM runs
  WINDOW w AS (PARTITION BY {K}, age, sex, stage))),
pmse AS (SELECT {K}, avg(power(prob - 0.5, 2)) AS pmse FROM propensity GROUP BY ALL)
"""


def cell_propensity(runs):
    """Share of synthetic rows among the rows with the same age, sex and stage."""
    return with_group_stats(
        runs,
        [*RUN, "age", "sex", "stage"],
        {"prob": F.avg(F.col("synth").cast("double"))},
    )


@case(
    "kaplan_meier",
    "stage:i sex:i t:f9 events:i at_risk:i survivor:f9",
    "SELECT stage, sex, t, d AS events, n AS at_risk, CASE WHEN bool_or(d >= n) OVER w THEN 0 "
    "ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / CAST(n AS DOUBLE)) END) OVER w) END AS survivor "
    "FROM (SELECT stage, sex, t, sum(status) AS d, sum(count(*)) OVER (PARTITION BY stage, sex "
    "ORDER BY t DESC) AS n FROM cohort GROUP BY stage, sex, t) "
    "WINDOW w AS (PARTITION BY stage, sex ORDER BY t)",
)
def _(spark, folder):
    return survival.kaplan_meier(cohort(spark, folder), ["stage", "sex"])


@case(
    "survival_strata",
    "site:s model:i sim:i age_grp:i sex:i stage:i s_real:f9 s_synth:f9 abs_diff:f9",
    "SELECT *, abs(s_real - s_synth) AS abs_diff FROM strata",
    SURVIVAL_SQL,
)
def _(spark, folder):
    """Survival at the horizon in both sources, per stratum of every run."""
    return survival.survival_at_horizon(*real_and_synthetic(spark, folder), HORIZON)


@case(
    "survival_at_horizon_diff",
    "site:s model:i sim:i mean_diff:f9 med_diff:f9 strata:i",
    "SELECT * FROM surv",
    SURVIVAL_SQL,
)
def _(spark, folder):
    return survival.survival_difference(*real_and_synthetic(spark, folder), HORIZON)


@case(
    "logrank",
    "site:s model:i sim:i age_grp:i sex:i stage:i o_minus_e:f6 v:f6 chi2:f6",
    "SELECT * FROM chi",
    LOGRANK_SQL,
)
def _(spark, folder):
    return survival.logrank(*real_and_synthetic(spark, folder), with_p=False)


#: Upper tail for one degree of freedom: the error function's series, all terms positive.
TAIL_SQL = (
    "1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * list_sum([exp(2 * n * ln(2) + lgamma(n + 1) - "
    "lgamma(2 * n + 2) + (n + 0.5::DOUBLE) * ln(chi2 / 2)) FOR n IN range(0, 400)])"
)


@case(
    "logrank_p",
    "site:s model:i sim:i age_grp:i sex:i stage:i chi2:f6 p:f6",
    f"SELECT *, CASE WHEN chi2 > 1e-300 THEN {TAIL_SQL} WHEN chi2 >= 0 THEN 1 END AS p FROM chi",
    LOGRANK_SQL,
)
def _(spark, folder):
    """Tail probabilities of the test statistic."""
    return survival.logrank(*real_and_synthetic(spark, folder))


@case(
    "logrank_share",
    "site:s model:i sim:i p05:f9 strata:i",
    f"SELECT {K}, avg(CASE WHEN chi2 > 3.841458820694124 THEN 1 ELSE 0 END) AS p05, "
    "count(*) AS strata FROM chi GROUP BY ALL",
    LOGRANK_SQL,
)
def _(spark, folder):
    return survival.logrank_share(*real_and_synthetic(spark, folder))


@case("jsd_univariate", "site:s model:i sim:i variable:s jsd:f9", "SELECT * FROM jsd", JSD_SQL)
def _(spark, folder):
    return utility.jsd_univariate(*real_and_synthetic(spark, folder))


@case(
    "jsd_total",
    "site:s model:i med:f9 p25:f9 p75:f9",
    f"SELECT site, model, median(jsd) AS med, min(jsd) AS p25, max(jsd) AS p75 FROM jsd_run "
    "GROUP BY ALL",
    JSD_SQL,
)
def _(spark, folder):
    """Of three runs the quartiles are the extremes."""
    total = utility.jsd_total(utility.jsd_univariate(*real_and_synthetic(spark, folder)))
    return utility.summary_median_iqr(total, ["site", "model"], "jsd")


@case("pcd", "site:s model:i sim:i pcd:f9", "SELECT * FROM pcd", PCD_SQL)
def _(spark, folder):
    return utility.pcd(*real_and_synthetic(spark, folder))


@case("pmse", "site:s model:i sim:i pmse:f9", "SELECT * FROM pmse", PMSE_SQL)
def _(spark, folder):
    return utility.pmse(cell_propensity(run_table(spark, folder)))


def _three(name: str, fmt: str) -> str:
    return (
        f"printf('{fmt}', median({name})) || ' (' || printf('{fmt}', min({name})) || ', ' || "
        f"printf('{fmt}', max({name})) || ')'"
    )


@case(
    "utility_table",
    "site:s model:i str:s",
    "SELECT site, model, ' & ' || CASE model WHEN 0 THEN 'Indep. marginals' ELSE 'Model 1' END "
    f"|| ' & ' || {_three('jsd', '%.3f')} || ' & ' || {_three('pcd', '%.3f')} || ' & ' || "
    f"{_three('pmse', '%.1e')} || ' & ' || {_three('mean_diff', '%.3f')} || ' \\\\' AS str "
    f"FROM jsd_run JOIN pcd USING ({K}) JOIN pmse USING ({K}) JOIN surv USING ({K}) "
    "GROUP BY site, model",
    ",".join(c.strip() for c in (JSD_SQL, PCD_SQL, PMSE_SQL, SURVIVAL_SQL)),
)
def _(spark, folder):
    """All utility metrics in one report row per model."""
    runs = cut(run_table(spark, folder), "runs")
    real, synthetic = runs.filter("synth = 0"), runs.filter("synth = 1")
    table = utility.utility_table(
        utility.jsd_total(utility.jsd_univariate(real, synthetic)),
        utility.pcd(real, synthetic),
        utility.pmse(cell_propensity(runs)),
        survival.survival_difference(real, synthetic, HORIZON),
    )
    return report.report_rows(table, ["jsd", "pcd", "pmse", "mean_diff"], ["site", "model"])


NUMERIC = STUDY.numeric


def _spans(source: str = "attack", where: str = "") -> str:
    spans = ", ".join(
        f"CAST(max({c}) - min({c}) AS DOUBLE) AS r_{c}" for c in NUMERIC
    )
    return f"SELECT {K}, {spans} FROM {source} {where} GROUP BY ALL"


def _gower(a: str = "a", b: str = "b", r: str = "r") -> str:
    parts = [f"coalesce(abs({a}.{c} - {b}.{c}) / nullif({r}.r_{c}, 0), 0)" for c in NUMERIC]
    parts.append(f"CASE WHEN {a}.stage <> {b}.stage THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) / {len(parts)}.0::DOUBLE)"


GOWER_SQL = f"""
spans AS ({_spans()}),
real_spans AS ({_spans(where="WHERE synth = 0")}),
r_to_s AS (SELECT {", ".join(f"a.{k}" for k in RUN)}, a.id, a.holdout, min({_gower()}) AS d
  FROM attack a JOIN attack b ON a.model = b.model AND a.sim = b.sim AND a.synth = 0
    AND b.synth = 1 JOIN spans r ON r.model = a.model AND r.sim = a.sim GROUP BY ALL),
s_to_r AS (SELECT {", ".join(f"a.{k}" for k in RUN)}, a.id, min({_gower()}) AS d
  FROM attack a JOIN attack b ON a.model = b.model AND a.sim = b.sim AND a.synth = 1
    AND b.synth = 0 JOIN spans r ON r.model = a.model AND r.sim = a.sim GROUP BY ALL),
r_to_r AS (SELECT {", ".join(f"a.{k}" for k in RUN)}, a.id, min({_gower()}) AS d
  FROM attack a JOIN attack b ON a.model = b.model AND a.sim = b.sim AND a.synth = 0
    AND b.synth = 0 AND a.id <> b.id JOIN spans r ON r.model = a.model AND r.sim = a.sim
  GROUP BY ALL),
dcr AS (SELECT {K}, avg(d) AS dcr FROM s_to_r GROUP BY ALL),
scored AS (SELECT {K}, avg(CASE WHEN round(s.d, 12) < round(o.d, 12) THEN 1 ELSE 0 END)
    AS id_score FROM r_to_s s JOIN r_to_r o USING ({K}, id) GROUP BY ALL),
matched AS (SELECT {K}, avg(CASE WHEN EXISTS (SELECT 1 FROM attack b WHERE b.synth = 0
    AND b.model = a.model AND b.sim = a.sim AND b.age = a.age AND b.sex = a.sex
    AND b.stage = a.stage AND b.daar = a.daar AND b.status = a.status AND b.t = a.t
    AND b.exit_delta = a.exit_delta) THEN 1 ELSE 0 END) AS ims
  FROM attack a WHERE synth = 1 GROUP BY ALL)
"""

MATCH_FEATURES = [*STUDY.numeric, *STUDY.categorical]


@case(
    "nearest_records",
    "site:s model:i sim:i id:i rank:i distance:f6",
    f"SELECT {K}, id, rank, d AS distance FROM (SELECT {', '.join(f'a.{k}' for k in RUN)}, a.id, "
    f"{_gower()} AS d, row_number() OVER (PARTITION BY {', '.join(f'a.{k}' for k in RUN)}, a.id "
    f"ORDER BY {_gower()}) AS rank FROM attack a JOIN attack b ON a.model = b.model AND "
    "a.sim = b.sim AND a.synth = 1 AND b.synth = 0 JOIN spans r ON r.model = a.model AND "
    "r.sim = a.sim) WHERE rank <= 3",
    f"spans AS ({_spans()})",
)
def _(spark, folder):
    """The three nearest real records of every synthetic row."""
    real, synthetic = attack_table(spark, folder)
    return distance.nearest_records(real, synthetic, k=3)


@case(
    "ims",
    "site:s model:i sim:i ims:f9",
    "SELECT * FROM matched",
    GOWER_SQL,
)
def _(spark, folder):
    real, synthetic = attack_table(spark, folder)
    return distance.identical_match_share(real, synthetic, MATCH_FEATURES)


@case("dcr_mean", "site:s model:i sim:i dcr:f9", "SELECT * FROM dcr", GOWER_SQL)
def _(spark, folder):
    return distance.mean_closest_distance(*attack_table(spark, folder))


@case(
    "dcr_per_real",
    "site:s model:i sim:i id:i distance:f6",
    f"SELECT {K}, id, d AS distance FROM r_to_s",
    GOWER_SQL,
)
def _(spark, folder):
    real, synthetic = attack_table(spark, folder)
    return distance.closest_distance(synthetic, real)


@case(
    "identifiability_score",
    "site:s model:i sim:i id_score:f9",
    "SELECT * FROM scored",
    GOWER_SQL,
)
def _(spark, folder):
    return distance.identifiability_score(*attack_table(spark, folder))


@case(
    "similarity_table",
    "site:s model:i str:s",
    "SELECT site, model, ' & ' || CASE model WHEN 0 THEN 'Indep. marginals' ELSE 'Model 1' END "
    f"|| ' & ' || {_three('100 * ims', '%.3f')} || ' & ' || {_three('dcr', '%.3f')} || ' & ' || "
    f"{_three('id_score', '%.3f')} || ' \\\\' AS str FROM matched JOIN dcr USING ({K}) "
    f"JOIN scored USING ({K}) GROUP BY site, model",
    GOWER_SQL,
)
def _(spark, folder):
    """Matches, distances and identifiability in one report row per model."""
    real, synthetic = attack_table(spark, folder)
    table = report.similarity_table(
        distance.identical_match_share(real, synthetic, MATCH_FEATURES),
        distance.mean_closest_distance(real, synthetic),
        distance.identifiability_score(real, synthetic),
    )
    return report.report_rows(table, ["ims", "dcr", "id_score"], ["site", "model"])


def _roc_sql(scores: str) -> str:
    return f"""
scores AS ({scores}),
by_score AS (SELECT {K}, score, sum(member) AS pos, sum(1 - member) AS neg FROM scores
  GROUP BY ALL),
roc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    CAST(sum(pos) OVER g AS DOUBLE) AS p, CAST(sum(neg) OVER g AS DOUBLE) AS n FROM by_score
  WINDOW w AS (PARTITION BY {K} ORDER BY score DESC), g AS (PARTITION BY {K})),
attacked AS (SELECT {K}, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / any_value(p * n) AS auc,
    coalesce(max(tp / p) FILTER (fp / n <= 0), 0) AS tpr_1,
    coalesce(max(tp / p) FILTER (fp / n <= 0.001::DOUBLE), 0) AS tpr_2,
    coalesce(max(tp / p) FILTER (fp / n <= 0.01::DOUBLE), 0) AS tpr_3
  FROM roc GROUP BY ALL)
"""


#: Exact binomial limits at 0.975 by bisection, for the best corners of every curve; the
#: tails are sums of binomial terms. A lower limit at x needs P(X >= x) = 0.025, an upper
#: one P(X <= x) = 0.025.
EPSILON_SQL = f"""
best_tp AS (SELECT {K}, p, n, fp, max(tp) AS tp FROM roc WHERE fp > 0 AND tp > 0 GROUP BY ALL),
corners AS (SELECT {K}, p, n, tp, min(fp) AS fp FROM best_tp GROUP BY ALL),
asked AS (SELECT DISTINCT 1 AS lower, CAST(tp AS BIGINT) AS x, CAST(p AS BIGINT) AS n FROM corners
  UNION SELECT 0, CAST(fp AS BIGINT), CAST(n AS BIGINT) FROM corners),
halved AS (
  SELECT lower, x, n, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM asked
  UNION ALL
  SELECT lower, x, n, step + 1, CASE WHEN low_side THEN mid ELSE lo END,
    CASE WHEN low_side THEN hi ELSE mid END
  FROM (SELECT *, (tail < 0.025::DOUBLE) = (lower = 1) AS low_side FROM (
    SELECT *, (lo + hi) / 2 AS mid, list_sum([exp(lgamma(n + 1) - lgamma(k + 1)
        - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2))
      FOR k IN range(CASE WHEN lower = 1 THEN x ELSE 0 END,
        CASE WHEN lower = 1 THEN n + 1 ELSE x + 1 END)]) AS tail
    FROM halved WHERE step < 46))),
limits AS (SELECT lower, x, n, CASE WHEN lower = 0 AND x >= n THEN 1 ELSE (lo + hi) / 2 END AS v
  FROM halved WHERE step = 46),
bounds AS (SELECT {K}, max(ln(a.v / b.v)) AS bound FROM corners c
  JOIN limits a ON a.lower = 1 AND a.x = c.tp AND a.n = c.p
  JOIN limits b ON b.lower = 0 AND b.x = c.fp AND b.n = c.n GROUP BY {K}),
epsilons AS (SELECT {K}, greatest(coalesce(bound, 0), 0) AS epsilon
  FROM (SELECT DISTINCT {K} FROM roc) LEFT JOIN bounds USING ({K}))
"""

SIMPLE_SCORES = f"SELECT {K}, round(t, 2) AS score, status AS member FROM runs WHERE synth = 0"


def _simple_scores(spark, folder):
    """Follow-up time as a score for the event, with ties."""
    real, _ = real_and_synthetic(spark, folder)
    return real.withColumns({"score": F.round("t", 2), "member": F.col("status")})


@case(
    "roc_points",
    "site:s model:i sim:i score:f6 tp:i fp:i tpr:f9 fpr:f9",
    "SELECT *, tp / p AS tpr, fp / n AS fpr FROM roc",
    _roc_sql(SIMPLE_SCORES),
)
def _(spark, folder):
    return attack.roc_points(_simple_scores(spark, folder))


@case(
    "roc_auc",
    "site:s model:i sim:i auc:f9",
    "SELECT * FROM attacked",
    _roc_sql(SIMPLE_SCORES),
)
def _(spark, folder):
    return attack.roc_auc(attack.roc_points(_simple_scores(spark, folder)))


@case(
    "tpr_at_fpr",
    "site:s model:i sim:i tpr_1:f9 tpr_2:f9 tpr_3:f9",
    "SELECT * FROM attacked",
    _roc_sql(SIMPLE_SCORES),
)
def _(spark, folder):
    return attack.tpr_at_fpr(attack.roc_points(_simple_scores(spark, folder)))


@case(
    "empirical_epsilon",
    "site:s model:i sim:i epsilon:f6",
    "SELECT * FROM epsilons",
    _roc_sql(SIMPLE_SCORES).rstrip() + "," + EPSILON_SQL,
    recursive=True,
)
def _(spark, folder):
    return attack.empirical_epsilon(attack.roc_points(_simple_scores(spark, folder)))


@case(
    "mia_distance",
    "site:s model:i sim:i auc:f6 tpr_1:f6 tpr_2:f6 tpr_3:f6",
    "SELECT * FROM attacked",
    GOWER_SQL.rstrip()
    + ","
    + _roc_sql(f"SELECT {K}, -round(d, 12) AS score, 1 - holdout AS member FROM r_to_s"),
)
def _(spark, folder):
    """Membership attack by distance to the closest synthetic record."""
    return attack.evaluate_scores(distance.distance_scores(*attack_table(spark, folder)))


def _reference_uniform():
    return portable_uniform("id", F.col("model") * 3 + F.col("sim"))


SPLIT_SQL = f"""
marked AS (SELECT *, holdout = 1 AND {portable_uniform_sql("id", "model * 3 + sim")} < 0.5::DOUBLE
    AS reference FROM attack),
tested AS (SELECT * FROM marked WHERE synth = 0 AND NOT reference),
known AS (SELECT * FROM marked WHERE synth = 0 AND reference),
stock AS (SELECT * FROM marked WHERE synth = 1)
"""


def _near(name: str, data: str) -> str:
    return f"""
{name}_spans AS ({_spans(f"(SELECT * FROM tested UNION ALL SELECT * FROM {data})")}),
{name} AS (SELECT {", ".join(f"a.{k}" for k in RUN)}, a.id, a.holdout,
    round(min({_gower()}), 12) AS d FROM tested a JOIN {data} b ON a.model = b.model
    AND a.sim = b.sim JOIN {name}_spans r ON r.model = a.model AND r.sim = a.sim GROUP BY ALL)
"""


CALIBRATED_SQL = ",".join(
    part.strip() for part in (SPLIT_SQL, _near("near_s", "stock"), _near("near_k", "known"))
)


@case(
    "mia_distance_calibrated",
    "site:s model:i sim:i id:i member:i score:f6",
    f"SELECT {K}, id, 1 - s.holdout AS member, k.d - s.d AS score FROM near_s s JOIN near_k k "
    f"USING ({K}, id)",
    CALIBRATED_SQL,
)
def _(spark, folder):
    """Distance to a reference half of the held-out rows minus distance to the synthetic."""
    return distance.calibrated_distance_scores(
        *attack_table(spark, folder), uniform=_reference_uniform()
    )


_FEATURES = [*NUMERIC, "stage_code"]
_D = len(_FEATURES)


def _standardised(name: str, source: str, fitted: str = "stock") -> str:
    codes = (
        f"SELECT {K}, stage, dense_rank() OVER (PARTITION BY {K} ORDER BY stage) - 1 AS stage_code "
        f"FROM (SELECT DISTINCT {K}, stage FROM {fitted})"
    )
    stats = ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _FEATURES
    )
    values = ", ".join(
        f"({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END) AS z{i}"
        for i, c in enumerate(_FEATURES)
    )
    return f"""
{name}_codes AS ({codes}),
{name}_fit AS (SELECT {K}, {stats} FROM {fitted} JOIN {name}_codes USING ({K}, stage) GROUP BY ALL),
{name} AS (SELECT {K}, id, holdout, {values} FROM
  (SELECT s.*, coalesce(stage_code, 9) AS stage_code FROM {source} s LEFT JOIN {name}_codes
   USING ({K}, stage)) JOIN {name}_fit USING ({K}))
"""


def _density(name: str, data: str, queries: str) -> str:
    """Kernel density with the full covariance: Cholesky factor written out entry by entry."""
    covariances = ", ".join(
        f"covar_samp(z{i}, z{j}) AS c{i}_{j}" for i in range(_D) for j in range(i + 1)
    )
    steps = [
        f"{name}_l0 AS (SELECT {K}, count(*) AS n, {covariances} FROM {data} GROUP BY ALL)"
    ]
    step = 0
    for j in range(_D):
        for i in range(j, _D):
            inner = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            value = (
                f"sqrt(c{j}_{j}{inner})" if i == j else f"(c{i}_{j}{inner}) / l{j}_{j}"
            )
            steps.append(
                f"{name}_l{step + 1} AS (SELECT *, {value} AS l{i}_{j} FROM {name}_l{step})"
            )
            step += 1
    steps.append(
        f"{name}_bw AS (SELECT *, power(n * ({_D} + 2) / 4.0::DOUBLE, -1.0::DOUBLE / ({_D} + 4)) "
        f"AS bw, {' + '.join(f'ln(l{i}_{i})' for i in range(_D))} AS logdet FROM {name}_l{step})"
    )
    last = f"{name}_p"
    gaps = ", ".join(f"a.z{i} - b.z{i} AS g{i}" for i in range(_D))
    factors = ", ".join(f"l{i}_{j}" for i in range(_D) for j in range(i + 1))
    steps.append(
        f"{last} AS (SELECT {', '.join(f'a.{k}' for k in RUN)}, a.id, a.holdout, n, bw, logdet, "
        f"{gaps}, {factors} FROM {queries} a JOIN {data} b ON a.model = b.model AND a.sim = b.sim "
        f"JOIN {name}_bw w ON w.model = a.model AND w.sim = a.sim)"
    )
    for i in range(_D):
        inner = "".join(f" - l{i}_{k} * y{k}" for k in range(i))
        steps.append(f"{name}_y{i} AS (SELECT *, (g{i}{inner}) / l{i}_{i} AS y{i} FROM {last})")
        last = f"{name}_y{i}"
    squared = " + ".join(f"y{i} * y{i}" for i in range(_D))
    steps.append(
        f"{name}_e AS (SELECT {K}, id, holdout, n, bw, logdet, -0.5 * ({squared}) / (bw * bw) AS e "
        f"FROM {last})"
    )
    steps.append(
        f"{name}_m AS (SELECT *, max(e) OVER (PARTITION BY {K}, id) AS top FROM {name}_e)"
    )
    steps.append(
        f"{name} AS (SELECT {K}, id, holdout, any_value(top) + ln(sum(exp(e - top))) - "
        f"ln(any_value(n)) - {_D} / 2.0::DOUBLE * ln(2 * pi()) - {_D} * ln(any_value(bw)) - "
        f"any_value(logdet) AS score FROM {name}_m GROUP BY {K}, id, holdout)"
    )
    return ",\n".join(steps)


@case(
    "mia_density",
    "site:s model:i sim:i id:i member:i score:f6",
    f"SELECT {K}, id, 1 - holdout AS member, score FROM dens",
    ",".join(
        (
            "real_rows AS (SELECT * FROM attack WHERE synth = 0), "
            "stock AS (SELECT * FROM attack WHERE synth = 1)",
            _standardised("zq", "real_rows").strip(),
            _standardised("zs", "stock").strip(),
            _density("dens", "zs", "zq"),
        )
    ),
)
def _(spark, folder):
    """Log density under the synthetic table, seven features and full covariance."""
    return density.density_scores(*attack_table(spark, folder))


CALIBRATED_DENSITY_SQL = ",".join(
    (
        SPLIT_SQL.strip(),
        _standardised("zq", "tested").strip(),
        _standardised("zs", "stock").strip(),
        _standardised("zk", "known").strip(),
        _density("dens_s", "zs", "zq"),
        _density("dens_k", "zk", "zq"),
    )
)
#: Rounded, so that equal records stay ties whatever the order of summation.
MEMBERSHIP_SQL = ",".join(
    (
        CALIBRATED_DENSITY_SQL,
        _roc_sql(
            f"SELECT {K}, 1 - s.holdout AS member, round(s.score - k.score, 8) AS score "
            f"FROM dens_s s JOIN dens_k k USING ({K}, id)"
        ).rstrip(),
        EPSILON_SQL,
    )
)


@case(
    "mia_density_calibrated",
    "site:s model:i sim:i id:i member:i score:f6",
    f"SELECT {K}, id, 1 - s.holdout AS member, s.score - k.score AS score FROM dens_s s JOIN "
    f"dens_k k USING ({K}, id)",
    CALIBRATED_DENSITY_SQL,
)
def _(spark, folder):
    """Log density ratio of synthetic and reference."""
    return density.calibrated_density_scores(
        *attack_table(spark, folder), uniform=_reference_uniform()
    )


def _membership(spark, folder):
    scores = density.calibrated_density_scores(
        *attack_table(spark, folder), uniform=_reference_uniform()
    )
    return attack.evaluate_scores(scores.withColumn("score", F.round("score", 8)))


@case(
    "membership_evaluation",
    "site:s model:i sim:i auc:f6 tpr_1:f6 tpr_2:f6 tpr_3:f6 epsilon:f6",
    f"SELECT * FROM attacked JOIN epsilons USING ({K})",
    MEMBERSHIP_SQL,
    recursive=True,
)
def _(spark, folder):
    """All measures of the calibrated density attack."""
    return _membership(spark, folder)


@case(
    "membership_table",
    "site:s model:i str:s",
    "SELECT site, model, ' & ' || CASE model WHEN 0 THEN 'Indep. marginals' ELSE 'Model 1' END "
    f"|| ' & ' || {_three('epsilon', '%.3f')} || ' & ' || {_three('tpr_1', '%.3f')} || ' & ' || "
    f"{_three('tpr_2', '%.3f')} || ' & ' || {_three('tpr_3', '%.3f')} || ' \\\\' AS str "
    f"FROM attacked JOIN epsilons USING ({K}) GROUP BY site, model",
    MEMBERSHIP_SQL,
    recursive=True,
)
def _(spark, folder):
    """Median (min, max) over runs of the calibrated density attack, one report row per model."""
    measures = ["epsilon", "tpr_1", "tpr_2", "tpr_3"]
    table = report.membership_table(_membership(spark, folder), measures)
    return report.report_rows(table, measures, ["site", "model"])


#: Stage guessed from the synthetic shares by age and sex, scores of every class.
SHARES_SQL = f"""
shares AS (SELECT {K}, age, sex, stage AS class, count(*) / CAST(sum(count(*)) OVER
    (PARTITION BY {K}, age, sex) AS DOUBLE) AS score FROM runs WHERE synth = 1
    GROUP BY {K}, age, sex, stage),
people AS (SELECT * FROM runs WHERE synth = 0),
class_scores AS (SELECT {", ".join(f"p.{k}" for k in RUN)}, p.id, p.holdout, p.stage, c.class,
    coalesce(s.score, 0) AS score FROM people p,
    (SELECT unnest([1, 2, 3, 999]) AS class) c LEFT JOIN shares s ON s.model = p.model AND
    s.sim = p.sim AND s.age = p.age AND s.sex = p.sex AND s.class = c.class)"""

RATES_SQL = f"""{SHARES_SQL},
by_score AS (SELECT {K}, holdout, class, score, count_if(stage = class) AS pos,
    count_if(stage <> class) AS neg FROM class_scores GROUP BY ALL),
roc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    CAST(sum(pos) OVER g AS DOUBLE) AS p, CAST(sum(neg) OVER g AS DOUBLE) AS n FROM by_score
  WINDOW w AS (PARTITION BY {K}, holdout, class ORDER BY score DESC),
    g AS (PARTITION BY {K}, holdout, class)),
rates AS (SELECT {K}, holdout, CASE WHEN class = 999 THEN 9 ELSE class END AS class,
    coalesce(max(tp / p) FILTER (fp / n <= 0.01::DOUBLE), 0) AS rate FROM roc GROUP BY ALL),
gains AS (SELECT {K}, class, m.rate AS rate, h.rate AS baseline,
    (m.rate - h.rate) / nullif(1 - h.rate, 0) AS relative
  FROM (SELECT * FROM rates WHERE holdout = 0) m FULL OUTER JOIN
       (SELECT * FROM rates WHERE holdout = 1) h USING ({K}, class))
"""


def _share_predictions(real, synthetic):
    """`guess` and `probs` of the stage from the synthetic shares by age and sex."""
    groups = [*RUN, "age", "sex"]
    shares = synthetic.groupBy(*groups).agg(
        *[F.avg((F.col("stage") == s).cast("double")).alias(f"p_{s}") for s in STUDY.stages]
    )
    predictions = real.join(shares, groups, "left").withColumn(
        "probs", F.array(*[F.coalesce(F.col(f"p_{s}"), F.lit(0.0)) for s in STUDY.stages])
    )
    best = F.array_position("probs", F.array_max("probs"))
    guess = F.element_at(F.array(*[F.lit(s) for s in STUDY.stages]), best.cast("int"))
    return predictions.withColumn("guess", guess)


def _class_rates(spark, folder):
    """Share of each stage found at 1 % false alarms, for members and for held-out rows."""
    by = [*RUN, "holdout", "class"]
    long = attack.class_scores(
        _share_predictions(*attack_table(spark, folder)),
        [*RUN, "holdout", "id"], "stage", "probs", STUDY.stages,
    )
    found = attack.tpr_at_fpr(attack.roc_points(long, by, positive="hit"), by)
    rates = cut(
        found.select(
            *RUN, "holdout", F.col("tpr_3").alias("tpr"),
            F.when(F.col("class") == 999, 9).otherwise(F.col("class")).alias("class"),
        ),
        "rates",
    )
    return rates.filter("holdout = 0").drop("holdout"), rates.filter("holdout = 1").drop("holdout")


@case(
    "relative_accuracy",
    "site:s model:i sim:i class:i relative:f9",
    f"SELECT {K}, class, relative FROM gains",
    RATES_SQL,
)
def _(spark, folder):
    members, held_out = _class_rates(spark, folder)
    both = members.join(held_out.withColumnRenamed("tpr", "baseline"), [*RUN, "class"], "full")
    return both.withColumn("relative", attack.relative_rate("tpr", "baseline"))


@case(
    "attribute_inference_table",
    "site:s model:i " + " ".join(f"{k}_{c}:s" for c in (1, 2, 3, 9) for k in ("abs", "rel")),
    "SELECT site, model, "
    + ", ".join(
        f"max(CASE WHEN class = {c} THEN {k} END) AS {k}_{c}"
        for c in (1, 2, 3, 9)
        for k in ("abs", "rel")
    )
    + " FROM (SELECT site, model, class, printf('%.3f', avg(rate)) AS abs, "
    "printf('%.3f', avg(relative)) AS rel FROM gains GROUP BY ALL) GROUP BY ALL",
    RATES_SQL,
)
def _(spark, folder):
    return report.attribute_inference_table(*_class_rates(spark, folder))


@case(
    "attribute_scores",
    "site:s model:i sim:i class:i auc:f9 tpr_1:f9 tpr_2:f9 tpr_3:f9 accuracy:f9",
    f"SELECT {K}, class, auc, tpr_1, tpr_2, tpr_3, accuracy FROM attacked_c JOIN accuracies "
    f"USING ({K})",
    f"""{SHARES_SQL},
guesses AS (SELECT {K}, id, stage, class, row_number() OVER (PARTITION BY {K}, id
    ORDER BY score DESC, class) AS rn FROM class_scores),
accuracies AS (SELECT {K}, avg(CASE WHEN stage = class THEN 1 ELSE 0 END) AS accuracy
    FROM guesses WHERE rn = 1 GROUP BY ALL),
by_score AS (SELECT {K}, class, score, count_if(stage = class) AS pos,
    count_if(stage <> class) AS neg FROM class_scores GROUP BY ALL),
roc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    CAST(sum(pos) OVER g AS DOUBLE) AS p, CAST(sum(neg) OVER g AS DOUBLE) AS n FROM by_score
  WINDOW w AS (PARTITION BY {K}, class ORDER BY score DESC), g AS (PARTITION BY {K}, class)),
attacked_c AS (SELECT {K}, class, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / any_value(p * n)
    AS auc, coalesce(max(tp / p) FILTER (fp / n <= 0), 0) AS tpr_1,
    coalesce(max(tp / p) FILTER (fp / n <= 0.001::DOUBLE), 0) AS tpr_2,
    coalesce(max(tp / p) FILTER (fp / n <= 0.01::DOUBLE), 0) AS tpr_3 FROM roc GROUP BY ALL)
""",
)
def _(spark, folder):
    """One-vs-rest measures of the stage guess."""
    real, synthetic = real_and_synthetic(spark, folder)
    predictions = _share_predictions(real, synthetic)
    long = attack.class_scores(predictions, [*RUN, "id"], "stage", "probs", STUDY.stages)
    by = [*RUN, "class"]
    points = attack.roc_points(long, by, positive="hit")
    return (
        attack.roc_auc(points, by)
        .join(attack.tpr_at_fpr(points, by), by)
        .join(attack.accuracy(predictions, list(RUN), "stage", "guess"), list(RUN))
    )
