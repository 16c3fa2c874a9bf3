"""Aggregation, pivoting, windows and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncohort.operators import stats
from syncohort.operators.survival import exits_by_day, risk_set
from syncohort.plans.cases import case
from syncohort.plans.derived import MODELS, cohort, run_table
from syncohort.settings import RUN
from syncohort.sources.files import matrix_from_metrics, unpivot_matrix

METRICS_SQL = """
metrics AS (SELECT site, model, sim, avg(t) AS value FROM runs WHERE synth = 1 GROUP BY ALL),
class_metrics AS (SELECT site, model, sim, stage, avg(t) AS value, avg(status) AS rate
                  FROM runs WHERE synth = 1 GROUP BY ALL)
"""


def _metrics(spark, folder):
    """One value per run."""
    rows = run_table(spark, folder).filter("synth = 1")
    return rows.groupBy(*RUN).agg(F.avg("t").alias("value"))


def _class_metrics(spark, folder):
    rows = run_table(spark, folder).filter("synth = 1")
    return rows.groupBy(*RUN, "stage").agg(
        F.avg("t").alias("value"), F.avg("status").alias("rate")
    )


def _type2(p: int) -> str:
    return (
        f"avg(CASE WHEN rn BETWEEN greatest((n * {p} + 99) // 100, 1) AND "
        f"least((n * {p}) // 100 + 1, n) THEN value END)"
    )


@case(
    "metric_summary_median_iqr",
    "site:s model:i stage:i med:f9 p25:f9 p75:f9 text:s",
    "SELECT *, printf('%.3f', med) || ' (' || printf('%.3f', p25) || ', ' || "
    "printf('%.3f', p75) || ')' AS text FROM (SELECT site, model, stage, "
    f"{_type2(50)} AS med, {_type2(25)} AS p25, {_type2(75)} AS p75 FROM (SELECT *, "
    "row_number() OVER (PARTITION BY site, model, stage ORDER BY value) AS rn, "
    "count(*) OVER (PARTITION BY site, model, stage) AS n FROM class_metrics) GROUP BY ALL)",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.summary_median_iqr(
        _class_metrics(spark, folder), ["site", "model", "stage"], "value", 3
    )


@case(
    "metric_summary_median_range",
    "site:s model:i med:f9 low:f9 high:f9",
    "SELECT site, model, median(value) AS med, min(value) AS low, max(value) AS high "
    "FROM metrics GROUP BY ALL",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.summary_median_range(_metrics(spark, folder), ["site", "model"], "value")


@case(
    "sum_by_run",
    "site:s model:i sim:i value:f9",
    "SELECT site, model, sim, sum(value) AS value FROM class_metrics GROUP BY ALL",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.sum_by_run(_class_metrics(spark, folder), RUN, "value")


@case(
    "mean_by_model_class",
    "site:s model:i stage:i mean_value:f9 mean_rate:f9",
    "SELECT site, model, stage, avg(value) AS mean_value, avg(rate) AS mean_rate "
    "FROM class_metrics GROUP BY ALL",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.mean_by(
        _class_metrics(spark, folder), ["site", "model", "stage"], ["value", "rate"]
    )


@case(
    "metric_mean_sd",
    "site:s model:i mean:f9 sd:f9 ylim_low:f9 ylim_high:f9",
    "SELECT *, min(mean - sd) OVER (PARTITION BY site) AS ylim_low, max(mean + sd) OVER "
    "(PARTITION BY site) AS ylim_high FROM (SELECT site, model, avg(value) AS mean, "
    "stddev_pop(value) AS sd FROM metrics GROUP BY ALL)",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.metric_mean_sd(_metrics(spark, folder), ["site"], "model", "value")


@case(
    "class_metric_mean_sd",
    "site:s model:i mean:f9 sd:f9",
    "SELECT * FROM (SELECT site, model, avg(m) AS mean FROM (SELECT site, model, stage, "
    "avg(value) AS m FROM class_metrics GROUP BY ALL) GROUP BY ALL) JOIN (SELECT site, model, "
    "stddev_pop(m) AS sd FROM (SELECT site, model, sim, avg(value) AS m FROM class_metrics "
    "GROUP BY ALL) GROUP BY ALL) USING (site, model)",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.class_metric_mean_sd(
        _class_metrics(spark, folder), ["site"], "model", "sim", "stage", "value"
    )


@case(
    "two_way_counts",
    "site:s model:i sim:i stage:i n_real:i n_synth:i",
    "SELECT site, model, sim, stage, count_if(synth = 0) AS n_real, count_if(synth = 1) AS "
    "n_synth FROM runs GROUP BY ALL",
)
def _(spark, folder):
    return stats.two_way_counts(run_table(spark, folder), RUN, "stage")


@case(
    "describe",
    "stage:i variable:s n:i min:f9 max:f9 mean:f9 levels:i",
    " UNION ALL ".join(
        f"SELECT stage, '{c}' AS variable, count({c}) AS n, min({c}) AS min, max({c}) AS max, "
        f"avg({c}) AS mean, count(DISTINCT {c}) AS levels FROM cohort GROUP BY stage"
        for c in ("age", "daar_grp", "t")
    ),
)
def _(spark, folder):
    return stats.describe(cohort(spark, folder), ["stage"], ["age", "daar_grp", "t"])


@case(
    "correlation_matrix",
    "site:s model:i sim:i synth:i a:s b:s r:f9",
    " UNION ALL ".join(
        f"SELECT site, model, sim, synth, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r "
        "FROM runs GROUP BY ALL"
        for a, b in (
            ("age", "sex"), ("age", "t"), ("age", "status"), ("sex", "t"), ("sex", "status"),
            ("t", "status"),
        )
    ),
)
def _(spark, folder):
    return stats.correlation_matrix(
        run_table(spark, folder), [*RUN, "synth"], ["age", "sex", "t", "status"]
    )


@case(
    "pivot_metrics",
    "sim:i m0:f9 m1:f9",
    "SELECT sim, max(CASE WHEN model = 0 THEN value END) AS m0, "
    "max(CASE WHEN model = 1 THEN value END) AS m1 FROM metrics GROUP BY sim",
    METRICS_SQL,
)
def _(spark, folder):
    wide = matrix_from_metrics(_metrics(spark, folder), MODELS)
    return wide.select("sim", F.col("0").alias("m0"), F.col("1").alias("m1"))


@case(
    "unpivot_runs",
    "sim:i model:i value:f9",
    "SELECT sim, model, value FROM metrics",
    METRICS_SQL,
)
def _(spark, folder):
    return unpivot_matrix(matrix_from_metrics(_metrics(spark, folder), MODELS), ["sim"], MODELS)


@case(
    "separate_by_model",
    "sim:i stage:i value0:f9 value1:f9",
    "SELECT sim, stage, max(CASE WHEN model = 0 THEN value END) AS value0, "
    "max(CASE WHEN model = 1 THEN value END) AS value1 FROM class_metrics GROUP BY sim, stage",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.separate_by_model(
        _class_metrics(spark, folder), ["sim", "stage"], "value", range(MODELS)
    )


@case(
    "row_min_max",
    "id:i low:f9 high:f9",
    "SELECT id, least(age / 10.0::DOUBLE, t, daar - 1990) AS low, "
    "greatest(age / 10.0::DOUBLE, t, daar - 1990) AS high FROM cohort",
)
def _(spark, folder):
    people = cohort(spark, folder).select(
        "id", (F.col("age") / 10.0).alias("a"), "t", (F.col("daar") - 1990.0).alias("d")
    )
    low, high = stats.row_range(["a", "t", "d"])
    return people.select("id", low.alias("low"), high.alias("high"))


@case(
    "row_cumulative_total",
    "sex:i stage:i p:f9 cum:f9",
    "SELECT sex, stage, p, sum(p) OVER (PARTITION BY sex ORDER BY stage) AS cum FROM "
    "(SELECT sex, stage, count(*) / sum(count(*)) OVER (PARTITION BY sex) AS p FROM cohort "
    "GROUP BY sex, stage)",
)
def _(spark, folder):
    counts = cohort(spark, folder).groupBy("sex", "stage").agg(F.count("*").alias("n"))
    shares = stats.with_group_stats(counts, ["sex"], {"all": F.sum("n")}).withColumn(
        "p", F.col("n") / F.col("all")
    )
    return stats.with_running_probability(shares, ["sex"], "stage", "p")


@case(
    "group_stat_on_rows",
    "id:i total:f6 top:f9 mean:f9",
    "SELECT id, sum(t) OVER w AS total, max(t) OVER w AS top, avg(t) OVER w AS mean "
    "FROM cohort WINDOW w AS (PARTITION BY stage, sex)",
)
def _(spark, folder):
    return stats.with_group_stats(
        cohort(spark, folder),
        ["stage", "sex"],
        {"total": F.sum("t"), "top": F.max("t"), "mean": F.avg("t")},
    )


@case(
    "first_last_in_group",
    "stage:i first:f9 last:f9",
    "SELECT stage, first(t ORDER BY diag_date, id) AS first, last(t ORDER BY diag_date, id) "
    "AS last FROM cohort GROUP BY stage",
)
def _(spark, folder):
    return stats.first_last(cohort(spark, folder), ["stage"], ["diag_date", "id"], "t")


@case(
    "dedupe_first",
    "age:i sex:i stage:i id:i t:f9",
    "SELECT age, sex, stage, id, t FROM (SELECT *, row_number() OVER (PARTITION BY age, sex, "
    "stage ORDER BY id) AS rn FROM cohort) WHERE rn = 1",
)
def _(spark, folder):
    return stats.dedupe_first(cohort(spark, folder), ["age", "sex", "stage"], ["id"], ["t"])


@case(
    "risk_set",
    "stage:i t:f9 events:i at_risk:i",
    "SELECT stage, t, sum(status) AS events, sum(count(*)) OVER (PARTITION BY stage "
    "ORDER BY t DESC) AS at_risk FROM cohort GROUP BY stage, t",
)
def _(spark, folder):
    return risk_set(exits_by_day(cohort(spark, folder), ["stage"]), ["stage"])


@case(
    "top_k_smallest",
    "stage:i rank:i id:i t:f9",
    "SELECT stage, rank, id, t FROM (SELECT *, row_number() OVER (PARTITION BY stage "
    "ORDER BY t, id) AS rank FROM cohort) WHERE rank <= 5",
)
def _(spark, folder):
    return stats.top_k(cohort(spark, folder), ["stage"], [F.col("t"), F.col("id")], 5)


@case(
    "median_run_per_model",
    "site:s model:i sim:i value:f9 med:f9",
    "SELECT site, model, sim, value, med FROM (SELECT *, row_number() OVER (PARTITION BY site, "
    "model ORDER BY abs(value - med), sim) AS rn FROM (SELECT *, median(value) OVER "
    "(PARTITION BY site, model) AS med FROM metrics)) WHERE rn = 1",
    METRICS_SQL,
)
def _(spark, folder):
    return stats.median_run(_metrics(spark, folder), ["site", "model"], "value")


@case(
    "riskiest_record",
    "stage:i id:i t:f9",
    "SELECT stage, id, t FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY t DESC, "
    "id) AS rn FROM cohort) WHERE rn = 1",
)
def _(spark, folder):
    """The record with the largest value of each group, as an aggregate."""
    return cohort(spark, folder).groupBy("stage").agg(
        F.max(F.struct("t", (-F.col("id")).alias("neg_id"))).alias("best")
    ).select("stage", (-F.col("best.neg_id")).alias("id"), "best.t")
