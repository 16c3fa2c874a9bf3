"""Sources, cohort preparation, joins and row multiplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncohort.functions.columns import (
    age_group,
    format_day,
    format_fixed,
    format_interval,
    format_scientific,
    parse_day,
    recode,
    recode_missing,
    restore_missing,
    year_group,
)
from syncohort.lineage import scratch_path
from syncohort.operators import cohort as ops
from syncohort.operators.distance import exact_match
from syncohort.operators.report import report_rows
from syncohort.operators.stats import merge_results, percentile_type2
from syncohort.plans.cases import case
from syncohort.plans.derived import (
    MODELS,
    STUDY,
    attack_table,
    cohort,
    real_and_synthetic,
    registry,
    run_table,
)
from syncohort.settings import MODEL_LABELS, RUN, STAGE_LABELS, StudySettings
from syncohort.sources.files import (
    read_cohort,
    read_metric_matrix,
    read_table,
    write_cohort_csv,
    write_metric_matrix,
    write_report_rows,
    write_table,
)
from syncohort.sources.schemas import HOLDOUT_CSV

STAGE_SQL = "CASE WHEN stage = 999 THEN 9 ELSE stage END"


@case(
    "read_cohort",
    "site:s model:i sim:i id:i age:i sex:i stage:i daar:i daar_grp:i diag_date:s exit:s "
    "status:i t:f9 holdout:i",
    f"SELECT *, {STAGE_SQL} AS stage FROM runs WHERE synth = 0".replace(
        "SELECT *", "SELECT * EXCLUDE (stage)"
    ),
)
def _(spark, folder):
    """All runs written as partitioned CSV folders and read back with their schema."""
    path = scratch_path(spark, "cohort")
    real, _ = attack_table_with_dates(spark, folder)
    write_cohort_csv(real, path)
    return read_cohort(spark, path, HOLDOUT_CSV, run_partitions=True, missing_stage=9)


def attack_table_with_dates(spark, folder):
    table = run_table(spark, folder).withColumn(
        "holdout", (F.col("id") % 5 == 0).cast("int")
    )
    return table.filter("synth = 0"), table.filter("synth = 1")


def _run_sizes(spark, folder):
    return run_table(spark, folder).groupBy("model", "sim").agg(
        F.avg(F.col("t") * F.col("synth")).alias("value")
    )


RUN_SIZES_SQL = "SELECT model, sim, avg(t * synth) AS value FROM runs GROUP BY model, sim"


@case("read_metric_matrix", "sim:i model:i value:f9", RUN_SIZES_SQL)
def _(spark, folder):
    """A run matrix written without header and read back as a long table."""
    path = scratch_path(spark, "matrix")
    write_metric_matrix(_run_sizes(spark, folder), path, MODELS)
    return read_metric_matrix(spark, f"{path}/*.csv", MODELS)


@case(
    "class_metric_matrix",
    "sim:i class:i model:i value:f9",
    f"SELECT sim, {STAGE_SQL} AS class, model, avg(t) AS value FROM runs WHERE synth = 1 "
    "GROUP BY sim, class, model",
)
def _(spark, folder):
    """The run matrix whose first column is a class."""
    path = scratch_path(spark, "class_matrix")
    values = (
        run_table(spark, folder)
        .filter("synth = 1")
        .groupBy("model", "sim", recode("stage", {999: 9}).alias("class"))
        .agg(F.avg("t").alias("value"))
    )
    write_metric_matrix(values, path, MODELS, klass="class")
    return read_metric_matrix(spark, f"{path}/*.csv", MODELS, classes=4)


@case(
    "partitioned_tables",
    "site:s model:i sim:i persons:i",
    "SELECT site, model, sim, count(*) AS persons FROM runs WHERE synth = 1 AND model = 1 "
    "GROUP BY site, model, sim",
)
def _(spark, folder):
    """Runs stored by site, model and sim; a model is read by pruning folders."""
    path = scratch_path(spark, "runs")
    write_table(run_table(spark, folder).filter("synth = 1"), path)
    return read_table(spark, path).filter("model = 1").groupBy(*RUN).agg(
        F.count("*").alias("persons")
    )


@case(
    "report_rows",
    "str:s",
    "SELECT ' & ' || CASE model WHEN 0 THEN 'Indep. marginals' ELSE 'Model 1' END || ' & ' || "
    "printf('%.3f', avg(t)) || ' & ' || printf('%.3f', avg(age)) || ' \\\\' AS str "
    "FROM runs WHERE synth = 1 GROUP BY model",
)
def _(spark, folder):
    """One text row per model, written and read back."""
    table = (
        run_table(spark, folder)
        .filter("synth = 1")
        .groupBy("model")
        .agg(
            format_fixed(F.avg("t")).alias("mean_t"), format_fixed(F.avg("age")).alias("mean_age")
        )
    )
    path = scratch_path(spark, "report")
    write_report_rows(report_rows(table, ["mean_t", "mean_age"]), path)
    return spark.read.text(path).withColumnRenamed("value", "str")


@case(
    "cohort_filter",
    "id:i diag_date:s age:i sex:i stage:i vital:s",
    "SELECT * FROM registry WHERE vital <> 'E' AND year(diag_date) BETWEEN 1995 AND 1999 "
    "AND diag_date < DATE '1999-12-31' AND age <= 80",
)
def _(spark, folder):
    """Emigration, study window and age cap on the raw registry."""
    capped = StudySettings(start_year=1995, end_year=1999, cutoff="1999-12-31", max_age=80)
    return ops.filter_registry(registry(spark, folder), capped)


@case("prepare_cohort", "id:i age:i sex:i stage:i daar:i daar_grp:i diag_date:s exit:s "
      "status:i t:f9", "SELECT * FROM cohort")
def _(spark, folder):
    """The whole preparation."""
    return cohort(spark, folder)


@case(
    "harmonise_columns",
    "id:i sex:i daar:i",
    "SELECT id, sex, year(diag_date) AS daar FROM registry",
)
def _(spark, folder):
    """Other field names and a letter for sex."""
    raw = registry(spark, folder).select(
        "id",
        F.when(F.col("sex") == 1, "M").otherwise("K").alias("P_sex"),
        F.year("diag_date").alias("S_year"),
    )
    return ops.harmonise(raw, {"P_sex": "sex", "S_year": "daar"}, male="M")


@case(
    "recode_missing",
    "id:i stage_999:i stage_9:i stage_null:i",
    "SELECT id, coalesce(stage, 999) AS stage_999, coalesce(stage, 9) AS stage_9, "
    "nullif(coalesce(stage, 9), 9) AS stage_null FROM registry",
)
def _(spark, folder):
    return registry(spark, folder).select(
        "id",
        recode_missing("stage").alias("stage_999"),
        recode(recode_missing("stage"), {999: 9}).alias("stage_9"),
        restore_missing(recode_missing("stage", 9), (9, 999)).alias("stage_null"),
    )


@case(
    "year_bin",
    "id:i daar:i two:i five:i",
    "SELECT id, year(diag_date) AS daar, year(diag_date) - year(diag_date) % 2 AS two, "
    "year(diag_date) - year(diag_date) % 5 AS five FROM registry",
)
def _(spark, folder):
    year = F.year("diag_date")
    return registry(spark, folder).select(
        "id", year.alias("daar"), year_group(year).alias("two"), year_group(year, 5).alias("five")
    )


@case(
    "administrative_censoring",
    "id:i vital:s vital_date:s",
    "SELECT id, CASE WHEN vital_date IS NULL OR vital_date > DATE '1999-12-31' THEN 'B' "
    "ELSE vital END AS vital, least(coalesce(vital_date, DATE '1999-12-31'), "
    "DATE '1999-12-31') AS vital_date FROM (SELECT id, vital, CASE WHEN age < 45 THEN NULL "
    "ELSE vital_date END AS vital_date FROM registry)",
)
def _(spark, folder):
    """Including persons without a status date."""
    extract = registry(spark, folder).withColumn(
        "vital_date", F.when(F.col("age") >= 45, F.col("vital_date"))
    )
    return ops.administrative_censoring(extract, STUDY)


@case(
    "status_decode",
    "id:i status:i letter:s",
    "SELECT id, CASE WHEN vital = 'D' THEN 1 ELSE 0 END AS status, "
    "CASE WHEN vital = 'D' THEN 'D' ELSE 'B' END AS letter FROM registry",
)
def _(spark, folder):
    flagged = ops.event_flag(registry(spark, folder))
    return flagged.withColumn("letter", ops.status_letter())


@case(
    "surrogate_id",
    "id:i new_id:i in_stage:i",
    "SELECT id, row_number() OVER (ORDER BY diag_date, id) AS new_id, "
    "row_number() OVER (PARTITION BY stage ORDER BY diag_date, id) AS in_stage FROM cohort",
)
def _(spark, folder):
    """Consecutive numbers along a stated order, overall and per stage."""
    numbered = ops.with_surrogate_id(cohort(spark, folder), ["diag_date", "id"], name="new_id")
    return ops.with_surrogate_id(numbered, ["diag_date", "id"], ["stage"], "in_stage")


@case("survival_set", "id:i status:i exit:s t:f9",
      "SELECT id, CASE WHEN vital = 'D' AND vital_date <= DATE '1999-12-31' THEN 1 ELSE 0 END "
      "AS status, least(vital_date, DATE '1999-12-31') AS exit, "
      "date_diff('day', diag_date, least(vital_date, DATE '1999-12-31')) / 365.25::DOUBLE AS t "
      "FROM registry WHERE least(vital_date, DATE '1999-12-31') > diag_date")
def _(spark, folder):
    flagged = ops.event_flag(registry(spark, folder)).withColumn("exit", F.col("vital_date"))
    return ops.survival_set(flagged, STUDY)


@case(
    "date_parse",
    "id:i text:s day:s",
    "SELECT id, lower(strftime(diag_date, '%d%b%Y')) AS text, diag_date AS day FROM registry",
)
def _(spark, folder):
    text = registry(spark, folder).select("id", format_day("diag_date").alias("text"))
    return text.withColumn("day", parse_day("text"))


@case(
    "date_delta",
    "site:s model:i sim:i id:i diag_date_delta:i exit_delta:i",
    "SELECT *, date_diff('day', min(diag_date) OVER w, diag_date) AS diag_date_delta, "
    "date_diff('day', min(exit) OVER w, exit) AS exit_delta FROM runs "
    "WINDOW w AS (PARTITION BY site, model, sim)",
)
def _(spark, folder):
    return ops.with_run_minimum_delta(run_table(spark, folder))


@case(
    "age_group",
    "age_grp:i persons:i",
    "SELECT CASE WHEN age <= 0 THEN 0 WHEN age <= 40 THEN 1 WHEN age <= 50 THEN 2 "
    "WHEN age <= 60 THEN 3 WHEN age <= 70 THEN 4 WHEN age <= 80 THEN 5 ELSE 6 END AS age_grp, "
    "count(*) AS persons FROM registry GROUP BY 1",
)
def _(spark, folder):
    return registry(spark, folder).groupBy(age_group("age").alias("age_grp")).agg(
        F.count("*").alias("persons")
    )


@case(
    "equal_width_bin",
    "site:s model:i sim:i id:i age_grp:i t_grp:i",
    "SELECT *, floor(age / ((max(age) OVER w - min(age) OVER w) / 19.0::DOUBLE)) AS age_grp, "
    "floor(t / ((max(t) OVER w - min(t) OVER w) / 19.0::DOUBLE)) AS t_grp FROM runs "
    "WINDOW w AS (PARTITION BY site, model, sim)",
)
def _(spark, folder):
    return ops.with_equal_width_bins(run_table(spark, folder), ["age", "t"])


@case(
    "group_id",
    "id:i grp:i",
    "SELECT id, dense_rank() OVER (ORDER BY age, sex, stage) AS grp FROM cohort",
)
def _(spark, folder):
    return ops.with_group_id(cohort(spark, folder), ["age", "sex", "stage"])


@case(
    "decode_labels",
    "stage:i label:s mod:s persons:i",
    "SELECT stage, CASE stage WHEN 1 THEN 'Localised' WHEN 2 THEN 'Regional' "
    "WHEN 3 THEN 'Distant' END AS label, CASE model WHEN 0 THEN 'Indep. marginals' "
    "WHEN 1 THEN 'Model 1' END AS mod, count(*) AS persons FROM runs GROUP BY stage, model",
)
def _(spark, folder):
    counts = run_table(spark, folder).groupBy("stage", "model").agg(F.count("*").alias("persons"))
    named = ops.decode_labels(counts, "stage", STAGE_LABELS, "label")
    return ops.decode_labels(named, "model", MODEL_LABELS, "mod")


TYPE2_SQL = """
    avg(CASE WHEN rn BETWEEN greatest((n * {p} + 99) // 100, 1)
                  AND least((n * {p}) // 100 + 1, n) THEN x END)"""


@case(
    "winsorize",
    "id:i age_adj:f6 t_adj:f9 t_range:f9",
    "SELECT id, greatest(least(age, (SELECT hi FROM la)), (SELECT lo FROM la)) AS age_adj, "
    "greatest(least(t, (SELECT hi FROM lt)), (SELECT lo FROM lt)) AS t_adj, t AS t_range "
    "FROM cohort",
    ctes=f"""
la AS (SELECT {TYPE2_SQL.format(p=5)} AS lo, {TYPE2_SQL.format(p=95)} AS hi FROM
  (SELECT age AS x, row_number() OVER (ORDER BY age) AS rn, count(*) OVER () AS n FROM cohort)),
lt AS (SELECT {TYPE2_SQL.format(p=5)} AS lo, {TYPE2_SQL.format(p=95)} AS hi FROM
  (SELECT t AS x, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM cohort))
""",
)
def _(spark, folder):
    clipped = ops.winsorize(cohort(spark, folder), ["age", "t"], 5)
    unclipped = clipped.withColumnRenamed("t_adj", "t5").withColumnRenamed("age_adj", "age5")
    full = ops.winsorize(unclipped, ["t"], 0)
    return full.select("id", F.col("age5").alias("age_adj"), F.col("t5").alias("t_adj"),
                       F.col("t_adj").alias("t_range"))


@case(
    "one_hot",
    "id:i stage_1:i stage_2:i stage_3:i stage_999:i",
    "SELECT id, " + ", ".join(
        f"CASE WHEN stage = {s} THEN 1 ELSE 0 END AS stage_{s}" for s in (1, 2, 3, 999)
    ) + " FROM cohort",
)
def _(spark, folder):
    return ops.one_hot(cohort(spark, folder), "stage", STUDY.stages)


@case(
    "ordinal_encode",
    "site:s model:i sim:i id:i age_code:i",
    "SELECT r.*, coalesce(code, 99) AS age_code FROM runs r LEFT JOIN (SELECT site, model, sim, "
    "age, dense_rank() OVER (PARTITION BY site, model, sim ORDER BY age) - 1 AS code FROM "
    "(SELECT DISTINCT site, model, sim, age FROM runs WHERE synth = 1 AND sex = 1)) c "
    "USING (site, model, sim, age) WHERE synth = 0",
)
def _(spark, folder):
    """Codes fitted on the synthetic rows of one sex, applied to the real ones."""
    real, synthetic = real_and_synthetic(spark, folder)
    fitted = synthetic.filter("sex = 1")
    return ops.ordinal_encode(real, "age", fitted, "age_code", RUN, unknown=99)


@case(
    "standard_scale",
    "site:s model:i sim:i id:i age_z:f9 t_z:f9",
    "SELECT r.*, (age - ma) / sa AS age_z, (t - mt) / st AS t_z FROM runs r JOIN "
    "(SELECT site, model, sim, avg(age) AS ma, stddev_pop(age) AS sa, avg(t) AS mt, "
    "stddev_pop(t) AS st FROM runs WHERE synth = 1 GROUP BY site, model, sim) "
    "USING (site, model, sim) WHERE synth = 0",
)
def _(spark, folder):
    real, synthetic = real_and_synthetic(spark, folder)
    return ops.standard_scale(real, ["age", "t"], synthetic)


@case(
    "range_scale",
    "site:s model:i sim:i id:i age_scaled:f9 t_scaled:f9 one_scaled:f9",
    "SELECT *, (age - min(age) OVER w) / CAST(max(age) OVER w - min(age) OVER w AS DOUBLE) "
    "AS age_scaled, (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) AS t_scaled, "
    "0 AS one_scaled FROM runs WINDOW w AS (PARTITION BY site, model, sim)",
)
def _(spark, folder):
    real, synthetic = (
        f.withColumn("one", F.lit(1)) for f in real_and_synthetic(spark, folder)
    )
    both = real.unionByName(synthetic)
    return ops.range_scale(both, ["age", "t", "one"], [real, synthetic])


@case(
    "data_contract",
    "site:s model:i sim:i rule:s violations:i",
    "SELECT site, model, sim, rule, CASE rule WHEN 'stage_out_of_range' THEN "
    "count_if(stage = 999) ELSE 0 END AS violations FROM runs, (SELECT unnest(["
    "'sequence_missing', 'stage_out_of_range', 'diagnosis_not_before_cutoff', "
    "'status_not_binary', 'no_follow_up']) AS rule) GROUP BY site, model, sim, rule",
)
def _(spark, folder):
    """Violations per rule; with 9 for missing, 999 is out of range."""
    nine = StudySettings(start_year=1995, end_year=1999, cutoff="1999-12-31", stages=(1, 2, 3, 9))
    return ops.data_contract(run_table(spark, folder), nine)


@case(
    "format_interval",
    "stage:i fixed:s scientific:s",
    "SELECT stage, printf('%.3f', avg(t)) || ' (' || printf('%.3f', min(t)) || ', ' || "
    "printf('%.3f', max(t)) || ')' AS fixed, printf('%.1e', avg(t) / 1000) AS scientific "
    "FROM cohort GROUP BY stage",
)
def _(spark, folder):
    return cohort(spark, folder).groupBy("stage").agg(
        format_interval(
            format_fixed(F.avg("t")), format_fixed(F.min("t")), format_fixed(F.max("t"))
        ).alias("fixed"),
        format_scientific(F.avg("t") / 1000.0).alias("scientific"),
    )


@case(
    "union_with_source",
    "site:s model:i sim:i id:i synth:i holdout:i",
    "SELECT site, model, sim, id, synth, CASE WHEN synth = 0 THEN holdout END AS holdout "
    "FROM runs",
)
def _(spark, folder):
    real, synthetic = attack_table(spark, folder)
    return ops.union_with_source(real, synthetic)


@case(
    "merge_results",
    "model:i sim:i deaths:i males:i",
    "SELECT coalesce(a.model, b.model) AS model, coalesce(a.sim, b.sim) AS sim, deaths, males "
    "FROM (SELECT model, sim, sum(status) AS deaths FROM runs WHERE sim < 3 GROUP BY ALL) a "
    "FULL OUTER JOIN (SELECT model, sim, sum(sex) AS males FROM runs WHERE sim > 1 "
    "GROUP BY ALL) b ON a.model = b.model AND a.sim = b.sim",
)
def _(spark, folder):
    """Two result tables, runs missing on one side kept."""
    runs = run_table(spark, folder)
    left = runs.filter("sim < 3").groupBy("model", "sim").agg(F.sum("status").alias("deaths"))
    right = runs.filter("sim > 1").groupBy("model", "sim").agg(F.sum("sex").alias("males"))
    return merge_results(left, right, ["model", "sim"])


@case(
    "lookup_join",
    "id:i age:i share:f9",
    "SELECT id, cohort.age, share FROM cohort JOIN (SELECT age, count(*) / "
    "CAST((SELECT count(*) FROM registry) AS DOUBLE) AS share FROM registry GROUP BY age) a "
    "ON cohort.age = a.age",
)
def _(spark, folder):
    """Age shares of the registry looked up for the cohort; lookup-only ages are dropped."""
    people = registry(spark, folder)
    everyone = people.agg(F.count("*").alias("all")).withColumn("_one", F.lit(1))
    shares = (
        people.groupBy("age").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
        .join(everyone, "_one")
        .select("age", (F.col("n") / F.col("all")).alias("share"))
    )
    return ops.lookup_join(cohort(spark, folder), shares, ["age"])


@case(
    "unmatched_rows",
    "id:i age:i sex:i stage:i",
    "SELECT id, age, sex, stage FROM cohort c WHERE NOT EXISTS (SELECT 1 FROM cohort d "
    "WHERE d.daar < 1997 AND d.age = c.age AND d.sex = c.sex AND d.stage = c.stage)",
)
def _(spark, folder):
    """Contract check: patterns not seen before 1997."""
    people = cohort(spark, folder)
    return ops.unmatched_rows(people, people.filter("daar < 1997"), ["age", "sex", "stage"])


@case(
    "cross_grid",
    "id:i stage_candidate:i h:i",
    "SELECT id, stage_candidate, h FROM cohort, (SELECT unnest([1, 2, 3, 999]) AS "
    "stage_candidate), (SELECT unnest(range(1, 6)) AS h)",
)
def _(spark, folder):
    """Every person with every candidate value and draw."""
    return ops.cross_grid(
        cohort(spark, folder).select("id"),
        {
            "stage_candidate": F.array(*[F.lit(s) for s in STUDY.stages]),
            "h": F.sequence(F.lit(1), F.lit(5)),
        },
    )


@case(
    "expand_rows",
    "id:i copy:i twin:i",
    "SELECT id, copy, twin FROM (SELECT id, unnest(range(1, stage + 1)) AS copy FROM cohort "
    "WHERE stage < 9), (SELECT unnest([1, 2]) AS twin)",
)
def _(spark, folder):
    """As many copies as the stage says, then each twice."""
    people = cohort(spark, folder).filter("stage < 9").select("id", "stage")
    return ops.expand_rows(ops.expand_rows(people, "stage"), 2, "twin")


@case(
    "exact_match",
    "site:s model:i sim:i id:i",
    "SELECT s.site, s.model, s.sim, s.id FROM runs s WHERE synth = 1 AND EXISTS (SELECT 1 "
    "FROM runs r WHERE r.synth = 0 AND r.model = s.model AND r.sim = s.sim AND r.age = s.age "
    "AND r.sex = s.sex AND nullif(r.stage, 999) IS NOT DISTINCT FROM nullif(s.stage, 999) "
    "AND r.daar = s.daar AND r.status = s.status)",
)
def _(spark, folder):
    """Synthetic rows that repeat a real row; a missing value equals a missing value."""
    real, synthetic = (
        f.withColumn("stage", restore_missing("stage")) for f in real_and_synthetic(spark, folder)
    )
    # `ims` matches on all features of the study, which no row here does.
    return exact_match(real, synthetic, ["age", "sex", "stage", "daar", "status"])


_FEATURES = (*STUDY.numeric, *STUDY.categorical)


@case(
    "exact_match_features",
    "site:s model:i sim:i id:i",
    "SELECT s.site, s.model, s.sim, s.id FROM (SELECT * FROM attack WHERE synth = 1 UNION ALL "
    "SELECT * FROM attack WHERE synth = 0 AND id % 10 = 0) s WHERE EXISTS (SELECT 1 FROM attack r "
    "WHERE r.synth = 0 AND r.model = s.model AND r.sim = s.sim AND "
    + " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in _FEATURES)
    + ")",
)
def _(spark, folder):
    """Matches on all features of the study, in a synthetic table that leaked some real rows."""
    real, synthetic = attack_table(spark, folder)
    leaked = real.filter("id % 10 = 0").drop("holdout")
    return exact_match(real, synthetic.unionByName(leaked), list(_FEATURES))


@case(
    "holdout_subsets",
    "site:s model:i sim:i part:s persons:i",
    "SELECT site, model, sim, CASE holdout WHEN 1 THEN 'held out' ELSE 'member' END AS part, "
    "count(*) AS persons FROM runs WHERE synth = 0 GROUP BY ALL",
)
def _(spark, folder):
    members, held_out = ops.split_holdout(attack_table(spark, folder)[0])
    both = members.withColumn("part", F.lit("member")).unionByName(
        held_out.withColumn("part", F.lit("held out"))
    )
    return both.groupBy(*RUN, "part").agg(F.count("*").alias("persons"))


@case(
    "coalescing_join",
    "id:i t_filled:f9",
    "SELECT a.id, coalesce(a.t, b.t) AS t_filled FROM (SELECT id, CASE WHEN stage <> 1 THEN t END "
    "AS t FROM cohort) a LEFT JOIN (SELECT id, t FROM cohort WHERE sex = 1) b ON a.id = b.id",
)
def _(spark, folder):
    """Only missing cells are filled from the second table."""
    people = cohort(spark, folder)
    first = people.select("id", F.when(F.col("stage") != 1, F.col("t")).alias("t"))
    second = people.filter("sex = 1").select("id", F.col("t").alias("_t2"))
    return first.join(second, "id", "left").select(
        "id", F.coalesce("t", "_t2").alias("t_filled")
    )


@case(
    "percentile_type2",
    "stage:i p5:f9 p25:f9 p50:f9 p95:f9",
    "SELECT stage, " + ", ".join(f"{TYPE2_SQL.format(p=p)} AS p{p}" for p in (5, 25, 50, 95))
    + " FROM (SELECT stage, t AS x, row_number() OVER (PARTITION BY stage ORDER BY t) AS rn, "
    "count(*) OVER (PARTITION BY stage) AS n FROM cohort) GROUP BY stage",
)
def _(spark, folder):
    return percentile_type2(
        cohort(spark, folder), ["stage"], "t", {"p5": 5, "p25": 25, "p50": 50, "p95": 95}
    )
