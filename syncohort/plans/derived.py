"""A registry extract and synthetic runs derived from the supplied star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncohort.lineage import cut
from syncohort.operators.cohort import prepare_cohort, with_run_minimum_delta
from syncohort.settings import RUN, StudySettings

STUDY = StudySettings(start_year=1995, end_year=1999, cutoff="1999-12-31")
MODELS = 2
SIMS = 3


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """One person per order, all vital states and years."""
    lines = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("ship"), F.min("l_partkey").alias("partkey")
    )
    customers = load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    parts = load(spark, folder, "part").select("p_partkey", "p_size")
    orders = load(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"
    )
    segment, letter = F.col("c_mktsegment"), F.col("o_orderstatus")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.to_date("o_orderdate").alias("diag_date"),
            (F.col("p_size") + 39).cast("int").alias("age"),
            (F.col("o_custkey") % 2).cast("int").alias("sex"),
            F.when(segment == "AUTOMOBILE", 1)
            .when(segment == "BUILDING", 2)
            .when(segment.isin("FURNITURE", "HOUSEHOLD"), 3)
            .alias("stage"),
            F.when(letter == "F", "D").when(letter == "P", "E").otherwise("B").alias("vital"),
            F.to_date("ship").alias("vital_date"),
        )
    )


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_cohort(registry(spark, folder), STUDY)


def run_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every person in every run, as real (0) or stand-in synthetic (1) row.

    The bit of the id that decides changes with the run.
    """
    keyed = cohort(spark, folder).withColumn("site", F.lit("main"))
    for name, first, last in (("model", 0, MODELS - 1), ("sim", 1, SIMS)):
        keyed = keyed.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))
    bit = F.col("model") * F.lit(SIMS) + F.col("sim") - 1
    divisor = F.pow(F.lit(2.0), bit).cast("bigint")
    return keyed.withColumn("synth", (F.floor(F.col("id") / divisor) % 2).cast("int"))


def real_and_synthetic(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    runs = run_table(spark, folder)
    return (
        runs.filter("synth = 0").drop("synth"),
        runs.filter("synth = 1").drop("synth"),
    )


def attack_table(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(real with `holdout` flag, synthetic) with day offsets instead of dates.

    Written out once per query, since the pairwise operators read it several times.
    """
    runs = run_table(spark, folder).withColumn("holdout", (F.col("id") % 5 == 0).cast("int"))
    table = cut(with_run_minimum_delta(runs, ["exit"], RUN), "runs")
    return (
        table.filter("synth = 0").drop("synth"),
        table.filter("synth = 1").drop("synth", "holdout"),
    )


COHORT_SQL = """
ship AS (SELECT l_orderkey, min(l_shipdate) AS ship, min(l_partkey) AS partkey
         FROM lineitem GROUP BY l_orderkey),
registry AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS diag_date,
         CAST(p_size + 39 AS BIGINT) AS age, o_custkey % 2 AS sex,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
              WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 3 END AS stage,
         CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'E' ELSE 'B' END AS vital,
         CAST(ship AS DATE) AS vital_date
  FROM orders JOIN ship ON o_orderkey = l_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN part ON partkey = p_partkey),
cohort AS (
  SELECT id, age, sex, coalesce(stage, 999) AS stage, year(diag_date) AS daar,
         year(diag_date) - year(diag_date) % 2 AS daar_grp, diag_date,
         least(vital_date, DATE '1999-12-31') AS exit,
         CASE WHEN vital = 'D' AND vital_date <= DATE '1999-12-31' THEN 1 ELSE 0 END AS status,
         date_diff('day', diag_date, least(vital_date, DATE '1999-12-31'))
           / CAST(365.25 AS DOUBLE) AS t
  FROM registry
  WHERE vital <> 'E' AND year(diag_date) BETWEEN 1995 AND 1999
    AND diag_date < DATE '1999-12-31'
    AND least(vital_date, DATE '1999-12-31') > diag_date
    AND NOT (vital <> 'D' AND vital_date < DATE '1999-12-31')),
runs AS (
  SELECT 'main' AS site, m.model, s.sim,
         (id // CAST(power(2, m.model * 3 + s.sim - 1) AS BIGINT)) % 2 AS synth, cohort.*,
         CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS holdout
  FROM cohort, (SELECT unnest([0, 1]) AS model) m, (SELECT unnest([1, 2, 3]) AS sim) s),
attack AS (
  SELECT runs.*, date_diff('day', min(exit) OVER (PARTITION BY site, model, sim), exit)
           AS exit_delta
  FROM runs)
"""
