import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from syncohort.functions.ordered import ranges, row_numbers, running_totals
from syncohort.operators import cohort as prepare
from syncohort.operators.stats import percentile_type2, with_group_stats


def table(spark, rows=3000, seed=1):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            # One group holds most of the rows, and its values are concentrated.
            "g": rng.choice([1, 2, 3], p=[0.8, 0.15, 0.05], size=rows),
            "x": np.round(rng.exponential(1.0, rows) ** 3, 4),
            "n": rng.integers(0, 5, rows),
        }
    ).groupby(["g", "x"], as_index=False).sum()
    return frame, spark.createDataFrame(frame)


def test_running_totals_equal_a_window(spark):
    frame, df = table(spark)
    for descending in (False, True):
        got = running_totals(df, ["g"], ["x"], {"upto": "n"}, descending).toPandas()
        want = frame.sort_values(["g", "x"], ascending=not descending)
        want["upto"] = want.groupby("g")["n"].cumsum()
        merged = got.merge(want, on=["g", "x", "n"], suffixes=("", "_want"))
        assert len(merged) == len(frame)
        assert (merged["upto"] == merged["upto_want"]).all()


def test_row_numbers_do_not_depend_on_partitioning(spark):
    _, df = table(spark)
    seen = []
    for parts in (1, 4, 8):
        rows = row_numbers(df.repartition(parts), ["g"], ["x"]).select("g", "x", "rn").collect()
        seen.append(sorted(tuple(r) for r in rows))
    assert seen[0] == seen[1] == seen[2]
    for g in (1, 2, 3):
        numbers = [r[2] for r in seen[0] if r[0] == g]
        assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_percentiles_average_neighbours_when_rank_is_whole(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1, 2, 3, 4]] + [(2, 5.0)], "g int, x double")
    rows = {
        r["g"]: r for r in percentile_type2(df, ["g"], "x", {"a": 25, "b": 50, "c": 30}).collect()
    }
    assert (rows[1]["a"], rows[1]["b"], rows[1]["c"]) == (1.5, 2.5, 2.0)
    assert rows[2]["a"] == rows[2]["b"] == 5.0


def test_percentile_rank_is_exact_where_floats_are_not(spark):
    # 140 * 0.05 is above 7 in floating point; the rank is whole all the same.
    df = spark.range(1, 141).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    assert percentile_type2(df, ["g"], "x", {"p": 5}).first()["p"] == 7.5


def test_ranges_are_even_however_large_a_group_is(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") ** 3).alias("x"))
    few = "spark.sql.adaptive.coalescePartitions.enabled"  # else Spark merges ranges this small
    spark.conf.set(few, "false")
    dealt = ranges(rows.repartition(5), ["g"], ["x"])
    spark.conf.unset(few)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * 60_000 / len(sizes)


def test_running_totals_over_everything_and_over_nulls(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("x")
    )
    whole = {r["x"]: r["n"] for r in row_numbers(rows.select("x"), [], ["x"], "n").collect()}
    assert whole == {x: x + 1 for x in range(1000)}
    own = {r["x"]: r["n"] for r in row_numbers(rows, ["g"], ["x"], "n").collect()}
    assert own == {x: x // 3 + 1 for x in range(1000)}
    assert row_numbers(rows.filter("x < 0"), ["g"], ["x"], "n").collect() == []


def test_run_constants_leave_rows_where_they_are(spark):
    """The only exchange of a plan is that of the constants, which are written before."""
    rows = spark.range(5000).selectExpr(
        "'a' AS site", "CAST(id % 2 AS int) AS sim", "id", "id * 1.5D AS x", "date_add(date '2000-01-01', CAST(id AS int)) AS day"
    )
    keys = ["site", "sim"]
    plans = {
        "delta": prepare.with_run_minimum_delta(rows, ["day"], keys),
        "scaled": prepare.standard_scale(rows, ["x"], rows, keys),
        "ranged": prepare.range_scale(rows, ["x"], [rows], keys),
        "binned": prepare.with_equal_width_bins(rows, ["x"], keys),
        "clipped": prepare.winsorize(rows, ["x"], 5, keys),
        "stats": with_group_stats(rows, keys, {"m": F.avg("x")}),
        "all": prepare.winsorize(rows, ["x"], 5),
    }
    for name, frame in plans.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan, name
        assert frame.count() == 5000
