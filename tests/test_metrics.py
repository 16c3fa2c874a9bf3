import pytest
from pyspark.sql import functions as F

from syncohort.functions.columns import age_group
from syncohort.operators import attack, survival, utility
from syncohort.operators.cohort import lookup_join
from syncohort.operators.stats import merge_results, median_run

COHORT = "site string, id long, age int, sex int, stage int, daar int, status int, t double"


def rows(spark, values):
    return spark.createDataFrame(values, COHORT)


def sample(spark, shift=0):
    return rows(
        spark,
        [
            ("m", i, 40 + (i * 7) % 45 + shift, i % 2, [1, 2, 3, 999][i % 4], 2000 + i % 3,
             (i // 2) % 2, 0.1 + (i * 13 % 50) / 10)
            for i in range(200)
        ],
    )


def runs(frame):
    return frame.withColumn("model", F.lit(0)).withColumn(
        "sim", F.explode(F.array(F.lit(1), F.lit(2)))
    )


def test_equal_tables_have_no_distance(spark):
    real = sample(spark)
    synthetic = runs(real)
    jsd = utility.jsd_univariate(real, synthetic).collect()
    assert len(jsd) == 12 and all(abs(r["jsd"]) < 1e-7 for r in jsd)
    assert all(r["pcd"] < 1e-12 for r in utility.pcd(real, synthetic).collect())
    diff = survival.survival_difference(real, synthetic, 2.0).collect()
    assert len(diff) == 2 and all(r["mean_diff"] < 1e-12 for r in diff)


def test_disjoint_tables_are_at_distance_one(spark):
    real = rows(spark, [("m", i, 50, 0, 1, 2000, 0, 1.0) for i in range(4)])
    other = rows(spark, [("m", i, 50, 1, 2, 2001, 1, 1.0) for i in range(4)])
    got = {
        r["variable"]: r["jsd"]
        for r in utility.jsd_univariate(real, runs(other)).filter("sim = 1").collect()
    }
    assert all(abs(got[v] - 1.0) < 1e-12 for v in ("sex", "stage", "daar", "status"))
    assert got["age"] == got["t"] == 0.0


def test_survival_curve_by_hand(spark):
    frame = spark.createDataFrame(
        [(1, 1.0, 1), (1, 2.0, 0), (1, 2.0, 1), (1, 3.0, 1), (1, 4.0, 0), (1, 5.0, 1)],
        "g int, t double, status int",
    )
    curve = {r["t"]: r["survivor"] for r in survival.kaplan_meier(frame, ["g"]).collect()}
    assert curve[1.0] == pytest.approx(5 / 6)
    assert curve[2.0] == pytest.approx(5 / 6 * 4 / 5)
    assert curve[3.0] == pytest.approx(5 / 6 * 4 / 5 * 2 / 3)
    assert curve[4.0] == pytest.approx(5 / 6 * 4 / 5 * 2 / 3)
    assert curve[5.0] == 0.0


SCORES = [(0.9, 1), (0.8, 1), (0.8, 0), (0.5, 0), (0.5, 1), (0.1, 0)]


def test_auc_with_ties_and_under_monotone_change(spark):
    frame = spark.createDataFrame([(1, s, m) for s, m in SCORES], "sim int, score double, member int")
    auc = attack.roc_auc(attack.roc_points(frame, ["sim"]), ["sim"]).first()["auc"]
    pairs = [(a, b) for a, m in SCORES for b, n in SCORES if m == 1 and n == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert auc == pytest.approx(want)
    changed = frame.withColumn("score", F.exp(F.col("score") * 3.0))
    assert attack.roc_auc(attack.roc_points(changed, ["sim"]), ["sim"]).first()["auc"] == auc
    rates = attack.tpr_at_fpr(attack.roc_points(frame, ["sim"]), ["sim"], (0.0, 0.5, 1.0)).first()
    assert (rates["tpr_1"], rates["tpr_2"], rates["tpr_3"]) == pytest.approx((1 / 3, 2 / 3, 1.0))


def test_age_groups_are_right_closed(spark):
    frame = spark.createDataFrame([(0,), (1,), (40,), (41,), (80,), (81,), (None,)], "age int")
    got = [r[0] for r in frame.select(age_group("age")).collect()]
    assert got == [0, 1, 1, 2, 5, 6, None]


def test_lookup_without_partner_stops(spark):
    data = spark.createDataFrame([(1,), (2,)], "k int")
    lookup = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="lookup partner"):
        lookup_join(data, lookup, ["k"]).collect()


def test_repeated_key_stops(spark):
    left = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, a double")
    right = spark.createDataFrame([(1, 2.0)], "k int, b double")
    with pytest.raises(Exception, match="not unique"):
        merge_results(left, right, ["k"]).collect()


def test_median_run_breaks_ties_by_number(spark):
    frame = spark.createDataFrame(
        [(0, 3, 1.0), (0, 1, 3.0), (0, 2, 2.5), (0, 4, 1.5)], "model int, sim int, v double"
    )
    assert median_run(frame, ["model"], "v").first()["sim"] == 2
