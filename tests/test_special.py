import math

import numpy as np
import pytest

from syncohort.functions.special import exact_lower, exact_upper, regularised_beta
from syncohort.operators.attack import empirical_epsilon, epsilon_corners, roc_points


def test_exact_binomial_limits():
    assert exact_upper([0], [10])[0] == np.float64(exact_upper([0], [10])[0])
    assert abs(exact_upper([0], [10])[0] - 0.3085) < 1e-4
    assert abs(exact_lower([10], [10])[0] - 0.6915) < 1e-4
    assert exact_lower([0], [10])[0] == 0.0
    assert exact_upper([10], [10])[0] == 1.0


def test_incomplete_beta_against_binomial_sums():
    for n, k, p in [(10, 3, 0.2), (50, 20, 0.5), (200, 5, 0.01)]:
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abs(regularised_beta(k, n - k + 1, p) - tail) < 1e-10


def test_limits_of_large_counts_bracket_the_share():
    low, high = exact_lower([500_000], [1_000_000])[0], exact_upper([500_000], [1_000_000])[0]
    assert low < 0.5 < high
    assert high - low < 0.0021


def test_epsilon_over_all_thresholds(spark):
    rng = np.random.default_rng(2)
    rows, seen = [], set()
    tp = fp = 0
    for i in range(60):
        tp, fp = min(100, tp + int(rng.integers(0, 4))), min(80, fp + int(rng.integers(0, 2)))
        if (tp, fp) not in seen:
            seen.add((tp, fp))
            rows.append((1, float(-i), tp, fp, 100, 80))
    points = spark.createDataFrame(
        rows, "sim int, score double, tp long, fp long, positives long, negatives long"
    )
    want = max(
        [0.0]
        + [
            math.log(exact_lower([t], [100])[0] / exact_upper([f], [80])[0])
            for _, _, t, f, _, _ in rows
            if f > 0 and t > 0
        ]
    )
    got = empirical_epsilon(points, ["sim"]).first()["epsilon"]
    assert abs(got - want) < 1e-12


def test_few_thresholds_are_evaluated_and_the_largest_is_among_them(spark):
    rng = np.random.default_rng(3)
    score = np.concatenate([rng.normal(0.7, 1, 15000), rng.normal(0, 1, 15000)])
    rows = list(zip([1] * 30000, score.tolist(), [1] * 15000 + [0] * 15000))
    points = roc_points(spark.createDataFrame(rows, "sim int, score double, member int"), ["sim"])
    corners = epsilon_corners(points, ["sim"]).count()
    whole = points.select("tp", "fp").toPandas()
    whole = whole[(whole.tp > 0) & (whole.fp > 0)].sort_values("fp")
    assert corners < 0.05 * len(whole)
    thin = whole.groupby("fp", as_index=False).tp.max().groupby("tp", as_index=False).fp.min()
    bounds = np.log(exact_lower(thin.tp, 15000.0) / exact_upper(thin.fp, 15000.0))
    assert empirical_epsilon(points, ["sim"]).first()["epsilon"] == pytest.approx(bounds.max(), abs=1e-9)
