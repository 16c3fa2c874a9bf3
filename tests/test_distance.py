import numpy as np
import pandas as pd
import pytest

from syncohort.operators import distance

NUMERIC, CATEGORICAL = ["a", "b", "c"], ["s"]


def people(rows, seed, start):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "sim": rng.choice([1, 2], p=[0.7, 0.3], size=rows).astype("int32"),
            "id": np.arange(start, start + rows),
            "a": rng.normal(0, 1, rows).round(2),
            "b": rng.integers(0, 30, rows).astype(float),
            "c": np.full(rows, 4.0),
            "s": rng.choice([1, 2, 999], size=rows).astype(float),
        }
    )
    # A third of the rows are copies of one record; some categories are missing.
    frame.loc[frame.index % 3 == 0, ["a", "b", "s"]] = [0.5, 7.0, 2.0]
    frame.loc[frame.index % 17 == 0, "s"] = np.nan
    return frame


def brute(data, samples, k, exclude_self, scaling=None):
    out = []
    for sim in (1, 2):
        d, q = data[data["sim"] == sim], samples[samples["sim"] == sim]
        everything = [d, q] + ([scaling[scaling["sim"] == sim]] if scaling is not None else [])
        both = pd.concat(everything)
        total = np.zeros((len(q), len(d)))
        for c in NUMERIC:
            span = both[c].max() - both[c].min()
            if span > 0:
                total += np.abs(q[c].to_numpy()[:, None] - d[c].to_numpy()[None, :]) / span
        for c in CATEGORICAL:
            x, y = q[c].fillna(-1).to_numpy(), d[c].fillna(-1).to_numpy()
            total += x[:, None] != y[None, :]
        total /= len(NUMERIC) + len(CATEGORICAL)
        for i, qid in enumerate(q["id"]):
            ranked = sorted(
                (round(v, 12), did)
                for v, did in zip(total[i], d["id"])
                if not (exclude_self and did == qid)
            )[:k]
            out += [(sim, qid, r + 1, did, v) for r, (v, did) in enumerate(ranked)]
    return sorted(out)


def search(spark, data, samples, **options):
    clean = lambda f: spark.createDataFrame(f.astype(object).where(f.notna(), None), SCHEMA)
    rows = distance.nearest_records(
        clean(data), clean(samples), NUMERIC, CATEGORICAL, keys=["sim"], **options
    ).collect()
    return sorted(
        (r["sim"], r["id"], r["rank"], r["neighbour"], round(r["distance"], 12)) for r in rows
    )


SCHEMA = "sim int, id long, a double, b double, c double, s double"


@pytest.mark.parametrize("k, block_rows", [(1, 16), (3, 16), (2, 2048)])
def test_equals_brute_force(spark, k, block_rows):
    data, samples = people(400, 1, 0), people(300, 2, 10_000)
    got = search(spark, data, samples, k=k, block_rows=block_rows)
    want = brute(data, samples, k, False)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-11)


def test_without_the_record_itself(spark):
    data = people(300, 3, 0)
    got = search(spark, data, data, k=1, exclude_self=True, block_rows=16)
    want = brute(data, data, 1, True)
    assert [g[:4] for g in got] == [w[:4] for w in want]


def test_copies_are_at_distance_zero(spark):
    data = people(200, 4, 0)
    frame = spark.createDataFrame(data.dropna(), SCHEMA)
    near = distance.closest_distance(frame, frame, ["sim"], numeric=NUMERIC, categorical=CATEGORICAL)
    assert near.filter("distance > 0").count() == 0
    features = [*NUMERIC, *CATEGORICAL]
    share = distance.identical_match_share(frame, frame, features, ["sim"]).collect()
    assert [r["ims"] for r in share] == [1.0, 1.0]
