"""Candidates of persons against tables of probabilities and hazards over many draws.

The tables are as long as the covariates allow; persons are as many as they are. Persons
meet the tables of their run in groups of bounded size, where one array operation covers
all candidates, draws and intervals of a batch of persons.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = ("age", "sex", "daar_grp")
SCENARIO = (*PATTERN, "stage")
NEEDED = ("id", *SCENARIO, "status", "t")
#: Covariate patterns in a block, persons that meet a block in one group, persons at once.
PATTERNS, PERSONS, BATCH = 1024, 20_000, 256


@dataclass
class Tables:
    """Log probabilities (scenario, draw) and hazards (scenario, draw, interval); nan: none."""

    scenarios: np.ndarray
    logs: np.ndarray
    rates: np.ndarray
    cuts: Sequence[float]


def log_sums(values: np.ndarray) -> np.ndarray:
    """ln of the sum of exp over the last axis; nan entries do not count, nan without any."""
    some = np.where(np.isnan(values), -np.inf, values)
    top = some.max(-1, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = safe[..., 0] + np.log(np.exp(some - safe).sum(-1))
    return np.where(np.isnan(values).all(-1), np.nan, out)


def log_ratios(
    persons: pd.DataFrame, tables: Tables
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, stages, candidate over true log probability by person, stage and draw).

    A stage that a person's pattern lacks, a probability or a hazard that is needed and is
    zero or missing, give nan. A person whose pattern the tables lack stops the job.
    """
    stages = np.unique(tables.scenarios[:, -1])
    place = {tuple(row): k for k, row in enumerate(tables.scenarios.tolist())}
    patterns = persons[list(PATTERN)].astype(int).itertuples(index=False)
    at = np.array([[place.get((*p, s), -1) for s in stages.tolist()] for p in patterns])
    rated = ~np.isnan(tables.rates).all((1, 2)) if len(tables.rates) else np.zeros(0, bool)
    if len(at) and not ((at >= 0) & rated[at]).any(1).all():
        raise ValueError("row without lookup partner")
    starts = np.array(tables.cuts)
    t, died = persons["t"].to_numpy(float), persons["status"].to_numpy() == 1
    own = np.maximum((t[:, None] > starts).sum(1) - 1, 0)
    rest = t - starts[own]
    # By scenario, interval and draw: a person needs those of the interval it gets to.
    rates = np.ascontiguousarray(tables.rates.swapaxes(1, 2))
    with np.errstate(all="ignore"):
        passed = np.zeros_like(rates)
        passed[:, 1:] = np.cumsum(rates[:, :-1] * np.diff(starts)[:, None], axis=1)
        before, hits = tables.logs[:, None] - passed, np.log(rates)
    truth = np.searchsorted(stages, persons["stage"].to_numpy(int))
    # A true stage that nobody has a probability for has no ratios.
    known = (truth < len(stages)) & (stages[np.minimum(truth, len(stages) - 1)] == persons["stage"].to_numpy(int))
    truth = np.minimum(truth, len(stages) - 1)
    for a in range(0, len(persons), BATCH):
        some = slice(a, a + BATCH)
        near, time = at[some], rest[some, None, None]
        place = near, own[some, None]
        with np.errstate(all="ignore"):
            # No time in an interval takes nothing off, whatever its hazard.
            logs = before[place] - np.where(time > 0, rates[place] * time, 0.0)
            logs += np.where(died[some, None, None], hits[place], 0.0)
            logs = np.where(np.isfinite(logs) & (near >= 0)[..., None], logs, np.nan)
            logs = logs - np.take_along_axis(logs, truth[some, None, None], 1)
        yield some, stages, np.where(known[some, None, None], logs, np.nan)


def listed(values: np.ndarray) -> list[list[float | None]]:
    return [[None if np.isnan(v) else float(v) for v in row] for row in values]


def weighed(persons: pd.DataFrame, tables: Tables, whole: np.ndarray) -> pd.DataFrame:
    """Persons with arrays over candidates: stages, loglik, log_prior.

    A draw has weight ratio over sum of ratios; loglik is the log of the weighted sum of
    the synthetic table's probability `whole` (log, by draw).
    """
    parts = []
    for some, stages, ratio in log_ratios(persons, tables):
        prior = log_sums(ratio)
        parts.append((np.tile(stages, (len(ratio), 1)), log_sums(ratio + whole) - prior, prior))
    out = persons.copy()
    stages, loglik, prior = map(np.concatenate, zip(*parts))
    out["stages"] = stages.tolist()
    out["loglik"], out["log_prior"] = listed(loglik), listed(prior)
    return out


def block_of(patterns: str = "_blocks"):
    return F.pmod(F.xxhash64(*[F.col(c).cast("long") for c in PATTERN]), patterns).cast("int")


def meet(
    persons: DataFrame,
    tables: DataFrame,
    keys: Sequence[str],
    judge: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """`judge(run, persons, tables)` of every group of persons and its block of `tables`.

    `tables` has `keys` and `block` (null: rows that every block of the run needs); it is
    copied once per group. `judge` returns columns of `schema`, after the keys.
    """
    keys = list(keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in persons.schema if f.name in keys)
    blocks = tables.groupBy(*keys).agg((F.max("block") + 1).cast("int").alias("_blocks"))
    groups = persons.groupBy(*keys).agg(F.count("*").alias("_persons")).join(blocks, keys, "left")
    sizes = groups.select(
        *keys,
        F.coalesce("_blocks", F.lit(1)).alias("_blocks"),
        F.ceil(F.col("_persons") / (F.lit(PERSONS) * F.coalesce("_blocks", F.lit(1)))).cast("int").alias("_parts"),
    )
    left = (
        persons.join(sizes, keys)
        .withColumn("block", block_of())
        .withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int"))
        .select(*keys, "block", "part", *[c for c in NEEDED if c not in keys])
    )
    every = F.when(F.col("block").isNull(), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("block"))
    right = (
        tables.join(sizes, keys)
        .withColumn("block", F.explode(every))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .drop("_blocks", "_parts")
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def group(key: tuple, persons: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if not len(persons):
            return pd.DataFrame(columns=[*keys, *names])
        if not len(tables):
            raise ValueError("row without lookup partner")
        out = judge(key, persons, tables)
        for k, name in enumerate(keys):
            out[name] = key[k]
        return out[[*keys, *names]]

    by = [*keys, "block", "part"]
    # Columns of their own on either side, as both may come from one table.
    left, right = (f.select(*[F.col(c).alias(c) for c in f.columns]) for f in (left, right))
    return (
        left.groupBy(*by)
        .cogroup(right.groupBy(*by))
        .applyInPandas(group, f"{types}, {schema}" if keys else schema)
    )
