"""Privacy loss of a sensitive value by importance sampling over model draws.

Probabilities are computed per covariate pattern and draw, packed into arrays
and joined to the persons once. All steps per person (ratios, weights,
posterior, ranks) then work inside the row: a run needs no shuffle beyond that
join, and nothing is ever as long as persons x candidates x draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.functions.columns import dot, log_sum_exp, run_keys
from syncohort.functions.splines import spline_basis
from syncohort.operators.cohort import lookup_join
from syncohort.operators.evidence import (
    NEEDED,
    PATTERN,
    PATTERNS,
    SCENARIO,
    Tables,
    block_of,
    log_ratios,
    meet,
    weighed,
)
from syncohort.operators.frequencies import (
    CUTS,
    event_exposure,
    interval_exposure,
    interval_index,
)
from syncohort.operators.stats import median_run
from syncohort.settings import MISSING_STAGE, RUN, StudySettings

_DEFAULTS = StudySettings()
RATE_BY = ("sex",)


def scenario_grid(cohort: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Every combination of age, sex, year group and stage over the observed ranges."""
    keys = run_keys(cohort.columns, keys)
    # The sets hold the levels of one covariate, a handful of values.
    limits = cohort.groupBy(*keys).agg(
        *[f(c).alias(f"_{n}_{c}") for c in PATTERN for n, f in (("lo", F.min), ("hi", F.max))],
        F.size(F.collect_set("daar_grp")).alias("_groups"),
        F.size(F.collect_set("stage")).alias("_stages"),
    )
    step = (F.col("_hi_daar_grp") - F.col("_lo_daar_grp")) / F.greatest(
        F.col("_groups") - 1, F.lit(1)
    )
    grid = (
        limits.withColumn("age", F.explode(F.sequence("_lo_age", "_hi_age")))
        .withColumn("sex", F.explode(F.sequence("_lo_sex", "_hi_sex")))
        .withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
        .withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_stages"))))
    )
    stage = F.when(F.col("_s") == 4, F.lit(MISSING_STAGE)).otherwise(F.col("_s"))
    return grid.select(
        *keys,
        "age",
        "sex",
        F.round(F.col("_lo_daar_grp") + step * F.col("_g")).cast("int").alias("daar_grp"),
        stage.alias("stage"),
    )


def candidate_table(cohort: DataFrame, settings: StudySettings = _DEFAULTS) -> DataFrame:
    """Each person with each possible stage: true one in `stage_id`, candidate in `stage`."""
    stages = F.array(*[F.lit(s) for s in settings.stages])
    return (
        cohort.withColumnRenamed("stage", "stage_id")
        .select("*", F.posexplode(stages).alias("k_id", "stage"))
        .withColumn("k_id", F.col("k_id") + 1)
        .withColumn("correct", (F.col("stage") == F.col("stage_id")).cast("int"))
    )


def covariate_probability(
    scenarios: DataFrame,
    submodels: Sequence[tuple[str, Sequence[str], DataFrame]],
    keys: Sequence[str] = RUN,
) -> DataFrame:
    """Product of conditional probabilities per scenario and draw.

    Each submodel is (variable, parents, table with `h` and `p`). Scenarios, draws
    and tables are all as long as the covariate patterns.
    """
    keys = run_keys(scenarios.columns, keys)
    out, matched = scenarios, list(keys)
    product = F.lit(1.0)
    for variable, parents, table in submodels:
        name = f"p_{variable}"
        out = out.join(table.withColumnRenamed("p", name), [*matched, *parents, variable])
        matched = [*keys, "h"]
        product = product * F.col(name)
    return out.withColumn("p_cov", product)


def softmax_probability(
    scenarios: DataFrame, betas: DataFrame, terms: Sequence[Column], keys: Sequence[str] = RUN
) -> DataFrame:
    """Class probabilities of a multinomial logit per scenario and draw.

    `betas` has one row per (keys, h, class) with the coefficients as an array in
    the order of `terms`.
    """
    keys = run_keys(betas.columns, keys)
    packed = betas.groupBy(*keys, "h").agg(
        F.sort_array(F.collect_list(F.struct("class", "beta"))).alias("_classes")
    )
    design = F.array(*[t.cast("double") for t in terms])
    scored = scenarios.withColumn("_x", design).join(packed, keys)

    def predictor(entry: Column) -> Column:
        return F.struct(
            entry["class"].alias("class"), dot(entry["beta"], F.col("_x")).alias("eta")
        )

    scored = scored.withColumn("_eta", F.transform("_classes", predictor))
    scored = scored.withColumn("_total", log_sum_exp(F.col("_eta.eta")))
    return scored.select(
        *scenarios.columns,
        *[c for c in (*keys, "h") if c not in scenarios.columns],
        "_total",
        F.inline("_eta"),
    ).select(
        *scenarios.columns,
        *[c for c in (*keys, "h") if c not in scenarios.columns],
        "class",
        F.exp(F.col("eta") - F.col("_total")).alias("p"),
    )


def continuous_probability(
    draws: DataFrame,
    knots: Sequence[float],
    ages: tuple[int, int] = (7, 89),
    keys: Sequence[str] = RUN,
    points: int = 900,
    reach: float = 4.5,
    window: float = 2.0,
    tail: float = 1.8,
    tail_steps: int = 10,
) -> DataFrame:
    """P(age) per draw: the normal density of age around its prediction, summed over a
    grid of the standard normal score.

    `draws` has (keys, h, beta, rmse) with beta in the order spline terms, constant.
    The sum runs over `window` on both sides of the scores that predict the age;
    from `tail` outwards the density is also averaged over the year of age.
    """
    keys = run_keys(draws.columns, keys)
    step = 2 * reach / points
    grid = draws.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.lit(-reach) + (F.col("_i") + F.lit(0.5)) * F.lit(step)
    )
    basis = [*spline_basis("x", knots), F.lit(1.0)]
    mu = F.lit(0.0)
    for i, term in enumerate(basis):
        mu = mu + F.col("beta")[i] * term
    grid = grid.withColumn("mu", mu)
    # Scores that predict an age; ages outside the predicted range use its ends.
    by = [*keys, "h"]
    predicted = grid.groupBy(*by, F.round("mu").cast("int").alias("_pred")).agg(
        F.avg("x").alias("_centre")
    )
    span = predicted.groupBy(*by).agg(F.min("_pred").alias("_lo"), F.max("_pred").alias("_hi"))
    centres = (
        span.withColumn("age", F.explode(F.sequence(F.lit(ages[0]), F.lit(ages[1]))))
        .withColumn("_pred", F.greatest(F.least("age", "_hi"), F.col("_lo")))
        .join(predicted, [*by, "_pred"])
        .select(*by, "age", "_centre")
    )
    near = centres.join(grid.select(*by, "x", "mu", "rmse"), by).filter(
        F.abs(F.col("x") - F.col("_centre")) <= F.lit(window)
    )

    def density(age: Column) -> Column:
        z = (age - F.col("mu")) / F.col("rmse")
        return F.exp(F.lit(-0.5) * z * z) / (F.col("rmse") * F.lit(math.sqrt(2 * math.pi)))

    within_year = F.lit(0.0)
    for j in range(tail_steps):
        within_year = within_year + density(F.col("age") + F.lit(-0.5 + (j + 0.5) / tail_steps))
    value = F.when(F.abs("_centre") < F.lit(tail), density(F.col("age"))).otherwise(
        within_year / F.lit(float(tail_steps))
    )
    score = F.exp(F.lit(-0.5) * F.col("x") * F.col("x")) / F.lit(math.sqrt(2 * math.pi))
    return near.groupBy(*by, "age").agg(F.sum(value * score * F.lit(step)).alias("p"))


def _log_time(rates: Column, exposure: Column, interval: Column, status: Column) -> Column:
    """ln of h(t)S(t) for an event, of S(t) otherwise, for one array of hazards."""
    spent = dot(rates, exposure)
    hazard = F.get(rates, interval)
    return F.when(status == 1, F.when(hazard > 0, F.ln(hazard) - spent)).otherwise(-spent)


def time_probability(
    persons: DataFrame,
    rates: DataFrame,
    by: Sequence[str] = ("sex", "stage"),
    keys: Sequence[str] = RUN,
    cuts: Sequence[float] = CUTS,
) -> DataFrame:
    """`p_td` per person and draw."""
    keys = run_keys(persons.columns, keys)
    packed = _draw_arrays(rates, [*keys, *by])
    joined = lookup_join(persons, packed, [*keys, *by]).withColumns(
        {"_exposure": interval_exposure("t", cuts), "_interval": interval_index("t", cuts)}
    )
    values = F.transform(
        "_rates",
        lambda r: F.exp(_log_time(r, F.col("_exposure"), F.col("_interval"), F.col("status"))),
    )
    return joined.select(
        *persons.columns, F.posexplode(F.coalesce(values, F.array())).alias("h", "p_td")
    ).withColumn("h", F.col("h") + 1)


def _draw_arrays(rates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _rates): hazards as an array over draws of arrays over intervals."""
    return (
        rates.groupBy(*by, "h")
        .agg(F.sort_array(F.collect_list(F.struct("interval", "rate"))).alias("_r"))
        .groupBy(*by)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("h", F.col("_r.rate").alias("r")))),
                lambda c: c["r"],
            ).alias("_rates")
        )
    )


def synthetic_loglik(
    synthetic: DataFrame,
    p_cov: DataFrame,
    rates: DataFrame,
    rate_by: Sequence[str] = ("sex", "stage"),
    keys: Sequence[str] = RUN,
    cuts: Sequence[float] = CUTS,
) -> DataFrame:
    """(keys, h, log_p): log probability of the whole synthetic table under each draw.

    The table enters only through its pattern counts and its events and exposure
    per interval. Missing when any row has probability zero, or no probability or rate.
    """
    keys = run_keys(synthetic.columns, keys)
    pattern = [*PATTERN, "stage"]
    counts = synthetic.groupBy(*keys, *pattern).agg(F.count("*").alias("n"))
    covariates = (
        counts.join(p_cov.select(*keys, *pattern, "h", "p_cov"), [*keys, *pattern])
        .groupBy(*keys, "h")
        .agg(
            F.sum(F.when(F.col("p_cov") > 0, F.col("n") * F.ln("p_cov"))).alias("l_cov"),
            F.count_if((F.col("p_cov") <= 0) | F.col("p_cov").isNull()).alias("_zero_cov"),
            F.sum("n").alias("_matched"),
        )
    )
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    spent = event_exposure(synthetic, [*keys, *rate_by], cuts)
    cells = spent.groupBy(*keys).agg(F.count("*").alias("_cells"))
    times = (
        spent.join(rates, [*keys, *rate_by, "interval"])
        .groupBy(*keys, "h")
        .agg(
            F.count("*").alias("_rated"),
            F.sum(
                F.when(F.col("d") > 0, F.col("d") * F.ln(F.nullif("rate", F.lit(0.0)))).otherwise(0.0)
                - F.col("rate") * F.col("exposure")
            ).alias("l_td"),
            F.count_if((F.col("d") > 0) & (F.col("rate") <= 0)).alias("_zero_td"),
        )
    )
    whole = (
        (F.col("_zero_cov") == 0)
        & (F.col("_zero_td") == 0)
        & (F.col("_matched") == F.col("_size"))
        & (F.col("_rated") == F.col("_cells"))
    )
    return (
        covariates.join(times, [*keys, "h"], "left")
        .join(sizes, keys)
        .join(cells, keys)
        .select(*keys, "h", F.when(whole, F.col("l_cov") + F.col("l_td")).alias("log_p"))
    )


def _tables(
    p_cov: DataFrame, rates: DataFrame, keys: Sequence[str], rate_by: Sequence[str], intervals: int
) -> DataFrame:
    """Scenarios with arrays over the draws: log probability, and hazards by interval."""
    log = F.when(F.col("p_cov") > 0, F.ln("p_cov"))
    logs = p_cov.groupBy(*keys, *PATTERN, "stage").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("h", log.alias("l")))), lambda c: c["l"]
        ).alias("logs")
    )
    by_interval = F.array(*[F.max(F.when(F.col("interval") == j, F.col("rate"))) for j in range(intervals)])
    hazards = (
        rates.groupBy(*keys, *rate_by, "stage", "h")
        .agg(by_interval.alias("r"))
        .groupBy(*keys, *rate_by, "stage")
        .agg(
            F.flatten(
                F.transform(F.sort_array(F.collect_list(F.struct("h", "r"))), lambda c: c["r"])
            ).alias("rates")
        )
    )
    # As many blocks as the run with most patterns needs.
    patterns = logs.groupBy(*keys).agg(F.count("*").alias("_n"))
    patterns = patterns.agg(F.ceil(F.max("_n") / (4 * PATTERNS)).alias("_blocks"))
    joined = logs.join(hazards, [*keys, *rate_by, "stage"], "left")
    return joined.join(patterns).withColumn("block", block_of()).drop("_blocks")


def _filled(rows: Sequence, size: int) -> np.ndarray:
    """Lists as rows of numbers, nan for a missing list or entry."""
    out = np.full((len(rows), size), np.nan)
    for k, row in enumerate(rows):
        if row is not None:
            out[k, : len(row)] = [np.nan if v is None else v for v in row]
    return out


def _gathered(tables: pd.DataFrame, cuts: Sequence[float]) -> Tables:
    draws = max(map(len, tables["logs"]))
    return Tables(
        tables[list(SCENARIO)].to_numpy(np.int64),
        _filled(tables["logs"].to_list(), draws),
        _filled(tables["rates"].to_list(), draws * len(cuts)).reshape(-1, draws, len(cuts)),
        tuple(cuts),
    )


def _needed(persons: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in NEEDED if c not in keys]
    return persons.select(*keys, *names)


def _types(persons: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in persons.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in NEEDED if c not in keys)


def candidate_ratio(
    persons: DataFrame,
    p_cov: DataFrame,
    rates: DataFrame,
    keys: Sequence[str] = RUN,
    cuts: Sequence[float] = CUTS,
    rate_by: Sequence[str] = RATE_BY,
) -> DataFrame:
    """(keys, id, stage, h, ratio): candidate over true probability, one row per draw.

    A person without probabilities or hazards stops the job.
    """
    keys = run_keys(persons.columns, keys)

    def judge(key: tuple, persons: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for some, stages, ratio in log_ratios(persons, _gathered(tables, cuts)):
            ids = persons["id"].to_numpy()[some]
            parts.append(
                pd.DataFrame(
                    {
                        "id": np.repeat(ids, len(stages)),
                        "stage": np.tile(stages, len(ids)),
                        "ratio": list(np.nan_to_num(np.exp(ratio)).reshape(-1, ratio.shape[2])),
                    }
                )
            )
        return pd.concat(parts)

    wide = meet(
        _needed(persons, keys), _tables(p_cov, rates, keys, rate_by, len(cuts)), keys, judge,
        "id long, stage int, ratio array<double>",
    )
    return wide.select(*keys, "id", "stage", F.posexplode("ratio").alias("h", "ratio")).withColumn(
        "h", F.col("h") + 1
    )


def candidate_evidence(
    persons: DataFrame,
    p_cov: DataFrame,
    rates: DataFrame,
    loglik: DataFrame,
    keys: Sequence[str] = RUN,
    cuts: Sequence[float] = CUTS,
    rate_by: Sequence[str] = RATE_BY,
) -> DataFrame:
    """Persons (keys, id, covariates, status, t) with `cand`: (stage, correct, loglik,
    log_prior) per candidate.

    A draw has weight ratio / sum of ratios; `loglik` is the log of the weighted
    sum of the synthetic table's probability over the draws. Hazards depend on the
    covariates `rate_by` and the stage. A person without probabilities or hazards would
    make the largest loss too small: that stops the job.
    """
    keys = run_keys(persons.columns, keys)
    table = loglik.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("h", "log_p"))), lambda c: c["log_p"]
        ).alias("whole")
    )

    def judge(key: tuple, persons: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        gathered = _gathered(tables, cuts)
        whole = _filled(tables["whole"].to_list()[:1], gathered.logs.shape[1])[0]
        return weighed(persons, gathered, whole)

    found = meet(
        _needed(persons, keys), _tables(p_cov, rates, keys, rate_by, len(cuts)).join(table, keys), keys, judge,
        f"{_types(persons, keys)}, stages array<int>, loglik array<double>, log_prior array<double>",
    )
    return with_candidates(found)


def with_candidates(found: DataFrame) -> DataFrame:
    """Arrays over candidates as `cand`, an array of structs."""
    cand = F.transform(
        F.arrays_zip("stages", "loglik", "log_prior"),
        lambda c: F.struct(
            c["stages"].alias("stage"),
            (c["stages"] == F.col("stage")).cast("int").alias("correct"),
            c["loglik"].alias("loglik"),
            c["log_prior"].alias("log_prior"),
        ),
    )
    return found.withColumn("cand", cand).drop("stages", "loglik", "log_prior")


def _shares(logs: Column) -> Column:
    """exp(x) normalised over the array; a missing entry has share 0."""
    total = log_sum_exp(logs)
    return F.transform(logs, lambda x: F.coalesce(F.exp(x - total), F.lit(0.0)))


def _ranks(shares: Column, cand: Column) -> Column:
    """Position of each candidate by share, then truth, then code."""
    entries = F.zip_with(
        shares, cand,
        lambda p, c: F.struct((-p).alias("p"), (-c["correct"]).alias("c"), c["stage"].alias("s")),
    )
    order = F.sort_array(entries)
    return F.transform(entries, lambda e: F.array_position(order, e))


def candidate_posterior(
    evidence: DataFrame, keep: Sequence[str] = ("age", "sex", "daar_grp", "status", "t"),
    keys: Sequence[str] = RUN,
) -> DataFrame:
    """One row per person and candidate: posterior, model prior, their product, ranks.

    Expects the output of `candidate_evidence`.
    """
    keys = run_keys(evidence.columns, keys)
    keep = [c for c in keep if c in evidence.columns]
    frame = evidence.withColumns(
        {
            "_post": _shares(F.col("cand.loglik")),
            "_prior": _shares(F.col("cand.log_prior")),
        }
    )
    frame = frame.withColumn("_joint", F.zip_with("_post", "_prior", lambda a, b: a * b))
    total = F.aggregate("_joint", F.lit(0.0), lambda a, v: a + v)
    frame = frame.withColumn("_joint_total", F.nullif(total, F.lit(0.0)))
    frame = frame.withColumn(
        "_both", F.transform("_joint", lambda x: x / F.col("_joint_total"))
    ).drop("_joint", "_joint_total")
    frame = frame.withColumns(
        {
            "_rank": _ranks(F.col("_post"), F.col("cand")),
            "_rank_prior": _ranks(F.col("_both"), F.col("cand")),
        }
    )
    zipped = F.arrays_zip("cand", "_post", "_prior", "_both", "_rank", "_rank_prior")
    long = frame.select(*keys, "id", *keep, F.inline(zipped))
    return long.select(
        *keys, "id", *keep,
        F.col("cand.stage").alias("stage"),
        F.col("cand.correct").alias("correct"),
        F.col("cand.loglik").alias("loglik"),
        F.col("_post").alias("probability"),
        F.col("_prior").alias("prior"),
        F.col("_rank").alias("rank"),
        F.col("_both").alias("prob_prior"),
        F.col("_rank_prior").alias("rank_prior"),
    )


def person_loss(evidence: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Privacy loss per person: range of the log likelihood over candidates.

    Missing when the log likelihood of any candidate is.
    """
    keys = run_keys(evidence.columns, keys)
    logs = F.col("cand.loglik")
    complete = ~F.exists(logs, lambda x: x.isNull())
    shares = _shares(logs)
    true_share = F.array_max(
        F.transform(F.arrays_zip(shares.alias("p"), F.col("cand.correct").alias("c")),
                    lambda e: F.when(e["c"] == 1, e["p"]))
    )
    return evidence.select(
        *keys,
        "id",
        F.when(complete, F.array_max(logs) - F.array_min(logs)).alias("loss"),
        true_share.alias("p_true"),
        F.array_max(shares).alias("p_max"),
    )


def maximum_local_privacy_loss(evidence: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Largest loss of any person and largest posteriors, one row per run with a value."""
    keys = run_keys(evidence.columns, keys)
    return (
        person_loss(evidence, keys)
        .groupBy(*keys)
        .agg(
            F.max("p_true").alias("bayesian"),
            F.max("loss").alias("ll_diff"),
            F.max("p_max").alias("bayesian_max"),
        )
        .filter(F.col("ll_diff").isNotNull())
    )


def representative_run(losses: DataFrame, keys: Sequence[str] = ("site", "model")) -> DataFrame:
    """Per model the run whose loss is closest to the model's median."""
    return median_run(losses, run_keys(losses.columns, keys), "ll_diff")


def riskiest_person(evidence: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """The person with the largest loss of each run, the smaller id among equals."""
    keys = run_keys(evidence.columns, keys)
    losses = person_loss(evidence, keys).filter(F.col("loss").isNotNull())
    level = F.round("loss", 9)
    return losses.groupBy(*keys).agg(
        F.min(F.struct((-level).alias("l"), "id", "loss")).alias("_best")
    ).select(*keys, F.col("_best.id").alias("id"), F.col("_best.loss").alias("loss"))


def prior_sweep(evidence: DataFrame, keys: Sequence[str] = RUN, steps: int = 100) -> DataFrame:
    """Posterior of the truth for the riskiest person as its prior goes from 0 to 1.

    The rest of the prior is put on one wrong candidate at a time; the result is the
    envelope over those, drawn at least 0.01 wide.
    """
    keys = run_keys(evidence.columns, keys)
    person = riskiest_person(evidence, keys)
    rows = candidate_posterior(evidence.join(person, [*keys, "id"], "left_semi"), (), keys)
    truth = rows.filter("correct = 1").select(*keys, "id", F.col("probability").alias("p_true"))
    wrong = rows.filter("correct = 0").select(*keys, "id", F.col("probability").alias("p_wrong"))
    prior = F.col("_j") / F.lit(float(steps))
    swept = truth.join(wrong, [*keys, "id"]).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(steps)))
    ).withColumn("prior", prior)
    hit = F.col("p_true") * F.col("prior")
    miss = F.col("p_wrong") * (F.lit(1.0) - F.col("prior"))
    swept = swept.withColumn("posterior", hit / F.nullif(hit + miss, F.lit(0.0)))
    band = swept.groupBy(*keys, "id", "prior").agg(
        F.min("posterior").alias("ymin"), F.max("posterior").alias("ymax")
    )
    narrow = (F.col("ymax") - F.col("ymin")) < F.lit(0.01)
    return band.withColumn(
        "ymin",
        F.when(narrow, F.greatest(F.col("ymax") - F.lit(0.01), F.lit(0.0))).otherwise(
            F.col("ymin")
        ),
    )


def two_model_posterior(
    scored: DataFrame, first: str, second: str, keys: Sequence[str] = RUN
) -> DataFrame:
    """Total log likelihood of a table under two models, their distance, and the
    posterior of the second with equal priors."""
    keys = run_keys(scored.columns, keys)
    totals = scored.groupBy(*keys).agg(
        F.sum(F.ln(first)).alias("l_first"), F.sum(F.ln(second)).alias("l_second")
    )
    gap = F.col("l_first") - F.col("l_second")
    return totals.withColumns(
        {
            "distance": F.abs(gap),
            "p_second": F.when(gap > 0, F.exp(-gap) / (F.lit(1.0) + F.exp(-gap))).otherwise(
                F.lit(1.0) / (F.lit(1.0) + F.exp(gap))
            ),
        }
    )


def valid_draws(
    p_cov: DataFrame, rates: DataFrame, wanted: int, keys: Sequence[str] = RUN
) -> tuple[DataFrame, DataFrame]:
    """Of a surplus of draws, the first `wanted` with positive probabilities, renumbered.

    A run with fewer such draws stops the job.
    """
    keys = run_keys(p_cov.columns, keys)

    def bad(frame: DataFrame, column: str) -> DataFrame:
        value = F.col(column)
        broken = value.isNull() | F.isnan(value) | (value <= 0)
        return frame.groupBy(*keys, "h").agg(F.max(broken.cast("int")).alias("_bad"))

    flags = bad(p_cov, "p_cov").unionByName(bad(rates, "rate")).groupBy(*keys, "h").agg(
        F.max("_bad").alias("_bad")
    )
    good = flags.filter("_bad = 0").groupBy(*keys).agg(
        F.slice(F.sort_array(F.collect_list("h")), 1, wanted).alias("_h")
    )
    runs = flags.select(*keys).distinct()
    good = runs.join(good, keys, "left") if keys else good
    good = good.withColumn(
        "_h",
        F.when(F.size("_h") == wanted, F.col("_h")).otherwise(
            F.raise_error(F.lit(f"fewer than {wanted} valid draws")).cast("array<int>")
        ),
    )
    numbered = good.select(*keys, F.posexplode("_h").alias("_new", "h"))

    def renumber(frame: DataFrame) -> DataFrame:
        return (
            frame.join(numbered, [*keys, "h"])
            .withColumn("h", F.col("_new") + 1)
            .drop("_new")
        )

    return renumber(p_cov), renumber(rates)
