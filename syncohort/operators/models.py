"""Fitted models: specifications, fits on aggregated patterns, coefficient draws.

A fit sees one weighted row per covariate pattern; the number of patterns is set
by the covariates, not by the number of persons. Coefficients and their
covariance are the only things that reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from syncohort.functions.columns import clip, dot, run_keys
from syncohort.functions.draws import hashed_int, hashed_long, normal_of, uniform_of
from syncohort.functions.ordered import row_numbers
from syncohort.functions.special import normal_quantile
from syncohort.functions.splines import (
    equally_spaced_knots,
    spline_basis,
    spline_cubics,
    spline_values,
)
from syncohort.lineage import cut, is_written, join_constants, scratch_path
from syncohort.operators import newton
from syncohort.operators.frequencies import event_exposure
from syncohort.operators.stats import percentile_type2
from syncohort.operators.synthesis import (
    diagnosis_dates,
    finish_draws,
    spread,
    survival_days,
)
from syncohort.settings import RUN, StudySettings

Term = tuple[str, ...]


@dataclass(frozen=True)
class ModelLevel:
    """One of the model specifications."""

    level: str
    interactions: tuple[str, ...] = ()
    three_way: tuple[str, ...] = ()
    df: int = 5
    tvc: tuple[str, ...] = ()
    df_tvc: int = 0
    df_age: int = 4


#: Specifications 0 to 5, fixed values.
MODEL_LEVELS = {
    0: ModelLevel("margin"),
    1: ModelLevel("main"),
    2: ModelLevel("inter", ("age", "stage"), (), 5, ("age", "stage"), 2, 4),
    3: ModelLevel(
        "inter", ("age", "stage", "sex"), (), 5, ("age", "stage", "sex"), 3, 4
    ),
    4: ModelLevel(
        "inter", ("age", "stage", "sex"), ("age", "stage", "sex"), 5,
        ("age", "stage", "sex"), 3, 4,
    ),
    5: ModelLevel(
        "inter", ("age", "stage", "sex"), ("age", "stage", "sex"), 8,
        ("age", "stage", "sex"), 6, 6,
    ),
}


def model_terms(level: ModelLevel, predictors: Sequence[str]) -> list[Term]:
    """Main effects, then pairs and triples among the predictors that may interact."""
    if level.level == "margin":
        return []
    terms: list[Term] = [(v,) for v in predictors]
    if level.level == "inter":
        terms += list(combinations([v for v in predictors if v in level.interactions], 2))
        terms += list(combinations([v for v in predictors if v in level.three_way], 3))
    return terms


def term_columns(terms: Sequence[Term], codings: Mapping[str, Sequence[Column]]) -> list[Column]:
    """Design columns: for each term all products of its variables' columns."""
    columns = []
    for term in terms:
        products = list(codings[term[0]])
        for variable in term[1:]:
            products = [a * b for a in products for b in codings[variable]]
        columns += products
    return columns


def dummies(variable: str, levels: Sequence[int]) -> list[Column]:
    """0/1 columns for all levels but the first."""
    return [(F.col(variable) == F.lit(v)).cast("double") for v in levels[1:]]


def cohort_codings(
    cohort: DataFrame, level: ModelLevel, settings: StudySettings
) -> dict[str, list[Column]]:
    """Spline columns for age (clipped to its outer percentiles), dummies for the rest."""
    outer = settings.winsor_percent
    inner = {f"k{i}": round(100 * i / level.df_age) for i in range(1, level.df_age)}
    row = percentile_type2(cohort, [], "age", {"lo": outer, **inner, "hi": 100 - outer}).first()
    knots = sorted({row["lo"], *[row[k] for k in inner], row["hi"]})
    unit = (clip(F.col("age").cast("double"), F.lit(knots[0]), F.lit(knots[-1])) - knots[0]) / (
        knots[-1] - knots[0]
    )
    scaled = [(k - knots[0]) / (knots[-1] - knots[0]) for k in knots]
    codings = {"age": spline_basis(unit, scaled)}
    for variable in ("sex", "stage", "daar_grp"):
        # The levels of one covariate, a handful of values.
        levels = sorted(r[0] for r in cohort.select(variable).distinct().collect())
        codings[variable] = dummies(variable, levels)
    return codings


@dataclass
class Fit:
    """Coefficients with their covariance; `classes` for a multinomial model.

    `converged` is false where the iterations ended before the fit did.
    """

    beta: np.ndarray
    covariance: np.ndarray
    classes: list[int] = field(default_factory=list)
    rmse: float = 0.0
    residual_df: float = 0.0
    knots: list[float] = field(default_factory=list)
    limits: tuple[float, float] = (0.0, 0.0)
    converged: bool = True


def _weighted_gram(frame: DataFrame, width: int, blocks: int) -> np.ndarray:
    """Sum over rows of kron(w, x x') from columns `x` (width) and `w` (blocks x blocks).

    Each task adds up its own matrix; only matrix cells are shuffled.
    """
    size = width * blocks

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_list())
            w = np.stack(batch["w"].to_list()).reshape(-1, blocks, blocks)
            total += np.einsum("mab,mi,mj->aibj", w, x, x).reshape(size, size)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = (
        frame.select("x", "w")
        .mapInPandas(partial, "i long, j long, v double")
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
    )
    out = np.zeros((size, size))
    for row in cells.collect():
        out[row["i"], row["j"]] = row["v"]
    return out


def _design(columns: Sequence[Column]) -> Column:
    return F.array(*[c.cast("double") for c in (*columns, F.lit(1.0))])


def _categorical(
    counts: DataFrame, name: str, variable: str, terms: Sequence[Term],
    codings: Mapping[str, Sequence[Column]],
) -> tuple[DataFrame, newton.Problem, list[int]]:
    """Patterns of a multinomial logit, from `counts` with the covariates and n."""
    used = sorted({v for term in terms for v in term})
    patterns = counts.groupBy(*used, variable).agg(F.sum("n").cast("double").alias("n"))
    # The levels of one covariate, a handful of values.
    classes = sorted(r[0] for r in counts.select(variable).distinct().collect())
    columns = term_columns(terms, codings)
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(variable)) - 1
    rows = patterns.select(
        F.lit(name).alias("fit"), label.cast("double").alias("label"), "n",
        _design(columns).alias("x"),
    )
    return rows, newton.Problem(len(classes), len(columns) + 1), classes


def fit_categorical(
    cohort: DataFrame,
    variable: str,
    terms: Sequence[Term],
    codings: Mapping[str, Sequence[Column]],
    ridge: float = 1e-6,
) -> Fit:
    """Multinomial logit from counts per covariate pattern and class.

    Coefficients are relative to the first class: one row per other class, the
    columns being the design and the constant.
    """
    used = sorted({v for term in terms for v in term})
    counts = cut(cohort.groupBy(*used, variable).agg(F.count("*").alias("n")), "patterns")
    rows, problem, classes = _categorical(counts, variable, variable, terms, codings)
    return _fit(newton.solve(rows, {variable: problem}, ridge)[variable], classes)


def _fit(solved: newton.Solution, classes: Sequence[int] = ()) -> Fit:
    beta = solved.beta if classes else solved.beta[0]
    return Fit(beta, solved.covariance, list(classes), converged=solved.converged)


def normal_scores(cohort: DataFrame, value: str, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Unique rank of `value` (ties by id) as a standard normal quantile."""
    ranked = row_numbers(cohort, keys, [value, "id"], "_rank")
    sizes = cohort.groupBy(*keys).agg(F.count("*").alias("_n"))
    share = (F.col("_rank") - F.lit(0.5)) / F.col("_n")
    return ranked.join(sizes, list(keys)).withColumn("score", normal_quantile(share)).drop("_n")


def fit_continuous(
    cohort: DataFrame,
    value: str = "age",
    terms: Sequence[Term] = (),
    codings: Mapping[str, Sequence[Column]] | None = None,
    pieces: int = 8,
    keys: Sequence[str] = ("site",),
) -> Fit:
    """Regression of a value on a spline of its normal score (and earlier variables)."""
    scored = cut(normal_scores(cohort, value, keys), "scores")
    limits = scored.agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.min(value).cast("double").alias("vlo"), F.max(value).cast("double").alias("vhi"),
        F.count("*").alias("n"),
    ).first()
    knots = equally_spaced_knots(limits["lo"], limits["hi"], pieces)
    design = [*continuous_design("score", knots), *term_columns(terms, codings or {}), F.lit(1.0)]
    width = len(design)
    # Moments of the design and the value in one pass.
    rows = scored.select(
        F.array(*[c.cast("double") for c in design], F.col(value).cast("double")).alias("x"),
        F.array(F.lit(1.0)).alias("w"),
    )
    moments = _weighted_gram(rows, width + 1, 1)
    xx, xy, yy = moments[:width, :width], moments[:width, width], moments[width, width]
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    df = max(float(limits["n"]) - width, 1.0)
    rmse = math.sqrt(max(yy - beta @ xy, 0.0) / df)
    return Fit(
        beta, inverse * rmse**2, [], rmse, df, knots, (float(limits["vlo"]), float(limits["vhi"]))
    )


def continuous_design(score: str | Column, knots: Sequence[float]) -> list[Column]:
    """Spline columns, the cubic ones scaled by the squared knot range."""
    scale = (knots[-1] - knots[0]) ** 2
    linear, *cubic = spline_basis(score, knots)
    return [linear, *[c / F.lit(scale) for c in cubic]]


@dataclass(frozen=True)
class TimeScale:
    """Interval starts in years, the last one open, and how effects vary over intervals.

    A varying effect is a combination of functions of time; `weights` has a row for each
    with its value in every interval.
    """

    cuts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]


def time_scale(cohort: DataFrame, level: ModelLevel) -> TimeScale:
    """Intervals with equal shares of the events, and splines of log time over them.

    Borders are percentiles of the event times of `cohort`, one site; `level.df` intervals
    unless ties leave fewer. The splines are evaluated at the middle percentile of each
    interval, with knots at equal steps of those. Without events there is one interval.
    """
    return time_scales(cohort, [level])[level]


def time_scales(cohort: DataFrame, levels: Sequence[ModelLevel]) -> dict[ModelLevel, TimeScale]:
    """`time_scale` of several levels from one pass."""
    asked = {
        level: {
            **{f"b{i}": max(1, round(100 * i / level.df)) for i in range(1, level.df)},
            **{f"m{i}": max(1, round(100 * (i + 0.5) / level.df)) for i in range(level.df)},
        }
        for level in levels
    }
    percents = sorted({p for of in asked.values() for p in of.values()})
    events = cohort.filter("status = 1")
    found = percentile_type2(events, [], "t", {f"p{p}": p for p in percents}).first()
    return {
        level: _time_scale(level, {name: found[f"p{p}"] for name, p in of.items()})
        for level, of in asked.items()
    }


def _time_scale(level: ModelLevel, row: Mapping[str, float | None]) -> TimeScale:
    pieces = level.df
    if row["m0"] is None:
        return TimeScale((0.0,), ())
    borders = sorted({row[f"b{i}"] for i in range(1, pieces)} - {0.0})
    middles = sorted(row[f"m{i}"] for i in range(pieces))
    starts = (0.0, *borders)
    inside = [
        [m for m in middles if lo < m <= hi] or [lo / 2 + min(hi, 2 * lo + 1) / 2]
        for lo, hi in zip(starts, (*borders, math.inf))
    ]
    logs = np.log([np.median(x) for x in inside])
    spans = min(level.df_tvc, len(starts) - 1)
    if not spans:
        return TimeScale(starts, ())
    unit = (logs - logs[0]) / (logs[-1] - logs[0])
    knots = np.quantile(unit, np.linspace(0, 1, spans + 1))
    values = spline_values(unit, knots.tolist()).T
    return TimeScale(starts, tuple(tuple(row) for row in values.tolist()))


def survival_parts(
    level: ModelLevel, codings: Mapping[str, Sequence[Column]]
) -> tuple[list[Column], list[Column]]:
    """Covariate terms, and covariates whose effect varies over time."""
    terms = model_terms(level, [v for v in ("age", "sex", "stage", "daar_grp") if v in codings])
    varying = [c for v in level.tvc for c in codings[v]]
    return term_columns(terms, codings), varying


def survival_design(
    level: ModelLevel, codings: Mapping[str, Sequence[Column]], scale: TimeScale
) -> list[Column]:
    """Interval dummies, covariate terms, covariates times functions of time, constant."""
    intervals = len(scale.cuts)
    steps = [(F.col("interval") == F.lit(j)).cast("double") for j in range(1, intervals)]
    terms, varying = survival_parts(level, codings)
    over_time = [
        F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("interval"))
        for weights in scale.weights
    ]
    return [*steps, *terms, *[s * c for s in over_time for c in varying], F.lit(1.0)]


def interval_hazards(
    beta: Column, terms: Column, varying: Column, sizes: tuple[int, int], scale: TimeScale
) -> Column:
    """Hazard of every interval from the coefficients of `survival_design` and the values of
    its terms and varying covariates (arrays of the given sizes)."""
    n_terms, n_varying = sizes
    intervals = len(scale.cuts)
    first = intervals - 1
    last = first + n_terms + len(scale.weights) * n_varying
    shared = F.get(beta, F.lit(last))
    if n_terms:
        shared = shared + dot(F.slice(beta, first + 1, n_terms), terms)
    effects = [
        dot(F.slice(beta, first + n_terms + k * n_varying + 1, n_varying), varying)
        for k in range(len(scale.weights) if n_varying else 0)
    ]
    hazards = []
    for j in range(intervals):
        eta = shared
        if j > 0:
            eta = eta + F.get(beta, F.lit(j - 1))
        for weights, effect in zip(scale.weights, effects):
            eta = eta + F.lit(float(weights[j])) * effect
        hazards.append(F.exp(eta))
    return F.array(*hazards)


def _survival(
    spent: DataFrame, name: str, level: ModelLevel, codings: Mapping[str, Sequence[Column]],
    scale: TimeScale,
) -> tuple[DataFrame, newton.Problem]:
    """Patterns of a Poisson regression, from events and exposure per pattern and interval."""
    *columns, _ = survival_design(level, codings, scale)
    rows = spent.filter("exposure > 0").select(
        F.lit(name).alias("fit"), F.col("d").cast("double").alias("label"),
        F.col("exposure").alias("n"), _design(columns).alias("x"),
    )
    return rows, newton.Problem(0, len(columns) + 1)


def fit_survival(
    cohort: DataFrame,
    level: ModelLevel,
    codings: Mapping[str, Sequence[Column]],
    scale: TimeScale | None = None,
    ridge: float = 1e-6,
) -> Fit:
    """Piecewise exponential hazard with time-varying effects, as a Poisson regression
    on events and person-years per pattern and interval (`time_scale` by default).

    `ridge` keeps effects finite where a cell has no events. It applies to the decorrelated
    design, as a share of the events.
    """
    scale = scale or time_scale(cohort, level)
    spent = event_exposure(cohort, sorted(codings), scale.cuts)
    rows, problem = _survival(spent, "t", level, codings, scale)
    return _fit(newton.solve(rows, {"t": problem}, ridge)["t"])


def covariance_root(fit: Fit) -> np.ndarray:
    """A matrix whose product with its transpose is the covariance."""
    values, vectors = np.linalg.eigh((fit.covariance + fit.covariance.T) / 2)
    return vectors * np.sqrt(np.clip(values, 0.0, None))


def draw_coefficients(
    fit: Fit, draws: int, seed: int | Sequence[int], root: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(draws x coefficients, draws residual spreads) from the normal approximation.

    Directions without variance keep their estimate. For a regression the spread is
    redrawn from its chi-square distribution first. `root` is `covariance_root(fit)`, where
    it is known already.
    """
    rng = np.random.default_rng(seed)
    root = covariance_root(fit) if root is None else root
    noise = rng.standard_normal((draws, len(root)))
    spread = np.full(draws, fit.rmse)
    if fit.residual_df:
        spread = fit.rmse * np.sqrt(fit.residual_df / rng.chisquare(fit.residual_df, draws))
        noise = noise * (spread / fit.rmse)[:, None] if fit.rmse > 0 else noise
    return fit.beta.ravel() + noise @ root.T, spread


@dataclass
class FittedChain:
    """All submodels of one level, fitted to one site."""

    level: ModelLevel
    codings: dict[str, list[Column]]
    terms: dict[str, list[Term]]
    fits: dict[str, Fit]
    scale: TimeScale

    @property
    def cuts(self) -> tuple[float, ...]:
        return self.scale.cuts

    @property
    def converged(self) -> bool:
        return all(fit.converged for fit in self.fits.values())


def fit_chains(
    cohort: DataFrame,
    settings: StudySettings,
    models: Sequence[int],
    ridge: float = 1e-6,
) -> dict[int, FittedChain]:
    """Age, then each later variable given the earlier ones, then time, for all models.

    `cohort` holds one site and is read several times: pass a written table. The
    submodels of all models are fitted by the same jobs.
    """
    covariates = sorted({"age", *settings.sequence[1:]})
    levels = list(dict.fromkeys(MODEL_LEVELS[m] for m in models))
    # Levels with the same knots share their codings.
    like = {level.df_age: level for level in reversed(levels)}
    # Jobs of their own that do not wait for each other.
    with ThreadPoolExecutor(4) as pool:
        age_fit = pool.submit(fit_continuous, cohort)
        scaled = pool.submit(time_scales, cohort, levels)
        counted = pool.submit(
            lambda: cut(cohort.groupBy(*covariates).agg(F.count("*").alias("n")), "counts")
        )
        codes = {df: pool.submit(cohort_codings, cohort, like[df], settings) for df in like}
        scales = scaled.result()
        episodes = {
            cuts: pool.submit(
                lambda cuts: cut(event_exposure(cohort, covariates, cuts), "episodes"), cuts
            )
            for cuts in {s.cuts for s in scales.values()}
        }
        age_fit, counts = age_fit.result(), counted.result()
        coded = {df: found.result() for df, found in codes.items()}
        spent = {cuts: found.result() for cuts, found in episodes.items()}
    chains, parts, problems, classes = {}, [], {}, {}
    for model in models:
        level = MODEL_LEVELS[model]
        codings, scale = coded[level.df_age], scales[level]
        terms, earlier = {}, ["age"]
        for variable in settings.sequence[1:]:
            terms[variable] = model_terms(level, earlier)
            name = f"{model} {variable}"
            rows, problems[name], classes[name] = _categorical(
                counts, name, variable, terms[variable], codings
            )
            parts.append(rows)
            earlier.append(variable)
        rows, problems[f"{model} t"] = _survival(
            spent[scale.cuts], f"{model} t", level, codings, scale
        )
        parts.append(rows)
        chains[model] = FittedChain(level, codings, terms, {"age": age_fit}, scale)
    solved = newton.solve(reduce(DataFrame.unionByName, parts), problems, ridge)
    for model, chain in chains.items():
        for variable in (*settings.sequence[1:], "t"):
            name = f"{model} {variable}"
            chain.fits[variable] = _fit(solved[name], classes.get(name, ()))
    return chains


def synthesize_fitted(
    cohort: DataFrame,
    settings: StudySettings,
    models: Sequence[int],
    sims: int,
    site: str,
    seed: int = 0,
    chains: Mapping[int, FittedChain] | None = None,
    members: Column | None = None,
) -> DataFrame:
    """Synthetic cohorts of all requested models and runs.

    Only rows of `site` are fitted and drawn. Each model is fitted once (or given as
    `chains`) to the rows for which `members` is true, all by default; each run uses its
    own coefficient draw. The cohort's numbered rows serve as slots, so a run has as many
    persons as the whole cohort.
    """
    spark = cohort.sparkSession
    cohort = cut(cohort.filter(F.col("site") == site), "cohort")
    if chains is None:
        fitted = cohort if members is None else cut(cohort.filter(members), "members")
        chains = fit_chains(fitted, settings, models)
    numbered = row_numbers(cohort.select("site", "id"), ["site"], ["id"], "slot")
    slots = cut(spread(numbered.select("site", F.col("slot").alias("id"))), "slots")
    order = [*settings.sequence, "t"]
    vectors = {
        (m, v): draw_coefficients(chains[m].fits[v], sims, seed + 1000 * m + purpose)[0]
        for m in models
        for purpose, v in enumerate(order)
    }
    coded: dict[int, dict] = {}
    for m in models:
        # Models with the same codings and classes share their values.
        like = next((o for o in coded if _same_codings(chains[o], chains[m], settings)), None)
        coded[m] = _coding_values(spark, chains[m], settings) if like is None else coded[like]
    drawer = {m: _Drawer(chains[m], coded[m]) for m in models}
    dates = {
        m: diagnosis_dates(chains[m].fits["daar_grp"].classes, settings) for m in models
    }
    # One row a site: what the draws of its slots start from.
    starts = spark.createDataFrame([(site,)], "site string").select(
        "site", F.xxhash64("site").alias("_start")
    )
    rows = join_constants(slots, starts, ["site"]).select("id", "_start")
    kept = ["model int", "sim int", f"id {rows.schema['id'].dataType.simpleString()}"]
    values = [*[f"{v} int" for v in settings.sequence], "diag_date date", "_days int"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, start in _stretches(batches, STRETCH):
            for m in models:
                for s in range(sims):
                    betas = {v: vectors[m, v][s] for v in order}
                    run = _Run(drawer[m], settings.sequence, betas, len(ids))
                    key = hashed_int(s + 1, hashed_int(m, start))
                    for at in range(0, len(ids), BATCH):
                        own = ids[at : at + BATCH]
                        bits = hashed_long(own, key)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(own), m, np.int32)),
                                pa.array(np.full(len(own), s + 1, np.int32)),
                                pa.array(own, rows_type),
                                *run(bits, dates[m], settings),
                            ],
                            names=names,
                        )

    rows_type = pa.int64() if kept[-1].endswith("bigint") else pa.int32()
    names = [c.split()[0] for c in (*kept, *values)]
    drawn = rows.mapInArrow(draw, ", ".join([*kept, *values]))
    return finish_draws(drawn.select(F.lit(site).alias("site"), *names), settings)


#: Slots that meet all runs together, and rows drawn at once.
STRETCH, BATCH = 1 << 17, 1 << 14


def _stretches(
    batches: Iterator[pa.RecordBatch], most: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to about `most` ids at a time, and the hash that their draws start from."""
    held: list[np.ndarray] = []
    start = np.zeros(1, np.uint64)
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column("id").to_numpy(zero_copy_only=False))
            start = batch.column("_start").to_numpy(zero_copy_only=False)[:1].view(np.uint64)
        if sum(map(len, held)) >= most:
            yield np.concatenate(held), start
            held = []
    if held:
        yield np.concatenate(held), start


def _same_codings(one: FittedChain, other: FittedChain, settings: StudySettings) -> bool:
    return one.codings is other.codings and all(
        (a.classes, a.limits) == (b.classes, b.limits)
        for a, b in ((one.fits[v], other.fits[v]) for v in settings.sequence)
    )


def _coding_values(
    spark: SparkSession, chain: FittedChain, settings: StudySettings
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per covariate every value that can be drawn, ascending, and its coded columns.

    Ages are whole and kept near the observed ones; the other covariates have a few classes.
    """
    found = {}
    for variable in settings.sequence:
        fit = chain.fits[variable]
        if variable == "age":
            low, high = (math.floor(v + 0.5) for v in (fit.limits[0] - 1, fit.limits[1] + 1))
            values = list(range(low, high + 1))
        else:
            values = sorted(fit.classes)
        known = spark.createDataFrame([(v,) for v in values], f"{variable} int")
        coded = F.array(*[c.cast("double") for c in chain.codings[variable]])
        rows = sorted(known.select(variable, coded).collect())
        columns = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        found[variable] = np.array([r[0] for r in rows]), columns
    return found


class _Drawer:
    """Covariates in sequence and hazards of many rows, each with its run's coefficients."""

    def __init__(
        self, chain: FittedChain, coded: Mapping[str, tuple[np.ndarray, np.ndarray]]
    ) -> None:
        self.level, self.terms, self.scale, self.coded = chain.level, chain.terms, chain.scale, coded
        self.limits, self.knots = chain.fits["age"].limits, chain.fits["age"].knots
        self.classes = {v: np.array(chain.fits[v].classes) for v in chain.terms}

    def _columns(self, variable: str, drawn: np.ndarray) -> list[np.ndarray]:
        values, columns = self.coded[variable]
        return list(columns[np.searchsorted(values, drawn)].T)

    def age(self, beta: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Prediction kept near the observed range and rounded."""
        basis = spline_values(score, self.knots)
        basis[:, 1:] /= (self.knots[-1] - self.knots[0]) ** 2
        return self.whole_ages((beta[:, :-1] * basis).sum(1) + beta[:, -1])

    def age_weights(self, beta: np.ndarray) -> np.ndarray:
        """Weights of the unscaled spline columns, then the constant."""
        weights = beta.copy()
        weights[1:-1] /= (self.knots[-1] - self.knots[0]) ** 2
        return weights

    def whole_ages(self, value: np.ndarray) -> np.ndarray:
        value = np.clip(value, self.limits[0] - 0.49999, self.limits[1] + 0.49999)
        return (np.sign(value) * np.floor(np.abs(value) + 0.5)).astype(np.int64)

    def shares(self, variable: str, beta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cumulative shares of the classes, up to a factor, by row of the design."""
        classes = self.classes[variable]
        eta = np.zeros((len(x), len(classes)))
        if len(classes) > 1:
            eta[:, 1:] = (beta.reshape(len(beta), len(classes) - 1, -1) * x[:, None]).sum(2)
        return np.exp(eta - eta.max(1, keepdims=True)).cumsum(1)

    def category(
        self, variable: str, beta: np.ndarray, x: np.ndarray, u: np.ndarray
    ) -> np.ndarray:
        """Class whose cumulative probability first exceeds `u`."""
        classes = self.classes[variable]
        upto = self.shares(variable, beta, x)
        passed = (upto <= (u * upto[:, -1])[:, None]).sum(1)
        return classes[np.minimum(passed, len(classes) - 1)]

    def hazards(self, beta: np.ndarray, codings: Mapping[str, list[np.ndarray]]) -> np.ndarray:
        """Of every interval, from the coefficients of `survival_design`."""
        terms, varying = survival_parts(self.level, codings)
        intervals = len(self.scale.cuts)
        parts = np.split(
            beta,
            np.cumsum([intervals - 1, len(terms), *[len(varying)] * len(self.scale.weights)]),
            axis=1,
        )
        eta = np.repeat(parts[-1][:, -1:], intervals, axis=1)
        for k, column in enumerate(terms):
            eta += (parts[1][:, k] * column)[:, None]
        eta[:, 1:] += parts[0]
        for weights, part in zip(self.scale.weights, parts[2:-1]):
            effect = sum(part[:, k] * column for k, column in enumerate(varying))
            eta += np.multiply.outer(effect, weights) if varying else 0.0
        with np.errstate(over="ignore"):
            return np.exp(eta)

    def __call__(
        self, order: Sequence[str], betas: Mapping[str, np.ndarray], noise: Mapping[str, np.ndarray]
    ) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Drawn values by covariate, and hazards by row and interval."""
        drawn: dict[str, np.ndarray] = {}
        codings: dict[str, list[np.ndarray]] = {}
        for variable in order:
            if variable == "age":
                drawn[variable] = self.age(betas[variable], noise[variable])
            else:
                columns = term_columns(self.terms[variable], codings)
                x = np.stack([*columns, np.ones(len(noise[variable]))], axis=1)
                drawn[variable] = self.category(variable, betas[variable], x, noise[variable])
            codings[variable] = self._columns(variable, drawn[variable])
        return drawn, self.hazards(betas["t"], codings)


class _Run:
    """Draws of one run. Where many rows share the combinations of values that can be drawn,
    shares and hazards are worked out once for every combination."""

    def __init__(
        self, drawer: _Drawer, order: Sequence[str], betas: Mapping[str, np.ndarray], rows: int
    ) -> None:
        self.drawer, self.order, self.betas = drawer, list(order), betas
        self.sizes = {v: len(drawer.coded[v][0]) for v in self.order}
        self.upto: dict[str, np.ndarray] = {}
        self.rates: np.ndarray | None = None
        if self.order[0] == "age" and math.prod(self.sizes.values()) <= rows:
            self.knots = np.array(drawer.knots)
            self.cubics = spline_cubics(drawer.age_weights(betas["age"]), drawer.knots)
            for k, variable in enumerate(self.order[1:], start=1):
                codings, count = self._grid(self.order[:k])
                columns = term_columns(drawer.terms[variable], codings)
                x = np.stack([*columns, np.ones(count)], axis=1)
                self.upto[variable] = drawer.shares(variable, betas[variable][None], x)
            codings, count = self._grid(self.order)
            hazards = np.broadcast_to(betas["t"], (count, len(betas["t"])))
            self.rates = drawer.hazards(hazards, codings)

    def _grid(self, variables: Sequence[str]) -> tuple[dict[str, list[np.ndarray]], int]:
        """Coded columns of all combinations, the last variable changing fastest."""
        index = np.indices([self.sizes[v] for v in variables]).reshape(len(variables), -1)
        coded = {v: list(self.drawer.coded[v][1][i].T) for v, i in zip(variables, index)}
        return coded, index.shape[1]

    def __call__(
        self, bits: np.ndarray, dates: Sequence[np.ndarray], settings: StudySettings
    ) -> list[pa.Array]:
        """Covariates, diagnosis date and days of follow-up of rows with the hashes `bits`."""
        drawer, n = self.drawer, len(bits)
        noise = {
            v: (normal_of if v == "age" else uniform_of)(hashed_int(purpose, bits))
            for purpose, v in enumerate((*self.order, "t"))
        }
        if self.rates is None:
            betas = {v: np.broadcast_to(b, (n, len(b))) for v, b in self.betas.items()}
            drawn, rates = drawer(self.order, betas, noise)
            cell = np.arange(n)
        else:
            drawn, rates = {}, self.rates
            for variable in self.order:
                values = drawer.coded[variable][0]
                if variable == "age":
                    score = noise[variable]
                    piece = np.searchsorted(self.knots, score, side="right")
                    a, b, c, d = (cubic[piece] for cubic in self.cubics)
                    drawn[variable] = drawer.whole_ages(((d * score + c) * score + b) * score + a)
                    cell = drawn[variable] - values[0]
                else:
                    *upto, last = self.upto[variable].T
                    level = noise[variable] * last[cell]
                    passed = np.zeros(n, np.int64)
                    for share in upto:
                        passed += share[cell] <= level
                    drawn[variable] = values[passed]
                    cell = cell * len(values) + passed
        days = survival_days(rates, cell, noise["t"], drawer.scale.cuts, settings.max_follow_up)
        group = np.searchsorted(drawer.classes["daar_grp"], drawn["daar_grp"])
        size = np.array([len(d) for d in dates])
        first = np.cumsum(size) - size
        day = np.floor(uniform_of(hashed_int(99, bits)) * size[group]).astype(np.int64)
        born = np.concatenate(dates)[first[group] + day]
        return [
            *[pa.array(drawn[v].astype(np.int32)) for v in self.order],
            pa.array(born, pa.int32()).cast(pa.date32()),
            pa.array(days),
        ]


def per_run(
    real: DataFrame,
    synthetic: DataFrame,
    fit: Callable[[DataFrame, DataFrame], DataFrame],
    keys: Sequence[str] = RUN,
    at_once: int = 3,
    path: str | None = None,
) -> DataFrame:
    """`fit(real, synthetic)` of every run of `synthetic`, with the run's keys.

    Each run is a fit of its own, `at_once` of them at a time; its rows are written to a
    folder of its own below `path` (by default a fresh one). A study that was stopped goes
    on from the same `path`: runs that ended are read, not fitted again; one that was
    being written is written anew. Real rows may carry fewer keys than synthetic ones. A
    run without real rows is fitted on none and fails.
    """
    spark = synthetic.sparkSession
    keys = run_keys(synthetic.columns, keys)
    # One row per run, bounded by the study's design.
    runs = sorted(synthetic.select(*keys).distinct().collect())
    folder = (path or scratch_path(spark, "per_run")).rstrip("/")
    paths = [f"{folder}/" + "-".join(f"{k}={run[k]}" for k in keys) for run in runs]

    def only(frame: DataFrame, run: Row) -> DataFrame:
        for key in keys:
            if key in frame.columns:
                frame = frame.filter(F.col(key) == run[key])
        return frame

    def fitted(number: int) -> None:
        run = runs[number]
        out = fit(only(real, run), only(synthetic, run)).drop(*keys)
        out = out.select(*[F.lit(run[k]).alias(k) for k in keys], *out.columns)
        out.write.mode("overwrite").parquet(paths[number])

    left = [n for n, p in enumerate(paths) if not is_written(spark, p)]
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(fitted, left))
    return spark.read.parquet(*paths)


def attribute_predictions(
    synthetic: DataFrame,
    real: DataFrame,
    settings: StudySettings,
    trees: int = 40,
    depth: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Class probabilities of the sensitive value from the identifiers, for real rows.

    The forest is trained on the synthetic rows. Adds `guess` and `probs`, the latter
    in the order of the study's stages.
    """
    stages = list(settings.stages)
    codes = F.array(*[F.lit(s) for s in stages])
    label = (F.array_position(codes, F.col(settings.sensitive)) - 1).cast("double")
    assembler = VectorAssembler(inputCols=list(settings.identifiers), outputCol="features")
    train = cut(
        assembler.transform(synthetic).select("features", label.alias("label")), "features"
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, subsamplingRate=0.75, minInstancesPerNode=3, seed=seed
    ).fit(train)
    scored = forest.transform(assembler.transform(real)).withColumn(
        "probs", vector_to_array("probability")
    )
    # A stage that was never seen in training has no entry in the forest's output.
    known = F.size("probs")
    probs = F.array(
        *[
            F.when(F.lit(i) < known, F.get("probs", F.lit(i))).otherwise(F.lit(0.0))
            for i in range(len(stages))
        ]
    )
    guess = F.element_at(codes, (F.col("prediction") + 1).cast("int"))
    return scored.withColumn("probs", probs).withColumn("guess", guess).drop(
        "features", "rawPrediction", "probability", "prediction"
    )
