"""Fit, score and measure models over covariate sets and poverty lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pmtspark.operators.design import COVARIATE_SETS, Design
from pmtspark.operators.forests import fits_in_tasks, held_forest, replicate_forests
from pmtspark.operators.learners import (
    fit_forest,
    fold_grams,
    forest,
    forest_rows,
    lasso_cv,
    lasso_design,
)
from pmtspark.operators.measures import attach_lines, line_array, targeting_measures
from pmtspark.operators.quantile import weighted_quantile
from pmtspark.operators.regression import fit_from_grams, score, wls
from pmtspark.operators.replicates import (
    Chunk,
    drawn,
    linear_values,
    packed_rows,
    replicate_bits,
    replicate_grams,
    replicate_quantiles,
    replicate_targeting,
)
from pmtspark.operators.resample import bootstrap_ci, split_half
from pmtspark.operators.reshape import stack_frames, unpivot_measures
from pmtspark.sources import materialise

LINES = (0.2, 0.4)
MODELS = ("OLS", "Random Forest", "LASSO")
KEYS = ("z", "covariates", "model", "measure")


@dataclass(frozen=True)
class Setup:
    """Column roles and model settings shared by all runs."""

    id_col: str = "HHID"
    outcome: str = "cpp"
    weight: str = "mult"
    seed: int = 1896
    forest: Mapping[str, int] = field(default_factory=lambda: {"trees": 500, "depth": 30})

    @property
    def label(self) -> Column:
        return F.log(F.col(self.outcome))


def experiment_grid(
    spark: SparkSession, qs: Sequence[float], covariates: Sequence[str]
) -> DataFrame:
    """Every (z, covariates) pair, z varying fastest."""
    rows = [(float(q), c) for c in covariates for q in qs]
    return spark.createDataFrame(rows, "z double, covariates string")


def predict(
    train: DataFrame, rows: DataFrame, design: Design, model: str, setup: Setup, out: str
) -> DataFrame:
    """Add the predicted outcome of ``model`` fitted on ``train`` to ``rows``.

    OLS uses the survey weights, forest and LASSO do not.
    """
    if model == "OLS":
        fit = wls(train, design, setup.label, F.col(setup.weight))
        scored = score(rows, fit, design, out)
    elif model == "Random Forest":
        held = fits_in_tasks(train.count() + rows.count(), len(design.terms))
        grow = held_forest if held else forest
        scored = grow(train, rows, design, setup.label, seed=setup.seed, out=out, **setup.forest)
    elif model == "LASSO":
        wide = lasso_design(design)
        grams = fold_grams(train, wide, setup.label, setup.id_col, setup.seed)
        fit = lasso_cv(grams, len(wide.columns())).select("beta")
        scored = score(rows, fit, wide, out)
    else:
        raise ValueError(f"unknown model: {model}")
    return scored.withColumn(out, F.exp(out))


def _split(df: DataFrame, test: str | None) -> tuple[DataFrame, DataFrame]:
    return (df, df) if test is None else (df.filter(~F.col(test)), df.filter(test))


def _narrow(
    df: DataFrame, designs: Mapping[str, Design], setup: Setup, test: str | None
) -> DataFrame:
    """The columns that models and measures take."""
    needed = {t for d in designs.values() for t in d.terms}
    roles = (setup.id_col, setup.outcome, setup.weight, *([test] if test else []))
    return df.select(*roles, *sorted(needed - set(roles)))


def score_series(
    df: DataFrame,
    designs: Mapping[str, Design],
    models: Sequence[str],
    setup: Setup,
    test: str | None = None,
) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Test rows with one prediction column per (covariates, model)."""
    train, rows = _split(_narrow(df, designs, setup, test), test)
    series = {}
    for model in models:
        for name, design in designs.items():
            out = f"_yhat{len(series)}"
            rows = predict(train, rows, design, model, setup, out)
            series[out] = (name, model)
    kept = rows.select(setup.id_col, setup.weight, setup.outcome, *series)
    # later passes must not fit or score again
    return materialise(kept, "scored"), series


def measure_series(
    df: DataFrame,
    scored: DataFrame,
    series: Mapping[str, tuple[str, str]],
    setup: Setup,
    qs: Sequence[float],
    test: str | None = None,
) -> DataFrame:
    """Targeting measures of several prediction columns.

    The line comes from the outcome of the training rows, each rate line from the
    predictions of the test rows; all of them are found in one pass.
    """
    train, _ = _split(df, test)
    ids = (setup.id_col, setup.weight)
    truth = train.select(*ids, F.lit("y").alias("series"), F.col(setup.outcome).alias("v"))
    tall = scored.select(*ids, setup.outcome, *series).unpivot(
        [*ids, setup.outcome], list(series), "series", "v"
    )
    both = truth.unionByName(tall.drop(setup.outcome))
    found = weighted_quantile(
        both, "v", setup.weight, qs, setup.id_col, by=["series"]
    )
    arrays = materialise(line_array(found, qs, "zhat", ["series"]), "lines")
    z = arrays.filter("series = 'y'").select(F.col("zhat").alias("z"))
    rows = attach_lines(attach_lines(tall, arrays, ["series"]), z)
    measured = targeting_measures(
        rows, qs, y=setup.outcome, yhat="v", w=setup.weight, by=["series"]
    )
    covariates, model = F.lit(None).cast("string"), F.lit(None).cast("string")
    for column, (c, m) in series.items():
        covariates = F.when(F.col("series") == column, c).otherwise(covariates)
        model = F.when(F.col("series") == column, m).otherwise(model)
    return measured.select(
        "z", covariates.alias("covariates"), model.alias("model"), "H", "IER", "EER", "TER",
        "line", "rate_line",
    )


def complete_for(df: DataFrame, designs: Mapping[str, Design]) -> DataFrame:
    """Rows known on the terms of every covariate set."""
    for design in designs.values():
        df = design.complete(df)
    return df


def model_rows(
    df: DataFrame, designs: Mapping[str, Design], setup: Setup, test: str | None
) -> DataFrame:
    """Rows known on all terms; with a split, in their own columns and written.

    Fits, scores and lines read them many times, and would find every row's half by its hash anew.
    """
    rows = complete_for(df, designs)
    return rows if test is None else materialise(_narrow(rows, designs, setup, test), "rows")


def estimate(
    df: DataFrame,
    terms: Sequence[str],
    qs: Sequence[float] = LINES,
    model: str = "OLS",
    setup: Setup | None = None,
    test: str | None = None,
    design: Design | None = None,
    covariates: str = "Basic",
) -> DataFrame:
    """Fit one model and measure its targeting; with ``test``, out of sample."""
    setup = setup or Setup()
    designs = {covariates: design or Design.of(df, terms)}
    rows = model_rows(df, designs, setup, test)
    scored, series = score_series(rows, designs, [model], setup, test)
    return measure_series(rows, scored, series, setup, qs, test)


def collect_results(
    df: DataFrame,
    qs: Sequence[float] = LINES,
    covariates: Mapping[str, Sequence[str]] = COVARIATE_SETS,
    models: Sequence[str] = MODELS,
    setup: Setup | None = None,
    test: str | None = None,
    designs: Mapping[str, Design] | None = None,
) -> DataFrame:
    """All models x covariate sets x lines, long: z, covariates, model, measure, value.

    Each model is fitted once per covariate set; lines are applied afterwards.
    """
    setup = setup or Setup()
    designs = designs or {name: Design.of(df, terms) for name, terms in covariates.items()}
    rows = model_rows(df, designs, setup, test)
    scored, series = score_series(rows, designs, models, setup, test)
    measured = measure_series(rows, scored, series, setup, qs, test)
    return unpivot_measures(measured, ["z", "covariates", "model"])


def compare_results(
    holdout: DataFrame, insample: DataFrame, intervals: DataFrame | None = None
) -> DataFrame:
    """Holdout values next to in-sample ones and, if given, bootstrap intervals."""
    joined = holdout.join(insample.withColumnRenamed("value", "value_insample"), list(KEYS))
    return joined if intervals is None else joined.join(intervals, list(KEYS))


def flag_replicates(df: DataFrame, setup: Setup, replicates: int, columns: Sequence[str]) -> DataFrame:
    """The rows' id, outcome, weight and ``columns`` with packed flags of all splits, written."""
    roles = (setup.id_col, setup.outcome, setup.weight)
    narrow = df.select(*roles, *sorted(set(columns) - set(roles)))
    return materialise(replicate_bits(narrow, setup.id_col, replicates, setup.seed), "flags")


def ols_replicates(
    df: DataFrame,
    design: Design,
    setup: Setup,
    replicates: int,
    qs: Sequence[float] = LINES,
    covariates: str = "Basic",
    flagged: DataFrame | None = None,
    z: np.ndarray | None = None,
) -> DataFrame:
    """OLS refitted on the training half of every replicate, measured on its test half.

    Rows carry their halves as bits and are never multiplied: fitting, lines and measures each
    pass over the rows once for all replicates. ``z`` are the lines of ``flagged``, if known from
    ``outcome_lines``. Returns replicate, z, line, rate_line, H, IER, EER, TER, model and
    covariates.
    """
    if flagged is None:
        flagged = flag_replicates(design.complete(df), setup, replicates, design.terms)
    columns = [c for _, c in design.columns()]
    # around the means of all rows, so that cross-products keep their digits
    shift = np.zeros(len(columns))
    if design.intercept:
        means = flagged.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        shift[1:] = [m or 0.0 for m in means[1:]]
    packed = packed_rows(
        flagged, setup.id_col, setup.label, F.col(setup.weight),
        [c - float(m) if m else c for c, m in zip(columns, shift, strict=True)],
    )
    grams = replicate_grams(packed, replicates, len(columns))
    fits = fit_from_grams(grams, len(columns)).select("replicate", "beta")
    if design.intercept:
        back = [F.coalesce(F.get("beta", F.lit(i)), F.lit(0.0)) * float(m) for i, m in enumerate(shift) if m]
        const = F.get("beta", F.lit(0)) - sum(back, F.lit(0.0))
        moved = F.concat(F.array(const), F.slice("beta", 2, len(columns) - 1))
        fits = fits.select("replicate", F.when(F.col("beta").isNotNull(), moved).alias("beta"))
    return _linear_replicates(flagged, fits, design, setup, replicates, qs, "OLS", covariates, z)


def outcome_lines(
    flagged: DataFrame, setup: Setup, replicates: int, qs: Sequence[float] = LINES
) -> np.ndarray:
    """Quantiles of the outcome on the training half of every replicate: replicates x qs.

    They depend on the rows alone, so one search serves all models and covariate sets.
    """
    packed = packed_rows(flagged, setup.id_col, F.col(setup.outcome), F.col(setup.weight), [])
    return replicate_quantiles(packed, replicates, lambda c: c.y, False, qs)


def _linear_replicates(
    flagged: DataFrame,
    fits: DataFrame,
    design: Design,
    setup: Setup,
    replicates: int,
    qs: Sequence[float],
    model: str,
    covariates: str,
    z: np.ndarray | None = None,
) -> DataFrame:
    """Lines and measures of all replicates from their coefficients.

    The coefficients, replicates x columns, are sent with the tasks, which score a chunk of rows
    for all replicates at once.
    """
    columns = [c for _, c in design.columns()]
    beta = np.full((replicates, len(columns)), np.nan)
    for row in fits.collect():
        if row.beta is not None:
            beta[row.replicate - 1] = [0.0 if b is None else b for b in row.beta]
    packed = packed_rows(
        flagged, setup.id_col, F.col(setup.outcome), F.col(setup.weight), columns
    )
    values = linear_values(beta)
    if z is None:
        z = outcome_lines(flagged, setup, replicates, qs)
    zhat = replicate_quantiles(packed, replicates, values, True, qs)
    return (
        replicate_targeting(packed, replicates, values, z, zhat, qs)
        .withColumn("model", F.lit(model))
        .withColumn("covariates", F.lit(covariates))
    )


def replicate_measures(
    scored: DataFrame, setup: Setup, qs: Sequence[float] = LINES, yhat: str = "_yhat"
) -> DataFrame:
    """Measures per replicate from rows (replicate, test, outcome, prediction)."""
    narrow = scored.select(
        "replicate", "test", setup.id_col, setup.outcome, setup.weight, F.col(yhat).alias("_yhat")
    )
    kinds = narrow.select(
        "replicate",
        setup.id_col,
        setup.weight,
        F.when(F.col("test"), "zhat").otherwise("z").alias("kind"),
        F.when(F.col("test"), F.col("_yhat")).otherwise(F.col(setup.outcome)).alias("v"),
    )
    found = weighted_quantile(
        kinds, "v", setup.weight, qs, setup.id_col, by=["replicate", "kind"],
        bits=6,
    )
    slots = {
        k: F.array(*[
            F.max(F.when((F.col("kind") == k) & (F.col("q") == float(q)), F.col("value")))
            for q in qs
        ])
        for k in ("z", "zhat")
    }
    arrays = found.groupBy("replicate").agg(*[e.alias(k) for k, e in slots.items()])
    rows = attach_lines(narrow.filter("test"), arrays, ["replicate"])
    return targeting_measures(
        rows, qs, y=setup.outcome, yhat="_yhat", w=setup.weight, by=["replicate"]
    )


def oob_replicates(
    df: DataFrame,
    design: Design,
    setup: Setup,
    replicates: int,
    qs: Sequence[float] = LINES,
) -> DataFrame:
    """Fit and line from all rows; measures on ``replicates`` half samples."""
    rows = design.complete(df)
    fit = wls(rows, design, setup.label, F.col(setup.weight))
    scored = score(rows, fit, design, "_yhat").withColumn("_yhat", F.exp("_yhat"))
    flagged = flag_replicates(scored, setup, replicates, ["_yhat"])
    packed = packed_rows(
        flagged, setup.id_col, F.col(setup.outcome), F.col(setup.weight), [F.col("_yhat")]
    )

    def values(c: Chunk) -> np.ndarray:
        return c.x

    found = weighted_quantile(flagged, setup.outcome, setup.weight, qs, setup.id_col).collect()
    line = {r.q: r.value for r in found}
    z = np.tile([line.get(float(q), np.nan) for q in qs], (replicates, 1))
    zhat = replicate_quantiles(packed, replicates, values, True, qs)
    return replicate_targeting(packed, replicates, values, z, zhat, qs)


def bootstrap_results(
    df: DataFrame,
    replicates: int = 500,
    qs: Sequence[float] = LINES,
    covariates: Mapping[str, Sequence[str]] = COVARIATE_SETS,
    models: Sequence[str] = MODELS,
    setup: Setup | None = None,
) -> DataFrame:
    """Long results of every replicate: replicate + z, covariates, model, measure, value.

    OLS and LASSO take a fixed number of passes for all replicates. The forest has no such
    form and is refitted per replicate, so its cost grows with ``replicates``: whole forests are
    dealt to tasks that hold the rows, or, of more rows, fitted one by one over the cluster.
    """
    setup = setup or Setup()
    designs = {name: Design.of(df, terms) for name, terms in covariates.items()}
    rows = complete_for(df, designs)
    terms = {t for d in designs.values() for t in d.terms}
    flagged = flag_replicates(rows, setup, replicates, sorted(terms))
    linear = {"OLS", "LASSO"} & set(models)
    z = outcome_lines(flagged, setup, replicates, qs) if linear else None
    parts = []
    for name, design in designs.items():
        if "OLS" in models:
            parts.append(ols_replicates(flagged, design, setup, replicates, qs, name, flagged, z))
        if "LASSO" in models:
            parts.append(_lasso_replicates(flagged, design, setup, replicates, qs, name, z))
        if "Random Forest" in models:
            parts.append(_forest_replicates(flagged, design, setup, replicates, qs, name))
    ids = ["replicate", "z", "covariates", "model"]
    return unpivot_measures(stack_frames(parts), ids)


def _lasso_replicates(
    flagged: DataFrame, design: Design, setup: Setup, replicates: int, qs, name: str, z: np.ndarray
) -> DataFrame:
    wide = lasso_design(design)
    columns = [c for _, c in wide.columns()]
    grams = fold_grams(
        flagged, wide, setup.label, setup.id_col, setup.seed, bits="test_bits", replicates=replicates
    )
    fits = lasso_cv(grams, len(columns)).select("replicate", "beta")
    return _linear_replicates(flagged, fits, wide, setup, replicates, qs, "LASSO", name, z)


def _forest_replicates(
    flagged: DataFrame, design: Design, setup: Setup, replicates: int, qs, name: str
) -> DataFrame:
    """Forests refitted on every replicate's training half and applied to its test half.

    Training rows give the line of the outcome, and no prediction is asked of them.
    """
    if fits_in_tasks(flagged.count(), len(design.terms), replicates):
        roles = [setup.id_col, setup.outcome, setup.weight]
        scored = replicate_forests(
            flagged, design, setup.label, roles, replicates, setup.seed, **setup.forest
        )
        scored = scored.withColumn("_yhat", F.exp("_yhat"))
    else:
        scored = _passed_forests(flagged, design, setup, replicates)
    return (
        replicate_measures(materialise(scored, "forest"), setup, qs)
        .withColumn("model", F.lit("Random Forest"))
        .withColumn("covariates", F.lit(name))
    )


def _passed_forests(flagged: DataFrame, design: Design, setup: Setup, replicates: int) -> DataFrame:
    """Every replicate's rows, scored by a forest fitted by passes over rows that no task can hold.

    The rows' vectors are the same in all replicates, so they are made once and held until all
    forests are fitted; a replicate's rows are written before the next forest, which lets go of it.
    """
    roles = [setup.id_col, setup.outcome, setup.weight]
    labelled = flagged.withColumn("_label", setup.label)
    held = forest_rows(labelled, design, [*roles, "_label", "test_bits"]).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    parts = []
    try:
        for r in range(replicates):
            test = drawn("test_bits", F.lit(r))
            train = held.filter(~test)
            fitted = fit_forest(
                train.filter("_label IS NOT NULL"), len(design.terms), seed=setup.seed, out="_yhat",
                **setup.forest,
            )
            own = [*roles, F.lit(r + 1).alias("replicate")]
            plain = train.select(*own, F.lit(False).alias("test"), F.lit(None).cast("double").alias("_yhat"))
            scored = fitted.transform(held.filter(test))
            scored = scored.select(*own, F.lit(True).alias("test"), F.exp("_yhat").alias("_yhat"))
            parts.append(materialise(stack_frames([plain, scored]), "forest"))
    finally:
        held.unpersist()
    return stack_frames(parts)


def holdout_flag(df: DataFrame, setup: Setup) -> DataFrame:
    return split_half(df, setup.id_col, setup.seed)


__all__ = [
    "KEYS",
    "LINES",
    "MODELS",
    "Setup",
    "bootstrap_ci",
    "bootstrap_results",
    "collect_results",
    "compare_results",
    "estimate",
    "experiment_grid",
    "holdout_flag",
    "measure_series",
    "ols_replicates",
    "oob_replicates",
    "predict",
    "replicate_measures",
    "score_series",
]
