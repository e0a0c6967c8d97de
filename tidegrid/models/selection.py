"""Scoring forecasts, backtesting, leaderboards, ensembles and quantiles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.models.baseline import covariates_in, known_rows, naive, statics_in
from tidegrid.models.folded import UPTO, forecasts, held_rows, placed_rows
from tidegrid.models.registry import MODELS, resolve
from tidegrid.quantiles import quantiles
from tidegrid.session import checkpointed
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, measured, null_safe, over_series

#: Sets of models that have forecasts together, up to which the products of their errors are brought to the driver.
PATTERNS = 2048

METRICS = ("MAE", "MAPE", "MASE", "MSE", "RMSE", "RMSSE", "SMAPE")


def metric_name(metric: str) -> str:
    """The first word of e.g. ``'MASE (Mean absolute scaled error)'``, checked."""
    name = metric.split()[0].upper()
    if name not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {', '.join(METRICS)}")
    return name


def in_sample_error(train: DataFrame, spec: SeriesSpec, season: int = 1) -> DataFrame:
    """Per series the mean absolute and squared error of the seasonal-naive forecast inside the history."""
    y = spec.target
    rows = over_series(known_rows(train, spec), spec, {"__before": lambda w: F.lag(y, season).over(w)}, before=season)
    e = F.col(y) - F.col("__before")
    return rows.groupBy(*spec.keys).agg(F.avg(F.abs(e)).alias("scale_abs"), F.avg(e * e).alias("scale_sq"))


def metrics(joined: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics per group of rows with ``y`` (actual) and ``yhat``; the scaled ones use ``scale_abs`` and
    ``scale_sq`` where present. Percentage errors skip rows whose denominator is 0."""
    e, y = F.col("y") - F.col("yhat"), F.col("y")
    scaled = "scale_abs" in joined.columns
    aggs = [
        F.avg(F.abs(e)).alias("MAE"),
        F.avg(F.try_divide(F.abs(e), F.abs(y))).alias("MAPE"),
        F.avg(e * e).alias("MSE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg(F.try_divide(F.abs(e) * 2, F.abs(y) + F.abs(F.col("yhat")))).alias("SMAPE"),
    ]
    if scaled:
        aggs += [F.avg(F.try_divide(F.abs(e), F.col("scale_abs"))).alias("MASE"), F.sqrt(F.avg(F.try_divide(e * e, F.col("scale_sq")))).alias("RMSSE")]
    return joined.groupBy(*keys).agg(*aggs)


def folds_of(df: DataFrame, spec: SeriesSpec, h: int, folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(training rows with ``fold``, held-out rows with ``fold`` and ``step``) of expanding-window folds.

    Fold 0 holds out the last ``h`` rows of each series, fold 1 the ``h`` rows before them, and so on. A row
    is copied to each fold it trains. Training rows keep the static columns and those known ahead; of the latter a fold also
    gets the values of the rows that it holds out, without their target, and of no later ones."""
    statics, ahead = statics_in(df, spec), covariates_in(df, spec)
    rows = placed_rows(df, spec, h, folds, [*statics, *ahead])
    train = rows.where(F.col(UPTO) >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col(UPTO))))
    held = held_rows(rows, spec, h, folds)
    cols = ["fold", *spec.keys, *spec.order, spec.target, *[f"`{c}`" for c in [*statics, *ahead]]]
    train = train.select(*cols)
    if ahead:
        train = train.unionByName(held.withColumn(spec.target, F.lit(None).cast("double")).select(*cols))
    return train, held.select("fold", "step", *spec.keys, spec.ts, F.col(spec.target).alias("y"))


def backtest_forecasts(
    df: DataFrame, spec: SeriesSpec, models: list[str] | str, h: int, folds: int = 3, season: int = 7
) -> DataFrame:
    """Forecast and actual of every (model, fold, series, step): ``(model, fold, keys, step, y, yhat, scales)``.

    The models of ``folded`` read the history once for all folds; the others get a copy of it per fold, with the fold as a further key.
    Folds without history are left out."""
    spec = measured(df, spec)
    inner = spec.replace(by=("fold", *spec.by))
    placed = placed_rows(df, spec, h, folds)
    done, scales, rest = forecasts(placed, spec, {m: MODELS[m] for m in resolve(models)}, h, folds, season)
    runs = [] if done is None else [done]
    if rest:
        train, _ = folds_of(df, spec, h, folds)
        runs += [run(train, inner, h, season).select(F.lit(m).alias("model"), *inner.keys, "step", "yhat") for m, run in rest.items()]
    predicted = reduce(lambda a, b: a.unionByName(b), runs)
    held = held_rows(placed, spec, h, folds).select("fold", "step", *spec.keys, F.col(spec.target).alias("y"))
    actual = join_stats(held, scales, inner.keys)
    on = [*inner.keys, "step"]
    renamed = actual.withColumnsRenamed({k: f"__a_{k}" for k in on})
    cond = reduce(lambda a, b: a & b, [predicted[k].eqNullSafe(renamed[f"__a_{k}"]) for k in on])
    return predicted.join(renamed, cond).drop(*[f"__a_{k}" for k in on])


def series_scores(backtested: DataFrame, spec: SeriesSpec, metric: str = "MAE") -> DataFrame:
    """``(keys, model, metric)``: the metric of each fold, averaged over the folds."""
    name = metric_name(metric)
    per_fold = metrics(backtested, ["model", "fold", *spec.keys])
    return per_fold.groupBy("model", *spec.keys).agg(F.avg(name).alias("metric"))


def series_leaderboard(scores: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Models of each series, best (smallest metric) first: ``rank`` 1 is the winner; ties by model name."""
    w = Window.partitionBy(*[F.col(k) for k in spec.keys] or [F.lit(0)]).orderBy(F.asc_nulls_last("metric"), "model")
    return scores.withColumn("rank", F.row_number().over(w))


def best_models(scores: DataFrame, spec: SeriesSpec) -> DataFrame:
    return series_leaderboard(scores, spec).where(F.col("rank") == 1).drop("rank")


def complete(points: DataFrame, df: DataFrame, spec: SeriesSpec, h: int) -> DataFrame:
    """``points`` (with ``model``) and the naive forecast of every series of ``df`` that has none there."""
    if not spec.keys:
        return points
    have = points.where(F.col("yhat").isNotNull()).select(*spec.keys).distinct()
    missing = df.join(have, null_safe(df, have, spec.keys), "left_anti")
    known = points.join(have, null_safe(points, have, spec.keys), "left_semi")
    return known.unionByName(naive(missing, spec, h).withColumn("model", F.lit("naive")).select(*points.columns))


def best_forecasts(df: DataFrame, spec: SeriesSpec, best: DataFrame, models: list[str] | str, h: int, season: int = 7) -> DataFrame:
    """The forecast of each series by the model that ``best`` names for it; the naive one where it names none, or
    where its model gives none."""
    spec = measured(df, spec)
    chosen = best.select(*spec.keys, F.col("model").alias("__model"))
    out = []
    for m in resolve(models):
        own = join_stats(df, chosen.where(F.col("__model") == m), spec.keys, "inner").drop("__model")
        out.append(MODELS[m](own, spec, h, season).withColumn("model", F.lit(m)))
    return complete(reduce(lambda a, b: a.unionByName(b), out), df, spec, h)


def leaderboard(scores: DataFrame, strategy: str) -> DataFrame:
    """``(model, score_val, strategy)``: minus the metric averaged over the series; higher is better."""
    return scores.groupBy("model").agg((-F.avg("metric")).alias("score_val")).withColumn("strategy", F.lit(strategy))


def per_series_score(scores: DataFrame, spec: SeriesSpec, strategy: str) -> DataFrame:
    """One leaderboard row for picking the best model series by series: minus the mean of the best metrics.

    NULL, and so ranked last, when no series was scored."""
    one = best_models(scores, spec).agg((-F.avg("metric")).alias("score_val"))
    return one.select(F.lit(strategy).alias("model"), "score_val", F.lit(strategy).alias("strategy"))


def combine_leaderboards(*boards: DataFrame) -> DataFrame:
    """All strategies' boards, best first, unscored last (a board has one row per model)."""
    one = reduce(lambda a, b: a.unionByName(b), boards)
    return one.orderBy(F.desc_nulls_last("score_val"), "model", "strategy")


def best_of(board: DataFrame) -> DataFrame:
    return combine_leaderboards(board).limit(1)


def leaderboard_summary(board: DataFrame, seconds: float | None = None) -> DataFrame:
    """Best model with its score, the mean of the scores, the number of models, and the time taken."""
    return board.agg(
        F.max_by("model", F.struct("score_val", "model")).alias("best_model"), F.max("score_val").alias("best_score"),
        F.avg("score_val").alias("mean_score"), F.count(F.lit(1)).alias("models"),
    ).withColumn("seconds", F.lit(seconds).cast("double"))


# --- ensemble and quantiles ---------------------------------------------------------------------------------


def _loss(name: str, y: Column, yhat: Column) -> Column:
    """The row's part of a metric; scaled metrics read ``scale_abs`` and ``scale_sq``."""
    e = y - yhat
    return {
        "MAE": F.abs(e),
        "MSE": e * e,
        "RMSE": e * e,
        "MAPE": F.try_divide(F.abs(e), F.abs(y)),
        "SMAPE": F.try_divide(F.abs(e) * 2, F.abs(y) + F.abs(yhat)),
        "MASE": F.try_divide(F.abs(e), F.col("scale_abs")),
        "RMSSE": F.try_divide(e * e, F.col("scale_sq")),
    }[name]


def _wide(backtested: DataFrame, spec: SeriesSpec, models: list[str]) -> DataFrame:
    """One row per held-out point with a column ``m0, m1, ...`` per model."""
    on = ["fold", *spec.keys, "step", "y", *[c for c in ("scale_abs", "scale_sq") if c in backtested.columns]]
    cells = [F.col(f"`{m}`").alias(f"m{i}") for i, m in enumerate(models)]
    return backtested.groupBy(*on).pivot("model", models).agg(F.first("yhat")).select(*on, *cells)


def error_products(wide: DataFrame, name: str, k: int) -> DataFrame:
    """``(pattern, i, j, total, n)``: sums of products of the models' errors over the rows with the same models present.

    ``pattern`` has a 1 for each model with a forecast; errors are weighted as the squared metric ``name`` asks. The actual
    value itself is the error number ``k``, that of an average without members. Every task sends one matrix per pattern,
    or several where it meets over ``PATTERNS`` of them."""
    weight = F.try_divide(F.lit(1.0), F.col("scale_sq")) if name == "RMSSE" else F.lit(1.0)
    rows = wide.select(F.col("y").cast("double").alias("y"), weight.alias("w"), *[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(k)])
    rows = rows.where(F.col("y").isNotNull() & F.col("w").isNotNull())

    def flushed(sums: dict) -> pd.DataFrame:
        i, j = np.triu_indices(k + 1)
        out = [
            pd.DataFrame({"pattern": "".join("01"[b] for b in has), "i": i, "j": j, "total": g[i, j], "n": n}) for has, (g, n) in sums.items()
        ]
        return pd.concat(out)

    def partial(batches):
        sums: dict[tuple, tuple] = {}
        for batch in batches:
            y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
            m = batch[[f"m{i}" for i in range(k)]].to_numpy(dtype=float)
            e = np.column_stack([np.where(np.isnan(m), 0.0, y[:, None] - m), y])
            kinds, which = np.unique(~np.isnan(m), axis=0, return_inverse=True)
            which = which.reshape(-1)
            for at, has in enumerate(kinds):
                mine = which == at
                g, n = sums.get(tuple(map(int, has)), (0.0, 0))
                sums[tuple(map(int, has))] = (g + (e[mine] * w[mine, None]).T @ e[mine], n + int(mine.sum()))
            if len(sums) > PATTERNS:
                yield flushed(sums)
                sums = {}
        if sums:
            yield flushed(sums)

    parts = rows.mapInPandas(partial, "pattern string, i int, j int, total double, n long")
    return parts.groupBy("pattern", "i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _squared_scorer(wide: DataFrame, name: str, k: int):
    """Scores candidates from the products of errors alone, after one pass over the rows. None beyond ``PATTERNS`` patterns."""
    cells = checkpointed(error_products(wide, name, k))
    if cells.select("pattern").distinct().limit(PATTERNS + 1).count() > PATTERNS:
        return None
    found: dict[str, tuple] = {}
    for r in cells.toLocalIterator():  # at most PATTERNS small matrices
        g, _ = found.setdefault(r["pattern"], (np.zeros((k + 1, k + 1)), r["n"]))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["total"]
    patterns = sorted(found)
    n = sum(found[p][1] for p in patterns)
    has = np.array([[c == "1" for c in p] for p in patterns], dtype=float).reshape(len(patterns), k)
    grams = np.array([found[p][0] for p in patterns]).reshape(len(patterns), k + 1, k + 1)

    def scores(counts: list[int]) -> list[float]:
        out = []
        for j in range(k):
            c = has * (np.array(counts) + (np.arange(k) == j))
            members = c.sum(axis=1)
            squares = np.einsum("pi,pij,pj->p", c, grams[:, :k, :k], c) / np.maximum(members, 1.0) ** 2
            out.append(float(np.where(members > 0, squares, grams[:, k, k]).sum() / n) if n else float("inf"))
        return out

    return scores


def _pass_scorer(wide: DataFrame, name: str, k: int):
    """Scores all candidates of a round by one aggregate over the rows; each row adds one term per candidate."""

    def scores(counts: list[int]) -> list[float]:
        used = [(F.col(f"m{i}"), float(c)) for i, c in enumerate(counts) if c]
        total = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0.0)) * c for m, c in used], F.lit(0.0))
        weight = reduce(lambda a, b: a + b, [F.when(m.isNotNull(), c).otherwise(0.0) for m, c in used], F.lit(0.0))
        state = wide.withColumn("__total", total).withColumn("__weight", weight)

        def average(m: Column) -> Column:
            more = F.col("__weight") + F.when(m.isNotNull(), 1.0).otherwise(0.0)
            return F.coalesce(F.try_divide(F.col("__total") + F.coalesce(m, F.lit(0.0)), more), F.lit(0.0))

        row = state.agg(*[F.avg(_loss(name, F.col("y"), average(F.col(f"m{i}")))).alias(f"s{i}") for i in range(k)]).first()
        return [v if v is not None else float("inf") for v in row]

    return scores


def ensemble_weights(
    backtested: DataFrame, spec: SeriesSpec, metric: str = "MAE", rounds: int | None = None, tolerance: float = 1e-3, patience: int = 5
) -> DataFrame:
    """Greedy forward selection with replacement (Caruana et al. 2004): rows ``(model, weight)``.

    Every round adds the model whose average with those chosen before scores best (the squared metrics without their root,
    which orders them alike); the best of all rounds is kept. It ends after ``patience`` rounds that together gained less
    than ``tolerance`` of the best single model's score, or after ``rounds`` if given. So at most ``patience / tolerance`` rounds are
    possible, and about the square root of that are usual.

    A squared error of an average is a quadratic form of the products of the models' errors, so MSE, RMSE and RMSSE read the
    rows once for all rounds. The other metrics need one aggregate per round over the forecasts laid out with a column per model. Where a
    model has no forecast, an average is that of its other members; a row without any counts as an error of y, so
    that skipping rows never pays.
    """
    name = metric_name(metric)
    models = [r["model"] for r in backtested.select("model").distinct().orderBy("model").collect()]
    k, scorer = len(models), None
    wide = _wide(backtested, spec, models)
    if name in ("MSE", "RMSE", "RMSSE"):
        scorer = _squared_scorer(wide, name, k)
    if scorer is None:
        scorer = _pass_scorer(checkpointed(wide), name, k)
    counts, best_counts, best = [0] * k, [0] * k, None
    single = mark = None  # the best single model's score, and the score that the next rounds have to beat
    idle = done = 0
    while k and (rounds is None or done < rounds):
        scores = scorer(counts)
        pick = min(range(k), key=lambda i: (round(scores[i], 12), i))
        counts[pick] += 1
        done += 1
        if best is None or scores[pick] < best:
            best, best_counts = scores[pick], list(counts)
        if single is None:
            single = mark = best
        elif best < mark - tolerance * single:
            mark, idle = best, 0
        else:
            idle += 1
        if best == 0 or best == float("inf") or idle >= patience:
            break
    total = sum(best_counts)
    rows = [(m, c / total) for m, c in zip(models, best_counts) if c]
    return backtested.sparkSession.createDataFrame(rows, "model string, weight double")


def ensemble_forecast(df: DataFrame, spec: SeriesSpec, weights: DataFrame, h: int, season: int = 7) -> DataFrame:
    """The weighted sum of the models' forecasts. Where a model gives none, the others' weights are scaled up."""
    spec = measured(df, spec)
    chosen = [(r["model"], r["weight"]) for r in weights.orderBy("model").collect()]  # one row per model
    runs = [MODELS[m](df, spec, h, season).withColumn("__w", F.lit(w)) for m, w in chosen]
    both = reduce(lambda a, b: a.unionByName(b), runs).where(F.col("yhat").isNotNull())
    return both.groupBy(*spec.keys, "step", spec.ts).agg((F.sum(F.col("yhat") * F.col("__w")) / F.sum("__w")).alias("yhat"))


LEVELS = tuple(round(i / 10, 1) for i in range(1, 10))


def residual_quantiles(backtested: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Quantiles of the backtest errors by model and step, one column per level."""
    errors = backtested.withColumn("__e", F.col("y") - F.col("yhat"))
    return quantiles(errors, ["model", "step"], "__e", {str(q): q for q in levels})


def quantile_forecast(forecasts: DataFrame, residuals: DataFrame, mean_only: bool = False) -> DataFrame:
    """Add the columns ``0.1`` to ``0.9`` to forecasts that name their ``model``; only ``0.5`` if ``mean_only``."""
    levels = ["0.5"] if mean_only else [c for c in residuals.columns if c not in ("model", "step")]
    small = residuals.select("model", "step", *[F.col(f"`{c}`").alias(f"__q{c.replace('.', '_')}") for c in levels])
    joined = join_stats(forecasts, small, ["model", "step"])
    return joined.select(*forecasts.columns, *[(F.col("yhat") + F.col(f"__q{c.replace('.', '_')}")).alias(c) for c in levels])
