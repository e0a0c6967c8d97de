"""The whole run: validate, prepare, choose models, forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.models import selection
from tidegrid.models.registry import forecast, resolve
from tidegrid.operators import features, missing, quality, regular, series
from tidegrid.plans.runs import PROGRESS, RunStore
from tidegrid.session import checkpointed
from tidegrid.sources import tables
from tidegrid.spec import RunParams, SeriesSpec, freq_code
from tidegrid.splits import join_stats, measured

PER_SERIES, GLOBAL, ENSEMBLE = "per_series", "global", "WeightedEnsemble"


@dataclass(frozen=True)
class Prepared:
    """Training panel, naive forecast of the series too short for it, statics (or None) and messages."""

    panel: DataFrame
    fallback: DataFrame | None
    statics: DataFrame | None
    messages: DataFrame | None


@dataclass(frozen=True)
class RunResult:
    predictions: DataFrame
    leaderboard: DataFrame | None
    series_leaderboard: DataFrame | None
    weights: DataFrame | None
    messages: DataFrame | None


def prepare(df: DataFrame, params: RunParams, calendar: DataFrame | None = None) -> Prepared:
    """Parse dates, set statics aside, add holidays, fill, bring to the grid, set short series aside."""
    spec, h = params.spec(), params.prediction_length
    df = series.safe_timestamp(df, spec.ts)
    statics = None
    if any(c in df.columns and c != spec.id for c in spec.statics):
        statics = series.static_table(df, spec.id, list(spec.statics), spec.ts)
    if params.use_russian_holidays:
        df = features.add_holiday(df, spec.ts, calendar=calendar)
    spec = measured(df, spec)
    df = missing.fill(df, params.fill_missing_method, spec.replace(ties=(spec.id,)), tuple(params.fill_group_columns))
    freq = freq_code(params.frequency)
    if freq is None:
        return Prepared(df, None, statics, None)
    grid = checkpointed(regular.regularize(df, spec, freq, snap=params.snap_to_grid))
    panel, _ = regular.split_short(grid, spec, h)
    panel = checkpointed(panel)
    return Prepared(panel, regular.naive_fallback(grid, spec, h, freq), statics, regular.run_messages(df, spec, freq, h, params.snap_to_grid))


def run(df: DataFrame, params: RunParams, folds: int = 3, calendar: DataFrame | None = None, store: RunStore | None = None, run_id: str | None = None) -> RunResult:
    """Forecast every series of ``df``.

    ``models_to_train`` compete over all series together and with their weighted ensemble; ``pycaret_models``
    compete series by series. The better of the two by backtest makes the forecast; a single candidate is
    backtested too, for its score and its quantiles. Series too short to train on, and series for which the chosen model
    has no forecast, get the naive one; statics are attached by id. Progress and results go to ``store`` if one is given,
    and the forecast into ``upload_table_name`` if that is set.
    """
    spec, h, season = params.spec(), params.prediction_length, params.season

    def note(status: str, **more) -> None:
        if store:
            store.record(run_id, status, PROGRESS.get(status), **more)

    if store:
        store.record(run_id, "running", 0, params=params)
    try:
        wrong = quality.errors(df, spec)
        if wrong:
            raise ValueError("; ".join(code for code, _ in wrong))
        note("validated")
        ready = prepare(df, params, calendar)
        note("dataframe")
        result = _predict(ready, params, spec, h, season, folds)
        if store:
            for name in ("predictions", "leaderboard", "series_leaderboard", "weights", "messages"):
                part = getattr(result, name)
                if part is not None:
                    store.write(run_id, name, part)
        if params.upload_table_name:
            name = ".".join(n for n in (params.upload_table_schema, params.upload_table_name) if n)
            tables.save_forecast(result.predictions, name, create_new=False)
        note("completed")
        return result
    except Exception as e:
        if store:
            store.record(run_id, "failed", error=str(e))
        raise


def run_table(spark: SparkSession, params: RunParams, **more) -> RunResult:
    """``run`` over the catalog table that ``download_table_name`` names."""
    if not params.download_table_name:
        raise ValueError("download_table_name is not set")
    return run(tables.stored_rows(spark, params.download_table_name), params, **more)


def _predict(ready: Prepared, params: RunParams, spec: SeriesSpec, h: int, season: int, folds: int) -> RunResult:
    panel, metric = _with_statics(ready, spec), params.evaluation_metric
    spec = measured(panel, spec)
    shared, own = resolve(params.models_to_train), resolve(params.pycaret_models)
    if not shared and not own:
        raise ValueError("no model was chosen")
    per_series = weights = None
    everything = list(dict.fromkeys(shared + own))
    tested = checkpointed(selection.backtest_forecasts(panel, spec, everything, h, folds, season))
    scores = checkpointed(selection.series_scores(tested, spec, metric))
    boards = []
    if shared:
        mine = scores.where(F.col("model").isin(shared))
        boards.append(selection.leaderboard(mine, GLOBAL))
        if len(shared) > 1:
            weights = selection.ensemble_weights(tested.where(F.col("model").isin(shared)), spec, metric)
            joint = _weighted(tested, weights, spec)
            boards.append(selection.leaderboard(selection.series_scores(joint, spec, metric), GLOBAL))
            tested = tested.unionByName(joint.select(*tested.columns))
    if own:
        mine = scores.where(F.col("model").isin(own))
        per_series = selection.series_leaderboard(mine, spec)
        boards.append(selection.per_series_score(mine, spec, PER_SERIES))
    board = checkpointed(selection.combine_leaderboards(*boards))
    best = selection.best_of(board).first()
    if best is None:  # every series is too short to be held out
        points = forecast("naive", panel, spec, h, season).withColumn("model", F.lit("naive"))
    elif best["strategy"] == PER_SERIES:
        chosen = selection.best_models(scores.where(F.col("model").isin(own)), spec)
        points = selection.best_forecasts(panel, spec, chosen, own, h, season)
    elif best["model"] == ENSEMBLE:
        points = selection.ensemble_forecast(panel, spec, weights, h, season).withColumn("model", F.lit(ENSEMBLE))
    else:
        points = forecast(best["model"], panel, spec, h, season).withColumn("model", F.lit(best["model"]))
    residuals = selection.residual_quantiles(tested)
    points = selection.complete(points, panel, spec, h)
    points = selection.quantile_forecast(points, residuals, params.predict_mean_only)
    out = points.withColumnRenamed("yhat", spec.target).drop("step", "model")
    if ready.fallback is not None:
        out = series.union_forecasts(out, ready.fallback)
    out = out.withColumn(spec.ts, F.date_format(spec.ts, "yyyy-MM-dd HH:mm:ss"))
    first = [spec.id, spec.ts, spec.target]
    out = out.select(*first, *[f"`{c}`" for c in out.columns if c not in first])
    if ready.statics is not None:
        out = join_stats(out, ready.statics, [spec.id])  # statics have one row per id
    return RunResult(out, board, per_series, weights, ready.messages)


def _with_statics(ready: Prepared, spec: SeriesSpec) -> DataFrame:
    """The panel with each series' statics on all its rows, for models that use them."""
    if ready.statics is None:
        return ready.panel
    names = [c for c in spec.statics if c in ready.statics.columns and c not in (spec.id, spec.ts, spec.target)]
    return checkpointed(join_stats(ready.panel.drop(*names), ready.statics.select(spec.id, *names), [spec.id])) if names else ready.panel


def _weighted(tested: DataFrame, weights: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Backtest rows of the ensemble: the weighted mean of its members' rows."""
    on = ["fold", *spec.keys, "step", "y", "scale_abs", "scale_sq"]
    member = tested.join(F.broadcast(weights), "model")  # weights have one row per model
    mixed = member.groupBy(*on).agg((F.sum(F.col("yhat") * F.col("weight")) / F.sum("weight")).alias("yhat"))
    return mixed.withColumn("model", F.lit(ENSEMBLE))
