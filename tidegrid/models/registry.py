"""The menu of forecasters, and how a user adds one."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from tidegrid.models import baseline, smoothing, tabular
from tidegrid.spec import SeriesSpec


class Forecaster(Protocol):
    """``(df, spec, h, season) -> (keys, step, <ts>, yhat)`` for every series of ``df`` at once.

    ``spec.keys`` may hold more than the id (a fold number), so a forecaster must group by all of them. It
    may be a DataFrame function or wrap a kernel in ``groupBy(*spec.keys).applyInPandas``.
    """

    def __call__(self, df: DataFrame, spec: SeriesSpec, h: int, season: int) -> DataFrame: ...


def _regression(name: str, strategy: str) -> Callable:
    def run(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
        return tabular.tabular(df, spec, h, name, tuple(sorted({*tabular.LAGS, max(season, 1)})), strategy)

    return run


MODELS: dict[str, Forecaster] = {
    "naive": baseline.naive, "seasonal_naive": baseline.seasonal_naive, "average": baseline.average,
    "seasonal_average": baseline.seasonal_average, "zero": baseline.zero, "polytrend": baseline.polytrend, "npts": baseline.npts,
    "ses": smoothing.ses, "holt": smoothing.holt, "holt_winters": smoothing.holt_winters, "theta": smoothing.theta,
    "croston": smoothing.croston, "adida": smoothing.adida, "imapa": smoothing.imapa, "stlf": smoothing.stlf,
    **{name: _regression(name, "recursive") for name in tabular.REGRESSORS},
    **{f"{name}_direct": _regression(name, "direct") for name in ("linear", "boosted_trees")},
}

# Names under which the menus of the two strategies list the models above.
ALIASES = {
    "NaiveModel": "naive", "SeasonalNaiveModel": "seasonal_naive", "AverageModel": "average", "SeasonalAverageModel": "seasonal_average",
    "ZeroModel": "zero", "ETSModel": "holt_winters", "AutoETSModel": "holt_winters", "ThetaModel": "theta", "ADIDAModel": "adida",
    "CrostonModel": "croston", "IMAPAModel": "imapa", "NPTSModel": "npts", "DirectTabularModel": "boosted_trees_direct",
    "RecursiveTabularModel": "boosted_trees", "grand_means": "average", "snaive": "seasonal_naive", "exp_smooth": "ses", "ets": "holt_winters",
    "lr_cds_dt": "linear", "en_cds_dt": "elastic_net", "ridge_cds_dt": "ridge", "lasso_cds_dt": "lasso", "rf_cds_dt": "random_forest",
    "xgboost_cds_dt": "boosted_trees", "lightgbm_cds_dt": "boosted_trees", "catboost_cds_dt": "boosted_trees",
}


def register(name: str, forecaster: Forecaster) -> None:
    """Add a model under ``name`` for backtests and runs."""
    MODELS[name] = forecaster


def resolve(models: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """Model names of a menu choice: nothing, ``'*'`` for all models, one name, or a list."""
    if not models:
        return []
    if isinstance(models, str):
        models = list(MODELS) if models.strip() == "*" else [models]
    names = [ALIASES.get(m, m) for m in models]
    unknown = [m for m in names if m not in MODELS]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    return list(dict.fromkeys(names))


def forecast(name: str, df: DataFrame, spec: SeriesSpec, h: int, season: int = 7) -> DataFrame:
    return MODELS[resolve([name])[0]](df, spec, h, season)
