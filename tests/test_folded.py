"""Backtests from one reading of the history give what models forecast from a copy of each fold's history."""

from __future__ import annotations

import datetime as dt
import itertools
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tests.conftest import days, table
from tidegrid import SeriesSpec
from tidegrid.models import folded, registry, selection, smoothing
from tidegrid.splits import join_stats, measured

S = SeriesSpec()
ONE_PASS = [m for m, f in registry.MODELS.items() if f in folded.SUMS or f in folded.RUNS]


def copied(df, spec, models, h, folds, season):
    """The same backtest, every model on its own copy of every fold."""
    spec = measured(df, spec)
    train, held = selection.folds_of(df, spec, h, folds)
    inner = spec.replace(by=("fold", *spec.by))
    scales = selection.in_sample_error(train, inner, season)
    runs = [registry.MODELS[m](train, inner, h, season).select(F.lit(m).alias("model"), *inner.keys, "step", "yhat") for m in models]
    actual = join_stats(held.drop(spec.ts), scales, inner.keys)
    return join_stats(reduce(lambda a, b: a.unionByName(b), runs), actual, [*inner.keys, "step"], "inner")


def panel(spark):
    """Series of 1 to 60 rows with gaps in the target, one of zeros, one with little demand and one without an id."""
    rows = []
    for k, n in enumerate([1, 2, 4, 5, 7, 13, 14, 16, 23, 27, 60]):
        rows += [(f"s{n}", i, 5.0 + 0.3 * i + ((i + k) * 7919 % 13) if i % 11 != 5 else None) for i in range(n)]
    rows += [("zero", i, 0.0) for i in range(30)] + [("rare", i, float(i % 5 == 2) * (i % 7 + 1)) for i in range(40)]
    rows += [("late", i, 9.0 if i > 36 else 0.0) for i in range(40)] + [(None, i, float(i * i % 17)) for i in range(33)]
    data = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for a, i, v in rows]
    return spark.createDataFrame(data, "item_id string, ts timestamp_ntz, y double").repartition(3)


@pytest.mark.parametrize("h, folds, season", [(3, 4, 7), (10, 3, 5)])
def test_one_reading_equals_copies(spark, h, folds, season):
    df = panel(spark)
    got = table(selection.backtest_forecasts(df, S, ONE_PASS, h, folds, season))
    assert {r[2] for r in got} == set(ONE_PASS)
    assert got == table(copied(df, S, ONE_PASS, h, folds, season))


def test_long_series_keep_their_state_at_every_fold(spark, rows_per_task, monkeypatch):
    df = panel(spark).where("item_id IS NULL OR item_id IN ('s7', 's60', 'rare')")
    models = ["average", "polytrend", "seasonal_average", "holt", "holt_winters", "croston"]
    plain = table(selection.backtest_forecasts(df, S, models, 3, 4, 4))
    with rows_per_task(12):
        monkeypatch.setattr(smoothing, "_JOINED", 2)
        assert table(selection.backtest_forecasts(df, S, models, 3, 4, 4)) == plain
        monkeypatch.setattr(smoothing, "_EFFECT", 1)  # streamed instead of chained
        assert table(selection.backtest_forecasts(df, S, ["holt_winters"], 3, 4, 4)) == [r for r in plain if r[2] == "holt_winters"]


def test_one_series_without_an_id(spark):
    df, spec = panel(spark).where("item_id = 's60'").drop("item_id"), S.replace(id=None)
    assert table(selection.backtest_forecasts(df, spec, ONE_PASS, 3, 4, 7)) == table(copied(df, spec, ONE_PASS, 3, 4, 7))


def test_nothing_to_hold_out(spark, series_of):
    for df in (series_of({"a": days([1.0, 2.0])}), series_of({"a": days([None])}), panel(spark).limit(0)):
        assert selection.backtest_forecasts(df, S, ONE_PASS, 2, 3).collect() == []


def test_users_models_and_replaced_ones_get_copies(series_of):
    df, own = series_of({"a": days([float(i % 4) for i in range(20)])}), registry.MODELS["naive"]
    registry.register("naive", registry.MODELS["zero"])
    try:
        assert {r["yhat"] for r in selection.backtest_forecasts(df, S, ["naive"], 2, 2).collect()} == {0.0}
    finally:
        registry.register("naive", own)


@pytest.mark.parametrize("name", ONE_PASS)
def test_rows_read_do_not_grow_with_folds(spark, name):
    """No row of the history is written out more than once before the first aggregate."""
    df = panel(spark)
    spec = measured(df, S)
    placed = folded.placed_rows(df, spec, 2, 5)
    done, _, _ = folded.forecasts(placed, spec, {name: registry.MODELS[name]}, 2, 5, 7)
    lines = [(len(t) - len(t.lstrip(" :+-")), t.lstrip(" :+-")) for t in done._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    for i, (depth, line) in enumerate(lines):
        if line.startswith("Generate"):
            below = list(itertools.takewhile(lambda x: x[0] > depth, lines[i + 1 :]))
            assert name == "seasonal_naive" or any(t.startswith("Aggregate") for _, t in below)  # that model: a season of rows to a fold
