"""Models on cases with known answers, long series cut up, selection and whole runs."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import frames as fr
from tests.conftest import SF, days, rows, table
from tidegrid import RunParams, SeriesSpec
from tidegrid.models import baseline, registry, selection, smoothing, tabular
from tidegrid.operators import drift, seasonal
from tidegrid.plans import forecast, report, runs

S = SeriesSpec()


def steps(df):
    return [r["yhat"] for r in df.orderBy("item_id", "step").collect()]


LINE = days([2.0 + 3.0 * i for i in range(30)])
SEASON = days([10.0 + [0, 5, -5, 2, -2, 1, -1][i % 7] for i in range(35)])


@pytest.mark.parametrize("name", [m for m in registry.MODELS if m != "zero" and m not in tabular.REGRESSORS])
def test_constant_series_stay_constant(series_of, name):
    got = registry.forecast(name, series_of({"a": days([4.0] * 28)}), S, 3, 7)
    assert steps(got) == pytest.approx([4.0] * 3)
    assert [r["ts"] for r in got.orderBy("step").collect()] == [dt.datetime(2024, 1, d) for d in (29, 30, 31)]


@pytest.mark.parametrize("name", ["polytrend", "holt", "holt_winters"])
def test_a_pure_line_is_continued(series_of, name):
    got = registry.forecast(name, series_of({"a": LINE}), S, 3, 7)
    assert steps(got) == pytest.approx([92.0, 95.0, 98.0])


@pytest.mark.parametrize("name", ["seasonal_naive", "seasonal_average", "holt_winters", "stlf"])
def test_a_pure_season_is_repeated(series_of, name):
    got = registry.forecast(name, series_of({"a": SEASON}), S, 8, 7)
    assert steps(got) == pytest.approx([10.0, 15.0, 5.0, 12.0, 8.0, 11.0, 9.0, 10.0])


def test_one_row_and_all_null_series(series_of):
    df = series_of({"one": days([3.0]), "none": days([None, None])})
    for name in ("naive", "ses", "holt", "theta", "polytrend", "holt_winters", "croston"):
        got = registry.forecast(name, df, S, 2, 7)
        assert {r["item_id"] for r in got.collect()} == {"one"}


def test_croston_by_hand(series_of):
    got = registry.forecast("croston", series_of({"a": days([0.0, 2.0, 0.0, 0.0, 4.0]), "z": days([0.0, 0.0])}), S, 1)
    size, gap = 2 + 0.1 * (4 - 2), 2 + 0.1 * (3 - 2)
    assert steps(got) == pytest.approx([size / gap, 0.0])


def _aggregated_by_hand(y, widths):
    """Mean over the widths of the smoothed bucket sums, empty buckets included."""
    out = []
    for k in widths:
        sums = [sum(y[i : i + k]) for i in range(len(y) % k, len(y), k)]
        fits = []
        for i, a in enumerate(smoothing.INTERMITTENT_ALPHAS):
            level, sse = sums[0], 0.0
            for v in sums[1:]:
                sse += (v - level) ** 2
                level += a * (v - level)
            fits.append((round(sse, 9), i, level))
        out.append(min(fits)[2] / k)
    return sum(out) / len(out)


def test_aggregated_demand_by_hand(series_of, rows_per_task):
    rng = np.random.default_rng(3)
    data = {str(i): [float(v) for v in rng.integers(1, 9, n) * (rng.random(n) < p)] for i, (n, p) in enumerate([(60, 0.2), (41, 0.5), (30, 0.1), (50, 0.9)])}
    data |= {"late": [0.0] * 19 + [4.0], "early": [4.0] + [0.0] * 19, "none": [0.0] * 5, "all": [2.0] * 9}
    want = {"adida": {}, "imapa": {}}
    for k, y in data.items():
        at = [-1, *(i for i, v in enumerate(y) if v)]
        gaps = np.diff(at)
        kmax = max(int(gaps.mean() + 0.5), 1) if len(gaps) else 0
        want["adida"][k] = _aggregated_by_hand(y, [kmax]) if kmax else 0.0
        want["imapa"][k] = _aggregated_by_hand(y, range(1, kmax + 1)) if kmax else 0.0
    for n, ids in ((4_000_000, list(data)), (10, ["1", "late", "none"])):
        df = series_of({k: days(data[k]) for k in ids})
        with rows_per_task(n):
            for name in want:
                got = {r["item_id"]: r["yhat"] for r in registry.forecast(name, df, S, 1).collect()}
                assert got == pytest.approx({k: want[name][k] for k in ids}), (name, n)


def test_widths_of_a_single_demand_take_few_rows(series_of):
    df = series_of({"a": days([0.0] * 400 + [3.0])})
    assert smoothing._bucketed(df, S, True).count() == 401


@pytest.mark.parametrize("name", ["naive", "seasonal_naive", "average", "seasonal_average", "polytrend", "npts", "ses", "holt", "holt_winters", "theta", "croston", "adida", "imapa", "stlf"])
def test_long_series_cut_up_give_the_same_forecast(spark, rows_per_task, name):
    e = fr.event_series(spark, SF).groupBy("item_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("y").alias("y"))
    spec = S.replace(freq="H")
    whole = table(registry.forecast(name, e, spec, 5, 4))
    with rows_per_task(40):
        assert table(registry.forecast(name, e, spec, 5, 4)) == whole


def test_smoothing_blocks_chain_exactly():
    rng = np.random.default_rng(5)
    for season in (None, 0, 4):
        y = rng.normal(10, 3, 60)
        grid = smoothing.ALPHAS if season is None else smoothing.HOLT_GRID if season == 0 else smoothing.HW_GRID
        best, state, sse = smoothing._run(y, grid, season)
        x0, at = smoothing._start(y, season)
        x, total = np.tile(x0, (len(grid), 1)), np.zeros(len(grid))
        for part in np.split(y[at:], [7, 20]):
            m, v, q, b, quad = smoothing._summary(part, grid, season)
            total += q + (b * x).sum(1) + np.einsum("pi,pij,pj->p", x, quad, x)
            x = np.einsum("pij,pj->pi", m, x) + v
        assert total[best] == pytest.approx(sse)
        assert x[best] == pytest.approx(state)
        parts = [smoothing._summary(part, grid, season) for part in np.split(y[at:], [7, 20, 21])]
        m, v, q, b, quad = smoothing._joined(smoothing._joined(parts[0], parts[1]), smoothing._joined(parts[2], parts[3]))
        assert np.einsum("pij,j->pi", m, x0)[best] + v[best] == pytest.approx(state)
        assert (q + b @ x0 + np.einsum("i,pij,j->p", x0, quad, x0))[best] == pytest.approx(sse)


def test_many_series_are_smoothed_as_one_by_one():
    rng = np.random.default_rng(7)
    series = [rng.normal(10, 3, n) for n in (8, 30, 9, 57, 8, 31)]
    for season, grid in ((None, smoothing.ALPHAS), (0, smoothing.HOLT_GRID), (4, smoothing.HW_GRID)):
        for y, (best, state, sse) in zip(series, smoothing._run_many(series, grid, season), strict=True):
            x0, at = smoothing._start(y, season)
            errors = []
            for p in grid:
                a, b, g = (*(p if isinstance(p, tuple) else (p,)), 0.0, 0.0)[:3]
                l, t, s = x0[0], x0[1] if season is not None else 0.0, list(x0[2:])
                total = 0.0
                for v in y[at:]:
                    e = v - l - t - (s[0] if s else 0.0)
                    total += e * e
                    l, t = l + t + a * e, t + (a * b * e if season is not None else 0.0)
                    s = [*s[1:], s[0] + g * e] if s else s
                errors.append((round(total, 9), len(errors), [l, *([t] if season is not None else []), *s]))
            want = min(errors)
            assert (best, sse) == (want[1], pytest.approx(want[0]))
            assert state == pytest.approx(want[2])
            if season:
                stream = smoothing._Stream(grid, season)
                for part in np.split(y, [3, 5, 7]):
                    stream.add(part)
                assert stream.finish()[0] == best and stream.finish()[1] == pytest.approx(state)


@pytest.mark.parametrize("name", ["ses", "holt", "holt_winters"])
def test_rounds_of_joined_blocks_and_streams_give_the_same(spark, rows_per_task, monkeypatch, name):
    e = fr.event_series(spark, SF).groupBy("item_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("y").alias("y"))
    spec = S.replace(freq="H")
    whole = table(registry.forecast(name, e, spec, 5, 4))
    with rows_per_task(20):
        monkeypatch.setattr(smoothing, "_JOINED", 3)
        assert table(registry.forecast(name, e, spec, 5, 4)) == whole
        monkeypatch.setattr(smoothing, "_EFFECT", 0)
        if name == "holt_winters":
            assert table(registry.forecast(name, e, spec, 5, 4)) == whole
            one = e.where("item_id = 'view'").select("ts", "y")
            assert registry.forecast(name, one, spec.replace(id=None), 5, 4).count() == 5


def test_a_season_of_a_day_in_minutes(spark, rows_per_task):
    y = [100 + 10 * math.sin(i % 1440 / 229.2) for i in range(4 * 1440)]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), v) for i, v in enumerate(y)], "item_id string, ts timestamp_ntz, y double")
    for rows in (10_000, 3000):  # whole, and as a stream
        with rows_per_task(rows):
            got = [r["yhat"] for r in registry.forecast("holt_winters", df, S.replace(freq="T"), 1440, 1440).orderBy("step").collect()]
        assert got == pytest.approx(y[:1440], abs=0.5)


@pytest.mark.parametrize("name", ["linear", "random_forest"])
def test_regression_beats_naive_on_a_season(series_of, name):
    df = series_of({k: days([10 * (i % 7) + j for i in range(70)]) for j, k in enumerate("abc")})
    got = tabular.tabular(df, S, 7, name)
    error = np.abs(np.array(steps(got)).reshape(3, 7) - np.array([[10 * (i % 7) + j for i in range(70, 77)] for j in range(3)])).mean()
    assert error < 10


def test_direct_and_recursive_agree_on_a_line(series_of):
    df = series_of({"a": days([2.0 + 3.0 * i for i in range(120)])})
    want = pytest.approx([362.0, 365.0, 368.0], abs=1.0)  # the features are collinear on a line
    assert steps(tabular.tabular(df, S, 3, "linear", (1, 2), "direct")) == want
    assert steps(tabular.tabular(df, S, 3, "linear", (1, 2))) == want


def test_folds(series_of):
    train, held = selection.folds_of(series_of({"a": days(range(10))}), S, 2, 3)
    assert {f: sorted(r["y"] for r in train.where(F.col("fold") == f).collect()) for f in range(3)} == {f: [float(i) for i in range(8 - 2 * f)] for f in range(3)}
    assert sorted(tuple(r) for r in held.select("fold", "step", "y").collect()) == [(0, 1, 8.0), (0, 2, 9.0), (1, 1, 6.0), (1, 2, 7.0), (2, 1, 4.0), (2, 2, 5.0)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0, 2.0, 4.0), ("a", 0.0, 1.0, 2.0, 4.0)], "id string, y double, yhat double, scale_abs double, scale_sq double")
    r = selection.metrics(df, ["id"]).first()
    assert (r.MAE, r.MSE, r.MAPE, r.MASE) == (1.5, 2.5, pytest.approx(0.2), 0.75)
    assert r.RMSE == pytest.approx(2.5**0.5) and r.RMSSE == pytest.approx((2.5 / 4) ** 0.5)
    assert r.SMAPE == pytest.approx((4 / 18 + 2) / 2)
    with pytest.raises(ValueError, match="unknown metric"):
        selection.metric_name("WQL")


def test_ensemble_weights_sum_to_one_and_do_not_lose(spark):
    bt = selection.backtest_forecasts(fr.type_daily(spark, SF), S, ["naive", "average", "polytrend"], 5, 2)
    weights = {r["model"]: r["weight"] for r in selection.ensemble_weights(bt, S).collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    wide = bt.groupBy("fold", "item_id", "step", "y").pivot("model").agg(F.first("yhat")).toPandas()
    mixed = sum(wide[m] * w for m, w in weights.items())
    best = min((wide["y"] - wide[m]).abs().mean() for m in ("naive", "average", "polytrend"))
    assert (wide["y"] - mixed).abs().mean() <= best + 1e-9


def test_unscored_strategies_come_last(spark):
    a = spark.createDataFrame([("m", -3.0, "global")], "model string, score_val double, strategy string")
    b = spark.createDataFrame([("per_series", None, "per_series")], "model string, score_val double, strategy string")
    assert [r["model"] for r in selection.combine_leaderboards(a, b).collect()] == ["m", "per_series"]


def test_a_user_model_takes_part(series_of):
    registry.register("five", lambda df, spec, h, season: baseline.over_steps(df.groupBy(*spec.keys).agg(F.max(spec.ts).alias(baseline.LAST)), spec, h, F.lit(5.0)))
    try:
        scores = selection.series_scores(selection.backtest_forecasts(series_of({"a": days([5.0, 9.0] * 10)}), S, ["five", "zero"], 2), S)
        assert selection.best_models(scores, S).first()["model"] == "five"
    finally:
        del registry.MODELS["five"]


def test_menu():
    assert registry.resolve(None) == [] and registry.resolve([]) == []
    assert registry.resolve("*") == list(registry.MODELS)
    assert registry.resolve(["snaive", "SeasonalNaiveModel"]) == ["seasonal_naive"]
    with pytest.raises(ValueError, match="unknown models"):
        registry.resolve(["DeepAR"])


# --- diagnostics


def test_decomposition_adds_up_and_matches_the_textbook(series_of):
    y = np.array([v for _, v in SEASON]) + np.arange(35) * 0.5
    parts = seasonal.decompose(series_of({"a": [(t, float(v)) for (t, _), v in zip(SEASON, y)], "short": days([1.0] * 13)}), S, 7).orderBy("ts").toPandas()
    inner = parts["trend"].notna()
    assert inner.sum() == 29 and len(parts) == 35
    trend = np.convolve(y, np.ones(7) / 7, "valid")
    assert parts.loc[inner, "trend"].to_numpy() == pytest.approx(trend)
    assert (parts["trend"] + parts["seasonal"] + parts["resid"])[inner].to_numpy() == pytest.approx(y[3:-3])


def test_acf_of_lag_zero_is_one_and_pacf_matches_numpy(spark):
    df = fr.type_daily(spark, SF)
    assert all(r["acf"] == pytest.approx(1.0) for r in seasonal.acf(df, S, 5).where("lag = 0").collect())
    got = {(r["item_id"], r["lag"]): r["pacf"] for r in seasonal.pacf(df, S, 5).collect()}
    for id, g in df.orderBy("ts").toPandas().groupby("item_id"):
        x = g["y"].to_numpy() - g["y"].mean()
        n = len(x)
        cov = np.array([x[k:] @ x[: n - k] / (n - k) for k in range(6)])
        for k in range(1, 6):
            matrix = np.array([[cov[abs(i - j)] for j in range(k)] for i in range(k)])
            assert got[id, k] == pytest.approx(np.linalg.solve(matrix, cov[1 : k + 1])[-1])


def test_ks_is_symmetric_and_bounded(spark):
    a, b = fr.samples(spark, SF)
    one, two = drift.ks_two_sample(a, b, "y").first(), drift.ks_two_sample(b, a, "y").first()
    assert 0 <= one["statistic"] <= 1
    assert one["statistic"] == pytest.approx(two["statistic"])
    assert drift.ks_two_sample(a, a, "y").first()["p_value"] == 1.0


# --- whole runs


def test_run_with_short_series_statics_and_store(spark, series_of, tmp_path):
    df = series_of({"a": days([float(i % 7) for i in range(40)]), "b": days([float(i) for i in range(40)]), "short": days([1.0, 9.0])}).withColumn("kind", F.upper("item_id"))
    params = RunParams("ts", "y", "item_id", "MAE", frequency="D", prediction_length=4, static_feature_columns=("kind",),
                       models_to_train=("naive", "seasonal_naive"), pycaret_models=("snaive", "polytrend"))
    store, run_id = runs.RunStore(spark, str(tmp_path / "runs")), runs.new_run_id()
    result = forecast.run(df, params, store=store, run_id=run_id)
    out = {(r["item_id"], r["ts"]): r for r in result.predictions.collect()}
    assert len(out) == 12 and out["short", "2024-01-03 00:00:00"]["y"] == 9.0
    assert all(r["kind"] == k[0].upper() for k, r in out.items())
    assert out["b", "2024-02-10 00:00:00"]["y"] == pytest.approx(40.0)
    board = [tuple(r) for r in result.leaderboard.collect()]
    assert board[0][2] == forecast.PER_SERIES and len(board) == 4
    assert store.status(run_id).first()["status"] == "completed"
    sections = report.report_sections(store, run_id)
    assert set(sections) == {"Prediction", "Leaderboard", "TrainingParams", "WeightedEnsemble", "Messages", "SeriesLeaderboards"}
    assert sections["SeriesLeaderboards"].columns == ["unique_id", "Model", "MAE"]
    report.write_report(store, run_id, str(tmp_path / "report"))
    assert (tmp_path / "report" / "TrainingParams").exists()


def test_run_of_short_series_only_gives_the_fallback(series_of):
    params = RunParams("ts", "y", "item_id", "MAE", frequency="D", prediction_length=2, models_to_train=("naive",))
    assert [r["y"] for r in forecast.run(series_of({"a": days([1.0, 7.0])}), params).predictions.collect()] == [7.0, 7.0]


def test_a_failed_run_is_recorded(spark, series_of, tmp_path):
    store, run_id = runs.RunStore(spark, str(tmp_path)), runs.new_run_id()
    with pytest.raises(ValueError, match="missing column: z"):
        forecast.run(series_of({"a": days([1.0])}), RunParams("ts", "z", "item_id", "MAE", models_to_train=("naive",)), store=store, run_id=run_id)
    assert store.status(run_id).first()["status"] == "failed"
    assert rows(report.report_sections(store, run_id)["Messages"]) == [("Messages not found",)]
    with pytest.raises(ValueError, match="no run"):
        store.status("absent")


def promoted(spark, change=(), future=0):
    """A level of 10, and 50 more on days with a promotion; ``change`` turns promotions round on some days."""
    rows = []
    for i in range(80 + future):
        promo = float((i * 7919) % 11 < 3)
        shown = 1.0 - promo if i in change else promo
        rows.append(("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 10.0 + 50.0 * promo + (i % 3) if i < 80 else None, shown))
    return spark.createDataFrame(rows, "item_id string, ts timestamp_ntz, y double, promo double")


@pytest.mark.parametrize("strategy", ["recursive", "direct"])
def test_columns_known_ahead_shape_the_forecast(spark, strategy):
    spec = S.replace(known=("promo",))
    got = {r["step"]: r["yhat"] for r in tabular.tabular(promoted(spark, future=5), spec, 5, "linear", strategy=strategy).collect()}
    for step in range(1, 6):
        promo = ((79 + step) * 7919) % 11 < 3
        assert got[step] > 40 if promo else got[step] < 30
    blind = {r["step"]: r["yhat"] for r in tabular.tabular(promoted(spark, future=5), S, 5, "linear", strategy=strategy).collect()}
    assert max(abs(blind[s] - got[s]) for s in got) > 10


def test_a_fold_sees_its_own_future_only(spark):
    spec = S.replace(known=("promo",))

    def folds(change):
        rows = selection.backtest_forecasts(promoted(spark, change), spec, ["linear"], 4, 2).collect()
        return {f: sorted((r["step"], r["yhat"]) for r in rows if r["fold"] == f) for f in (0, 1)}

    plain, changed = folds(()), folds((76, 77, 78, 79))
    assert changed[1] == plain[1]
    assert changed[0] != plain[0]
    assert all(abs(r["y"] - r["yhat"]) < 20 for r in selection.backtest_forecasts(promoted(spark), spec, ["linear"], 4, 2).collect())


@pytest.mark.parametrize("name", ["naive", "seasonal_naive", "average", "ses", "theta", "linear", "ridge", "linear_direct"])
def test_backtests_do_not_look_ahead(spark, series_of, name):
    """Raising exactly the rows that a fold holds out leaves that fold's forecasts as they are."""
    values = [20 + (i * 7919) % 13 for i in range(40)]
    df = series_of({"a": days(values), "b": days([v + 3 for v in values])})
    h, folds = 3, 3
    before = selection.backtest_forecasts(df, S, [name], h, folds).where("fold = 1").select("item_id", "step", "yhat")
    changed = [v + (1000 if len(values) - 2 * h <= i < len(values) - h else 0) for i, v in enumerate(values)]
    other = series_of({"a": days(changed), "b": days([v + 3 for v in changed])})
    after = selection.backtest_forecasts(other, S, [name], h, folds).where("fold = 1").select("item_id", "step", "yhat")
    assert table(before) == table(after)


def test_short_series_get_their_last_value_from_regressions(series_of):
    df = series_of({"long": LINE, "short": days([1.0, 2.0, 5.0])})
    for strategy in ("recursive", "direct"):
        got = tabular.tabular(df, S, 2, "linear", strategy=strategy)
        assert [r["yhat"] for r in got.where("item_id = 'short'").orderBy("step").collect()] == [5.0, 5.0]
        assert got.where("item_id = 'long'").count() == 2


def test_every_series_is_forecast(spark, series_of):
    df = series_of({"long": LINE, "three": days([1.0, 2.0, 3.0]), "one": days([7.0])})
    p = RunParams("ts", "y", "item_id", "MAE", prediction_length=3, models_to_train=("naive", "average"), pycaret_models=("linear", "snaive"))
    got = forecast.run(df, p)
    assert {(r["item_id"], r["n"]) for r in got.predictions.groupBy("item_id").agg(F.count("y").alias("n")).collect()} == {("long", 3), ("three", 3), ("one", 3)}


def test_a_run_with_one_model_is_scored_and_saved(spark, series_of, tmp_path):
    from tidegrid.sources import tables

    df = series_of({"a": LINE, "b": SEASON})
    spark.sql("DROP TABLE IF EXISTS tidegrid_run_out")
    like = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], "item_id string, ts timestamp_ntz, Y double")
    tables.create_table(like, "tidegrid_run_out", str(tmp_path), ["item_id", "ts"])
    got = forecast.run(df, RunParams("ts", "y", "item_id", "MASE", models_to_train="naive", upload_table_name="tidegrid_run_out"))
    assert got.leaderboard.count() == 1 and {"0.1", "0.9"} <= set(got.predictions.columns)
    assert spark.table("tidegrid_run_out").where("Y IS NOT NULL").count() == 6
    spark.sql("DROP TABLE tidegrid_run_out")


def test_ensembles_follow_the_asked_metric(spark):
    rows_ = [("a", 0, i, float(y), m, f, 1.0, 1.0) for i, (y, x, z) in enumerate([(1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 9, 2)]) for m, f in (("x", float(x)), ("z", float(z)))]
    bt = spark.createDataFrame(rows_, "item_id string, fold int, step int, y double, model string, yhat double, scale_abs double, scale_sq double")
    weights = {m: {r["model"]: r["weight"] for r in selection.ensemble_weights(bt, S, m, 1).collect()} for m in ("MAE", "RMSE", "SMAPE", "MASE", "RMSSE")}
    assert weights["RMSE"] == weights["RMSSE"] == weights["MAE"] == weights["MASE"] == {"z": 1.0} and weights["SMAPE"] == {"x": 1.0}


def test_run_log_reads_one_bucket_and_keeps_few_files(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path), batches=3)
    with pytest.raises(ValueError, match="no run"):
        store.status("x")
    many = spark.range(2000).select(F.concat(F.lit("r"), F.col("id") % 100).alias("run_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"), F.lit("old").alias("status"))
    store.append(many)
    for i in range(9):
        store.record(f"r{i % 3}", f"s{i}", i, RunParams("t", "y", "id", "MAE") if i < 3 else None)
    assert store.status("r1").select("status", "progress").collect() == [("s7", 7)]
    assert json.loads(store.status("r1").first()["params"])["target_column"] == "y"
    assert store.newest().count() == 100 and store.log().count() == 2009
    assert len(list(tmp_path.glob("runs/batch=*"))) <= 3
    half = tmp_path / "runs" / "batch=half"  # another writer has not finished this one: it is neither merged nor removed
    (half / "_temporary").mkdir(parents=True)
    for i in range(4):
        store.record("r9", "later", i)
    assert half.exists() and store.log().count() == 2013
    assert len(list(tmp_path.glob("runs/batch=*/bucket=*/*.parquet"))) <= 3 * runs.BUCKETS + 4
    plan = store.log("r1")._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and f"= {runs.bucket_of('r1')})" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r["bucket"] for r in store._read(store._batches()).where("run_id = 'r1'").select("bucket").collect()} == {runs.bucket_of("r1")}


def test_a_run_reads_the_table_it_names(spark, series_of, tmp_path):
    from tidegrid.sources import tables

    df = series_of({"a": [(t, float(i)) for i, (t, _) in enumerate(days(range(12)))]})
    tables.create_table(df, "tidegrid_run_in", str(tmp_path / "in"), ["item_id", "ts"])
    tables.upsert_table(df, "tidegrid_run_in")
    params = RunParams("ts", "y", "item_id", "MAE", frequency="D", models_to_train=("naive",), download_table_name="tidegrid_run_in")
    assert [r["y"] for r in forecast.run_table(spark, params).predictions.collect()] == [11.0] * 3
    with pytest.raises(ValueError, match="download_table_name"):
        forecast.run_table(spark, RunParams("ts", "y", "item_id", "MAE"))
    spark.sql("DROP TABLE tidegrid_run_in")


def _greedy_by_hand(bt, loss, patience=5, tolerance=1e-3):
    """The documented selection in plain Python over rows with every model's forecast or None."""
    models = sorted({r["model"] for r in bt})
    points: dict = {}
    for r in bt:
        points.setdefault((r["fold"], r["item_id"], r["step"]), (r, {}))[1][r["model"]] = r["yhat"]

    def score(counts):
        losses = []
        for row, found in points.values():
            have = [(found[m], c) for m, c in zip(models, counts, strict=True) if c and found.get(m) is not None]
            mean = sum(v * c for v, c in have) / sum(c for _, c in have) if have else 0.0
            losses.append(loss(row, mean))
        losses = [x for x in losses if x is not None]
        return sum(losses) / len(losses)

    counts, best, kept, single, mark, idle = [0] * len(models), None, None, None, None, 0
    while idle < patience and best != 0:
        tried = [score([c + (i == j) for j, c in enumerate(counts)]) for i in range(len(models))]
        pick = min(range(len(models)), key=lambda i: (round(tried[i], 12), i))
        counts[pick] += 1
        if best is None or tried[pick] < best:
            best, kept = tried[pick], list(counts)
        if single is None:
            single = mark = best
        elif best < mark - tolerance * single:
            mark, idle = best, 0
        else:
            idle += 1
    return {m: c / sum(kept) for m, c in zip(models, kept, strict=True) if c}


def test_ensembles_equal_plain_rounds_also_where_models_are_missing(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = []
    for i in range(60):
        y, scale = float(rng.normal(5, 2)), None if i % 17 == 0 else float(rng.uniform(0.5, 2))
        for j, m in enumerate("pqrs"):
            yhat = None if rng.random() < 0.2 else float(y + rng.normal(j - 1.5, 1.0))
            data.append((f"s{i % 3}", i % 2, i, y, m, yhat, scale, scale))
    bt = spark.createDataFrame(data, "item_id string, fold int, step int, y double, model string, yhat double, scale_abs double, scale_sq double").repartition(5)
    flat = bt.collect()
    losses = {
        "MAE": lambda r, f: abs(r["y"] - f),
        "RMSE": lambda r, f: (r["y"] - f) ** 2,
        "RMSSE": lambda r, f: None if r["scale_sq"] is None else (r["y"] - f) ** 2 / r["scale_sq"],
    }
    for name, loss in losses.items():
        want = pytest.approx(_greedy_by_hand(flat, loss))
        assert {r["model"]: r["weight"] for r in selection.ensemble_weights(bt, S, name).collect()} == want
    # More sets of present models than may be brought to the driver: a pass per round, the same weights.
    monkeypatch.setattr(selection, "PATTERNS", 2)
    assert {r["model"]: r["weight"] for r in selection.ensemble_weights(bt, S, "RMSSE").collect()} == pytest.approx(_greedy_by_hand(flat, losses["RMSSE"]))
    assert selection.ensemble_weights(bt.limit(0), S, "RMSE").count() == 0


def test_newest_rows_are_the_same_by_rank_and_by_position(spark, monkeypatch, rows_per_task):
    df = fr.type_daily(spark, SF)
    by_rank = table(baseline.newest_rows(df, S, 5)), table(baseline.seasonal_naive(df, S, 9, 5))
    monkeypatch.setattr(baseline, "RANK_LIMIT", 0)
    for n in (4_000_000, 40):
        with rows_per_task(n):
            assert (table(baseline.newest_rows(df, S, 5)), table(baseline.seasonal_naive(df, S, 9, 5))) == by_rank


def test_regressions_use_statics_and_holidays(spark, series_of):
    rng = np.random.default_rng(1)
    noise = {k: [float(v) for v in 10 * (k in "cd") + rng.normal(0, 3, 60)] for k in "abcd"}
    df = series_of({k: days(y) for k, y in noise.items()}).withColumn("kind", F.when(F.col("item_id") < "c", "low").otherwise("high")).withColumn("size", F.lit(1))

    def error(spec):
        got = {(r["item_id"], r["step"]): r["yhat"] for r in tabular.tabular(df, spec, 5, "linear").collect()}
        assert len(got) == 20
        return np.mean([abs(v - 10 * (k in "cd")) for (k, _), v in got.items()])

    assert error(S.replace(statics=("kind", "size", "absent", "ts"))) < 0.8 * error(S)
    bumps = [((dt.datetime(2021, 1, 1) + dt.timedelta(days=i)), i) for i in range(850)]
    off = {(1, d) for d in range(1, 9)} | {(2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4)}
    df = series_of({"a": [(t.isoformat(), 50.0 if (t.month, t.day) in off else 10.0 + i % 3) for t, i in bumps]})
    got = {r["ts"]: r["yhat"] for r in tabular.tabular(df, S.replace(holidays=True), 15, "linear", strategy="direct").collect()}
    holidays = {t: v for t, v in got.items() if (t.month, t.day) in off}
    assert len(holidays) == 2 and min(holidays.values()) > 35 and max(v for t, v in got.items() if t not in holidays) < 20


def test_a_run_hands_statics_to_its_regressions(series_of):
    df = series_of({"a": LINE, "b": SEASON, "short": days([1.0, 9.0])}).withColumn("kind", F.upper("item_id"))
    p = RunParams("ts", "y", "item_id", "MAE", frequency="D", prediction_length=2, static_feature_columns=("kind",), use_russian_holidays=True, models_to_train=("ridge", "naive"), pycaret_models=("snaive",))
    got = forecast.run(df, p)
    assert got.predictions.where("y IS NOT NULL AND kind = upper(item_id)").count() == 6 and got.leaderboard.count() == 4


def test_hashed_statics_follow_their_values(spark):
    from tidegrid.models.tabular import Features

    df = spark.createDataFrame([(f"shop {i}", 1.0, 2.0) for i in range(200)], "kind string, size double, l1 double")
    kind = Features((1,), (), ("kind", "size")).sized(df)
    rows = kind.transform(kind.prepared(df)).select("features").collect()
    assert len({r.features for r in rows}) > 150  # 64 features tell 64 values apart at most


def test_direct_regression_reads_its_history_as_often_for_many_steps(spark):
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.range(120).selectExpr("concat('s', id % 3) AS item_id", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id div 3)) AS ts", "double(hash(id) % 50) AS y")
    counted = df.mapInPandas(run, df.schema)
    read = []
    for h in (2, 5):
        reads.value = 0
        got = tabular.tabular(counted, SeriesSpec(), h, "linear", strategy="direct").collect()
        assert len(got) == 3 * h
        read.append(reads.value)
    assert read[0] == read[1] <= 4 * 120, read
