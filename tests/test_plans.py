"""What the physical plans look like."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import frames as fr
from tests.conftest import SF
from tidegrid import SeriesSpec
from tidegrid.models import registry
from tidegrid.operators import correlation, drift, features, missing, quality, regular, series

#: Series known to be short: nothing is measured, plans are the everyday ones.
S = SeriesSpec(longest=1000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan(df)))


def events(spark):
    return fr.event_series(spark, SF)


def test_one_shuffle_for_windows(spark):
    df = events(spark)
    assert shuffles(features.add_lags(df, S)) == 1
    assert shuffles(features.add_rolling(features.add_lags(df, S), S)) == 1
    assert shuffles(missing.fill(df, "ffill", S, cols=["y"])) == 1
    assert shuffles(missing.fill(df, "interpolate", S, cols=["y"])) == 1


def test_regularising_and_everything_after_it_share_one_shuffle(spark):
    grid = regular.regularize(events(spark), S, "D")
    assert shuffles(grid) == 1
    assert "Join" not in plan(grid)
    assert shuffles(regular.regularize(events(spark), S, "D", snap=True)) == 1


def test_no_frame_is_recomputed_to_the_end_of_a_series(spark):
    for method in ("ffill", "interpolate"):
        assert "currentrow$(), unboundedfollowing$()" not in plan(missing.fill(events(spark), method, S, cols=["y"]))


def test_scans_read_only_what_is_used(spark):
    df = fr.table(spark, SF, "events").where(F.col("event_type") == "click")
    text = plan(quality.duplicate_keys(df, SeriesSpec("user_id", "ts", "value")))
    assert re.search(r"PushedFilters: \[IsNotNull\(event_type\), EqualTo\(event_type,click\)\]", text)
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>", text)


def test_newest_rows_are_limited_before_the_shuffle(spark):
    text = plan(registry.MODELS["seasonal_naive"](events(spark), S, 3, 7))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_calendar_cut_needs_no_shuffle_of_the_table(spark):
    df = events(spark)
    assert shuffles(series.label_segments(df, S, lambda n: [0, n], "part")) == 0


def test_a_holiday_needs_no_join(spark):
    assert "Join" not in plan(features.add_holiday(events(spark), "ts"))


def test_rolling_drift_of_a_wide_window_cuts_up_long_series(spark, rows_per_task, monkeypatch):
    series = spark.range(900).select((F.col("id") % 2).cast("string").alias("item_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.rand(3).alias("y"))
    new = spark.range(900, 960).select((F.col("id") % 2).cast("string").alias("item_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.rand(4) + 5).alias("y"))
    kept = sorted(tuple(r) for r in drift.rolling_drift(series, new, SeriesSpec(), 300).collect())
    monkeypatch.setattr(drift, "RANK_LIMIT", 10)
    with rows_per_task(100):
        cut = sorted(tuple(r) for r in drift.rolling_drift(series, new, SeriesSpec(), 300).collect())
    assert [r[0] for r in cut] == [r[0] for r in kept] == ["0", "1"]
    for a, b in zip(cut, kept, strict=True):
        assert a[1:] == pytest.approx(b[1:])


def test_many_columns_are_correlated_in_one_small_plan(spark):
    rng = np.random.default_rng(2)
    wide = rng.normal(1e6, 1.0, (300, 60))
    wide[:, 1] = wide[:, 0] * 2 + rng.normal(0, 0.1, 300)
    wide[rng.random((300, 60)) < 0.2] = np.nan
    wide[:, 5] = 0.1  # does not vary
    wide[:, 6] = np.nan
    names = [f"a.{i}" for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(wide, columns=names)).repartition(3)
    found = correlation.correlations(df, names)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    got = {(r.f1, r.f2): r.r for r in found.collect()}
    assert len(got) == 3600
    want = pd.DataFrame(wide, columns=names).corr(min_periods=2)
    for (a, b), r in got.items():
        if a in ("a.5", "a.6") or b in ("a.5", "a.6"):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-6)
    few = correlation.target_correlation(df, names, "a.0").collect()
    assert {r.feature for r in few} == {*names} - {"a.0"}
    assert {r.feature for r in few if r.level == "strong"} == {"a.1"}
    assert correlation.correlations(df, []).count() == 0
