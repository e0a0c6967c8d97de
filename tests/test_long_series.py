"""Every ordered or grouped operator gives the same rows whether or not its series are cut up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog import frames as fr
from tests.conftest import SF, table
from tidegrid import SeriesSpec
from tidegrid.operators import charts, correlation, drift, features, missing, quality, regular, seasonal, series
from tidegrid.quantiles import quantiles
from tidegrid.splits import running_sums, with_positions

S = SeriesSpec()
E = S.replace(ties=("event_id",))
ONE = SeriesSpec(id=None, ties=("event_id",))


def holes(spark):
    """Events as five long series with every purchase value missing, plus a NULL id."""
    e = fr.event_series(spark, SF)
    id = F.when(F.col("item_id") != "view", F.col("item_id"))
    return e.select(id.alias("item_id"), "ts", F.when(F.col("user_id") % 3 != 0, F.col("y")).alias("y"), "event_id")


def minutes(spark):
    """One row per type and distinct minute."""
    e = fr.event_series(spark, SF)
    return e.groupBy("item_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("y").alias("y"))


CASES = {
    "positions": lambda s: with_positions(holes(s), E, "p", "n"),
    "positions of one series": lambda s: with_positions(holes(s), ONE, "p", "n"),
    "running sums": lambda s: running_sums(holes(s).na.fill(0.0), E, ["y"]),
    "ffill": lambda s: missing.fill(holes(s), "ffill", E, cols=["y"]),
    "ffill of one series": lambda s: missing.fill(holes(s), "ffill", E, group_cols=(), cols=["y"]),
    "interpolate": lambda s: missing.fill(holes(s), "interpolate", E, cols=["y"]),
    "group mean": lambda s: missing.fill(holes(s), "group_mean", E, cols=["y"]),
    "lags": lambda s: features.add_lags(holes(s), E),
    "lags of one series": lambda s: features.add_lags(holes(s), ONE, (1, 7)),
    "rolling": lambda s: features.add_rolling(holes(s), E),
    "regular hours": lambda s: regular.regularize(minutes(s), S, "H"),
    "regular days": lambda s: regular.regularize(minutes(s), S, "D"),
    "regular weeks": lambda s: regular.regularize(minutes(s), S, "W"),
    "gaps": lambda s: quality.find_gaps(holes(s), S),
    "gaps of one series": lambda s: quality.find_gaps(holes(s), S.replace(id=None)),
    "thin": lambda s: series.series_thin(holes(s), E),
    "split by time": lambda s: series.label_by_time(holes(s), E, 0.2, 0.1),
    "missing profile": lambda s: quality.missing_profile(holes(s), E),
    "acf": lambda s: seasonal.acf(holes(s), E, 10),
    "pacf": lambda s: seasonal.pacf(holes(s), E, 10),
    "decompose": lambda s: seasonal.decompose(minutes(s), S, 12),
    "period": lambda s: seasonal.detect_period(minutes(s), S),
    "patterns": lambda s: seasonal.seasonal_patterns(holes(s), S),
    "profile": lambda s: quality.profile(holes(s), S),
    "describe": lambda s: quality.describe(holes(s), ["y", "event_id"]),
    "iqr": lambda s: quality.flag_outliers(holes(s), S, "iqr"),
    "box": lambda s: charts.box_stats(holes(s), "y", "item_id"),
    "quantiles": lambda s: quantiles(holes(s), ["item_id"], "y", {f"p{i}": i / 20 for i in range(0, 21, 4)}),
    "ks": lambda s: drift.ks_two_sample(*fr.samples(s, SF), "y"),
    "rolling drift": lambda s: drift.rolling_drift(*fr.samples(s, SF), S.replace(ties=("o_orderkey",))),
    "correlation": lambda s: correlation.correlations(holes(s), ["y", "event_id"]),
}


@pytest.mark.parametrize("name", CASES)
def test_cut_up_equals_whole(spark, rows_per_task, name):
    whole = table(CASES[name](spark))
    with rows_per_task(60):
        assert table(CASES[name](spark)) == whole
    assert whole


def test_one_hot_series_among_short_ones(spark, rows_per_task):
    e = fr.event_series(spark, SF)
    id = F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string")))
    df = e.select(id.alias("item_id"), "ts", "y", "event_id")
    whole = table(features.add_rolling(df, E, (3, 9)))
    with rows_per_task(150):
        assert table(features.add_rolling(df, E, (3, 9))) == whole


def test_values_that_are_nearly_all_equal(spark, rows_per_task):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    whole = table(quantiles(df, [], "v", {"a": 0.1, "b": 0.979, "c": 0.98, "d": 0.995}))
    with rows_per_task(40):
        assert table(quantiles(df, [], "v", {"a": 0.1, "b": 0.979, "c": 0.98, "d": 0.995})) == whole


def test_a_long_series_is_not_ordered_in_one_task(spark, rows_per_task):
    """Cut up, no window is partitioned by the series key alone except over per-block side tables."""
    with rows_per_task(60):
        df = features.add_lags(holes(spark), E, (1,))
        largest = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in plan
    assert largest < holes(spark).count()


def counted_reads(spark, df):
    """``df``, and an accumulator that counts how many of its rows are read, each time they are."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), reads


def test_quantiles_of_long_groups_take_two_passes(spark, rows_per_task):
    n = 3000
    df, reads = counted_reads(spark, spark.range(n).select((F.hash("id") % 1000 / 7).alias("v")).withColumn("w", F.col("v") * 2))
    whole = table(quality.describe(df))
    reads.value = 0
    with rows_per_task(100):
        assert table(quality.describe(df)) == whole
    # Lengths, statistics and the two passes, with what adaptive planning reads twice.
    assert reads.value <= 6 * n, reads.value


def test_a_rank_outside_its_bracket_is_found(spark, rows_per_task, monkeypatch):
    from tidegrid import quantiles as module

    calls, ranked = [], module._ranked
    monkeypatch.setattr(module, "_SLACK", 0.0)
    monkeypatch.setattr(module, "_ACCURACY", 3)
    monkeypatch.setattr(module, "_ranked", lambda *a: calls.append(a) or ranked(*a))
    df = spark.range(900).select((F.col("id") % 2).alias("g"), (F.hash("id") % 1000).alias("v"))
    levels = {"a": 0.1, "b": 0.5, "c": 0.93}
    whole = table(quantiles(df, ["g"], "v", levels))
    with rows_per_task(40):
        assert table(quantiles(df, ["g"], "v", levels)) == whole
    assert len(calls) == 2
