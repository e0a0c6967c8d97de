"""Hand-worked cases of shaping, filling, regularising and features."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import days, rows
from tidegrid import RunParams, SeriesSpec
from tidegrid.operators import features, missing, quality, regular, series
from tidegrid.sources.dates import auto_convert_dates

S = SeriesSpec()
D = dt.datetime


def values(df, *order):
    return [r["y"] for r in df.orderBy(*(order or ("item_id", "ts"))).collect()]


# --- shaping


def test_to_series_renames_casts_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(7, "2024-01-02", float("nan"), "x")], "shop int, day string, sales double, note string")
    out = series.to_series(df, SeriesSpec("shop", "day", "sales"))
    assert rows(out) == [("7", D(2024, 1, 2), None, "x")]


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="missing columns: day"):
        series.to_series(spark.range(1), SeriesSpec("id", "day", "id"))


def test_dates_that_do_not_parse_become_null(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02 03:04:05",), ("soon",), (None,)], "d string")
    assert [r[0] for r in series.safe_timestamp(df, "d").collect()] == [D(2024, 1, 2), D(2024, 1, 2, 3, 4, 5), None, None]
    assert series.count_invalid(df, "d").first()[0] == 1


def test_date_conversion_needs_every_value(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01", None), (None, "no", None)], "a string, b string, c string")
    assert dict(auto_convert_dates(df).dtypes) == {"a": "timestamp_ntz", "b": "string", "c": "timestamp_ntz"}
    slashes = spark.createDataFrame([("02/01/2024",)], "a string")
    assert auto_convert_dates(slashes, ("dd/MM/yyyy",)).first()[0] == D(2024, 1, 2)


def test_statics_take_the_first_row_in_time(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 2), "late"), ("a", D(2024, 1, 1), "early")], "item_id string, ts timestamp_ntz, kind string")
    assert rows(series.static_table(df, "item_id", ["kind", "absent"], "ts")) == [("a", "early")]


def test_thinning_keeps_fifty_positions(series_of):
    n = 145
    out = series.series_thin(series_of({"a": days(range(n))}), S)
    assert sorted(values(out)) == [float(int(i * (n / 50))) for i in range(50)]


def test_series_by_id_of_nothing_is_an_error(series_of):
    with pytest.raises(ValueError, match="no series"):
        series.series_by_id(series_of({"a": days([1.0])}), S, "b")


@pytest.mark.parametrize("n", [1, 2, 9, 10, 33])
@pytest.mark.parametrize("val", [0.0, 0.1])
def test_split_by_time_cuts_at_row_shares(series_of, n, val):
    # Six rows a day, so that cuts fall inside a day.
    points = [((D(2024, 1, 1) + dt.timedelta(hours=4 * i)).isoformat(), float(i)) for i in range(n)]
    train, test, valid = series.split_by_time(series_of({"a": points}), S, 0.2, val)
    a, b = int(n * (1 - 0.2 - val)), int(n * (1 - 0.2))
    assert values(train) == [float(i) for i in range(a if val else b)]
    assert values(test) == [float(i) for i in range(b, n)]
    assert (valid is None) == (val == 0)
    if val:
        assert values(valid) == [float(i) for i in range(a, b)]


# --- missing values

HOLES = [None, 1.0, None, None, 4.0, None]


@pytest.mark.parametrize(
    ("method", "want"),
    [
        ("None", HOLES),
        ("constant_zero", [0.0, 1.0, 0.0, 0.0, 4.0, 0.0]),
        ("forward_fill", [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]),
        ("Group mean", [2.5, 1.0, 2.5, 2.5, 4.0, 2.5]),
        ("interpolate", [None, 1.0, 2.0, 3.0, 4.0, 4.0]),
    ],
)
def test_fill(series_of, method, want):
    assert values(missing.fill(series_of({"a": days(HOLES)}), method, S)) == want


def test_fill_keeps_groups_apart_and_null_ids_together(series_of):
    df = series_of({"a": days([None, None]), "b": days([1.0, None]), None: days([None, 5.0])})
    out = missing.fill(df, "ffill", S)
    assert values(out.where("item_id = 'a'")) == [None, None]
    assert values(out.where("item_id = 'b'")) == [1.0, 1.0]
    assert values(out.where("item_id IS NULL")) == [5.0, 5.0]


def test_nan_counts_as_missing(series_of):
    assert values(missing.fill(series_of({"a": days([float("nan"), 2.0])}), "ffill", S)) == [2.0, 2.0]


def test_unknown_fill_method_is_an_error(series_of):
    with pytest.raises(ValueError, match="unknown fill method"):
        missing.fill(series_of({"a": days([1.0])}), "guess", S)


def knn_by_hand(data, k):
    """Brute force over lists of (a, b, c) with None for missing."""
    out = []
    for q in data:
        filled = list(q)
        for j in range(3):
            if q[j] is not None:
                continue
            found = []
            for i, d in enumerate(data):
                both = [x for x in range(3) if q[x] is not None and d[x] is not None]
                if d[j] is not None and both:
                    found.append((math.sqrt(sum((q[x] - d[x]) ** 2 for x in both) * 3 / len(both)), i, d[j]))
            have = [d[j] for d in data if d[j] is not None]
            near = [v for _, _, v in sorted(found)[:k]] or have
            filled[j] = sum(near) / len(near)
        out.append(filled)
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_knn_against_brute_force(spark, block):
    import random

    rng = random.Random(3)
    data = [[None if rng.random() < 0.25 else round(rng.gauss(0, 5), 3) for _ in range(3)] for _ in range(40)]
    df = spark.createDataFrame([("g", D(2024, 1, 1) + dt.timedelta(days=i), *r) for i, r in enumerate(data)], "item_id string, ts timestamp_ntz, a double, b double, c double")
    by = SeriesSpec(id=None, ts="ts", by=("item_id",))
    got = [tuple(r)[2:] for r in missing.fill_knn(df, by, ["a", "b", "c"], 5, block_rows=block).orderBy("ts").collect()]
    for g, w in zip(got, knn_by_hand(data, 5)):
        assert g == pytest.approx(w)


@pytest.mark.parametrize("groups", [("item_id",), ()])
def test_knn_of_large_groups_with_ties_and_lone_patterns(spark, groups):
    import random

    rng = random.Random(8)
    data = [[None if rng.random() < 0.2 else float(rng.randint(0, 6)) for _ in range(3)] for _ in range(260)]
    data += [[None, None, None], [None, None, 50.0], [90.0, None, None]]
    rows = [("g", D(2020, 1, 1) + dt.timedelta(days=i), *r) for i, r in enumerate(data)]
    small = [("h", D(2020, 1, 1) + dt.timedelta(days=i), *r) for i, r in enumerate(data[:9])] if groups else []
    df = spark.createDataFrame(rows + small, "item_id string, ts timestamp_ntz, a double, b double, c double")
    by = SeriesSpec(id=None, ts="ts", by=groups)
    got = [tuple(r) for r in missing.fill_knn(df, by, ["a", "b", "c"], 4, block_rows=20).orderBy("item_id", "ts").collect()]
    for g, w in zip(got, knn_by_hand(data, 4) + (knn_by_hand(data[:9], 4) if groups else []), strict=True):
        assert list(g[2:]) == pytest.approx(w)


def test_knn_sends_rows_in_proportion(spark, monkeypatch):
    sent, meet = [], missing._meet

    def counted(cells, donors, by, cols, k, block_rows):
        blocks = cells.groupBy("__c", "__p", "__b").count().join(donors.groupBy("__c", "__p", "__b").agg(F.count(F.lit(1)).alias("d")), ["__c", "__p", "__b"])
        sent.append(blocks.agg(F.sum(F.col("count") + F.col("d") * F.ceil(F.col("count") / block_rows))).first()[0] or 0)
        return meet(cells, donors, by, cols, k, block_rows)

    monkeypatch.setattr(missing, "_meet", counted)
    totals = []
    for n in (8_000, 40_000):
        value = (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"), F.when(F.rand(3) < 0.9, F.rand(4)).alias("z")
        df = spark.range(n).select(F.lit("g").alias("item_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), *value)
        sent.clear()
        assert missing.fill_knn(df, SeriesSpec(id=None, ts="ts", by=("item_id",)), ["x", "y", "z"], 5, block_rows=200).where("z IS NULL").count() == 0
        totals.append(sum(sent))
    assert totals[1] < 7 * totals[0], totals


# --- grids


def test_regularize_carries_the_target_only(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, "x"), ("a", D(2024, 1, 4), 4.0, "y")], "item_id string, ts timestamp_ntz, y double, extra string")
    out = rows(regular.regularize(df, S, "D"), "ts")
    assert [(r[2], r[3]) for r in out] == [(1.0, "x"), (1.0, None), (1.0, None), (4.0, "y")]


def test_month_start_rows_lie_off_a_month_end_grid(series_of):
    df = series_of({"a": [("2024-01-01", 1.0), ("2024-02-01", 2.0), ("2024-03-01", 3.0)]})
    assert rows(regular.regularize(df, S, "M"), "ts") == [("a", D(2024, 1, 31), None), ("a", D(2024, 2, 29), None)]
    assert rows(regular.off_grid_rows(df, S, "M")) == [("a", 3)]


def test_snapping_moves_rows_to_the_grid(spark, series_of, rows_per_task):
    df = series_of({"a": [("2024-01-01", 1.0), ("2024-02-01", 2.0), ("2024-04-01", 4.0), ("2024-04-20", 5.0)]})
    ends = [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]
    assert rows(regular.regularize(df, S, "M", snap=True), "ts") == [("a", t, v) for t, v in zip(ends, [1.0, 2.0, 2.0, 5.0])]
    assert rows(regular.snapped_rows(df, S, "M")) == [("a", 4, 1)]
    assert [r["kind"] for r in regular.run_messages(df, S, "M", 3, snap=True).collect()] == ["short", "snapped"]
    assert regular.grid_profile(df, S, "M", 3, snap=True).first()["grid_rows"] == 4
    weeks = series_of({"a": [("2024-01-03", 1.0), ("2024-01-07", 2.0), ("2024-01-08", 3.0)]})
    assert rows(regular.regularize(weeks, S, "W", snap=True), "ts") == [("a", D(2024, 1, 7), 2.0), ("a", D(2024, 1, 14), 3.0)]
    # A row on the grid beats a later one near it; half way goes to the later point.
    near = [("2024-01-01T00:00", 1.0), ("2024-01-01T05:00", 9.0), ("2024-01-01T12:00", 2.0), ("2024-01-03T20:00", 3.0), (None, 7.0)]
    kept = [("a", D(2024, 1, d), v) for d, v in [(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)]]
    many = series_of({"a": near, "b": days(range(40))})
    for n in (1000, 10):
        with rows_per_task(n):
            assert rows(regular.regularize(many, S, "D", snap=True).where("item_id = 'a'"), "ts") == kept
    twice = series_of({"a": [("2024-01-01", 1.0), ("2024-01-01", 2.0)]})
    with pytest.raises(Exception, match="duplicate timestamp"):
        regular.regularize(twice, S, "D", snap=True).collect()
    assert values(regular.regularize(twice, S.replace(ties=("y",)), "D", on_duplicate="last", snap=True)) == [2.0]
    assert regular.regularize(df.limit(0), S, "M", snap=True).count() == 0


def test_unsorted_input_and_explicit_nulls(series_of):
    df = series_of({"a": [("2024-01-03", 3.0), ("2024-01-01", 1.0), ("2024-01-02", None)]})
    assert values(regular.regularize(df, S, "D")) == [1.0, 1.0, 3.0]


def test_duplicate_timestamps(series_of):
    df = series_of({"a": [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-02", 5.0)]})
    with pytest.raises(Exception, match="duplicate timestamp"):
        regular.regularize(df, S, "D").collect()
    assert values(regular.regularize(df, S.replace(ties=("y",)), "D", on_duplicate="last")) == [1.0, 5.0]


def test_auto_frequency_changes_nothing(series_of):
    df = series_of({"a": days([1.0])})
    assert regular.regularize(df, S, "auto") is df


def test_short_series_leave_training_and_get_the_naive_forecast(series_of):
    df = series_of({"long": days(range(8)), "short": days([1.0, 2.0])})
    assert regular.min_required(3) == 8
    kept, short = regular.split_short(df, S, 3)
    assert {r["item_id"] for r in kept.collect()} == {"long"}
    assert {r["item_id"] for r in short.collect()} == {"short"}
    assert rows(regular.naive_fallback(df, S, 3, "D"), "ts") == [("short", D(2024, 1, d), 2.0) for d in (3, 4, 5)]


def test_messages_name_extended_and_short_series(series_of):
    df = series_of({"full": days(range(9)), "gap": [p for i, p in enumerate(days(range(9))) if i != 4], "short": days([1.0])})
    assert {(r["item_id"], r["kind"]) for r in regular.run_messages(df, S, "D", 3).collect()} == {("gap", "extended"), ("short", "short")}


# --- features


def test_holidays(spark):
    df = spark.createDataFrame([(D(2024, 1, 8, 13),), (D(2024, 1, 9),), (D(2025, 11, 4),), (None,)], "ts timestamp_ntz")
    moved = spark.createDataFrame([(dt.date(2024, 1, 9),)], "holiday date")
    assert sorted([r[1] for r in features.add_holiday(df, "ts").collect()]) == [0.0, 0.0, 1.0, 1.0]
    assert sorted([r[1] for r in features.add_holiday(df, "ts", calendar=moved).collect()]) == [0.0, 1.0, 1.0, 1.0]
    assert features.add_holiday(df, "absent") is df


def test_time_features(spark):
    df = spark.createDataFrame([(D(2024, 2, 29, 23, 59),)], "ts timestamp_ntz")
    row = features.add_time_features(df, "ts", ["year", "dayofweek", "is_month_end", "is_weekend", "hour", "minute", "quarter"]).first()
    assert (row.year, row.dayofweek, row.is_month_end, row.is_weekend, row.hour, row.minute, row.quarter) == (2024, 3, 1, 0, 23, 59, 1)
    assert len(features.add_time_features(df, "ts").columns) == 11


def test_rolling_skips_unknown_functions_and_nulls(series_of):
    out = features.add_rolling(series_of({"a": days([1.0, None, 3.0])}), S, (2,), ("mean", "std", "mode"))
    assert out.columns[3:] == ["y_rolling_2_mean", "y_rolling_2_std"]
    assert [tuple(r)[3:] for r in out.orderBy("ts").collect()] == [(1.0, None), (1.0, None), (3.0, None)]


@pytest.mark.parametrize("kind", ["log", "sqrt", "box-cox", "yeo-johnson"])
def test_inverse_undoes_the_transformation(spark, kind):
    data = [0.0, 0.5, 2.0, 30.0] if kind in ("log", "sqrt") else [-3.0, 0.0, 0.5, 2.0, 30.0]
    df = spark.createDataFrame([(v,) for v in data], "y double")
    there, params = features.transform_target(df, "y", kind)
    back = sorted(r[0] for r in features.inverse_target(there, "y", params).collect())
    assert back == pytest.approx(data, abs=1e-6)


def test_fitted_lambda_is_the_most_likely(spark):
    import numpy as np

    x = np.exp(np.random.default_rng(1).normal(1, 0.4, 400)) ** 1.0
    df = spark.createDataFrame([(float(v),) for v in x], "y double")
    lam = features.transform_target(df, "y", "box-cox")[1].lam

    def likelihood(g):
        z = np.log(x) if abs(g) < 1e-12 else (x**g - 1) / g
        return (g - 1) * np.log(x).sum() - len(x) / 2 * np.log(z.var())

    assert all(likelihood(lam) >= likelihood(lam + d) for d in (-1e-3, 1e-3, -0.1, 0.1))


def test_inverse_without_lambda_is_an_error(spark):
    with pytest.raises(ValueError, match="lambda"):
        features.inverse_target(spark.range(1), "id", features.TransformParams("box-cox"))


# --- quality


def test_constant_series_have_no_outliers(series_of):
    clean, out = quality.detect_outliers(series_of({"a": days([2.0] * 6)}), S, "zscore")
    assert (clean.count(), out.count()) == (6, 0)


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_clean_and_outliers_make_up_the_input(series_of, method):
    df = series_of({"a": days([1.0, 2.0, 1.5, 900.0, None] + [1.0] * 30), None: days([1.0])})
    clean, out = quality.detect_outliers(df, S, method)
    assert clean.count() + out.count() == df.count()
    assert 900.0 in [r["y"] for r in out.collect()]


def test_validation_stops_at_the_first_error(spark, series_of):
    bad = quality.validate(spark.createDataFrame([("a", "soon", 1.0)], "item_id string, ts string, y double"), S)
    assert [(r.severity, r.code) for r in bad.collect()] == [("error", "invalid dates: ts")]
    assert not quality.is_valid(bad)
    text = spark.createDataFrame([("a", "2024-01-01", "x")], "item_id string, ts string, y string")
    assert [r.code for r in quality.validate(text, S).collect()] == ["not numeric: y"]
    assert [r.code for r in quality.validate(text.drop("y"), S).collect()] == ["missing column: y"]
    fine = series_of({"a": days([1.0, 2.0, 3.0])})
    assert quality.validate(fine, S.replace(id=quality.NO_COLUMN)).count() == 0


def test_gaps_ignore_repeated_timestamps(series_of):
    df = series_of({"a": [("2024-01-01", 1.0), ("2024-01-01", 1.0), ("2024-01-02", 1.0), ("2024-01-03", 1.0), ("2024-01-06", 1.0)]})
    assert rows(quality.find_gaps(df, S)) == [(86400.0, 1, 1)]


def test_missing_profile_keeps_empty_bins(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), None), (D(2024, 1, 2), "")], "when_time timestamp_ntz, v string")
    out = rows(quality.missing_profile(df, SeriesSpec(None, "when_time", "v")), "bin")
    assert out[0] == (1, "2024-01-01 - 2024-01-01", 1, 1)
    assert out[1] == (2, "2024-01-02 - 2024-01-02", 1, 1)
    assert out[2:] == [(i, str(i), 0, 0) for i in range(3, 13)]


def test_run_parameters_round_trip():
    p = RunParams("d", "y", "i", "MASE (scaled)", frequency="D (daily)", static_feature_columns=("s",))
    assert p.spec().freq == "D" and p.spec().statics == ("s",)
    assert '"prediction_length": 3' in p.to_json()


def test_statics_prefer_dated_rows(spark):
    df = spark.createDataFrame([("a", None, "undated"), ("a", D(2024, 1, 1), "first"), ("b", None, "only")], "item_id string, ts timestamp_ntz, kind string")
    assert rows(series.static_table(df, "item_id", ["kind"], "ts"), "item_id") == [("a", "first"), ("b", "only")]


def test_holidays_follow_the_law_of_their_year(spark):
    from tidegrid.functions.calendar import is_fixed_holiday

    want = {(1998, 11, 4): False, (1998, 11, 7): True, (1998, 1, 5): False, (2005, 11, 4): True, (2005, 11, 7): False, (2005, 1, 5): True,
            (2012, 1, 6): False, (2013, 1, 8): True, (2001, 2, 23): False, (2002, 2, 23): True, (2004, 5, 2): True, (2005, 5, 2): False,
            (2004, 12, 12): True, (2005, 12, 12): False, (1998, 1, 1): True, (2024, 5, 9): True}
    df = spark.createDataFrame([(D(*k), v) for k, v in want.items()], "ts timestamp_ntz, want boolean")
    assert df.where(is_fixed_holiday(df["ts"]) != df["want"]).count() == 0


def test_knn_of_many_groups_reads_its_input_a_few_times(spark):
    import random

    rng = random.Random(4)
    groups = {f"g{g}": [[None if rng.random() < 0.3 else float(rng.randint(0, 5)) for _ in range(3)] for _ in range(9)] for g in range(30)}
    groups["g7"] = groups["g8"] = [[1.0, 2.0, None], [None, None, None], [None, 3.0, 4.0]]
    data = [(None if g == "g3" else g, D(2024, 1, 1) + dt.timedelta(days=i), *r) for g, part in groups.items() for i, r in enumerate(part)]
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.createDataFrame(data, "item_id string, ts timestamp_ntz, a double, b double, c double")
    counted = df.mapInPandas(run, df.schema)
    got = {(r[0], r[1]): r[2:] for r in missing.fill_knn(counted, SeriesSpec(id=None, ts="ts", by=("item_id",)), ["a", "b", "c"], 4).collect()}
    for g, part in groups.items():
        for i, w in enumerate(knn_by_hand(part, 4) if g not in ("g7", "g8") else [[1.0, 2.0, 4.0], [1.0, 2.5, 4.0], [1.0, 3.0, 4.0]]):
            assert list(got[None if g == "g3" else g, D(2024, 1, 1) + dt.timedelta(days=i)]) == pytest.approx(w)
    assert reads.value <= 3 * len(data), reads.value
