"""Grid arithmetic against pandas, far dates and other session time zones included."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import grid

PANDAS = {"D": "D", "H": "h", "T": "min", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}
SPAN = {"D": 40, "H": 3, "T": 0.1, "W": 120, "M": 800, "Q": 1500, "Y": 4000}


def build(spark, pairs, freq):
    df = spark.createDataFrame(pairs, "id int, mn timestamp_ntz, mx timestamp_ntz")
    last = grid.last_index(F.col("mn"), F.col("mx"), freq)
    df = df.withColumn("k", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))))
    df = df.withColumn("ts", grid.grid_point(F.col("k"), F.col("mn"), freq))
    return df.withColumn("again", grid.grid_index(F.col("ts"), F.col("mn"), freq)).orderBy("id", "k")


@pytest.mark.parametrize("freq", grid.FREQUENCIES)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_same_points_as_pandas(spark, freq, zone):
    rng, first = random.Random(7), dt.datetime(1950, 1, 1)
    starts = [first + dt.timedelta(days=rng.randrange(51000), microseconds=rng.choice([0, 1, 43_200_000_000, rng.randrange(86_400_000_000)])) for _ in range(150)]
    starts += [s.replace(month=12, day=31) for s in starts[:30]]
    pairs = [(i, mn, mn + dt.timedelta(days=SPAN[freq] * rng.choice([0, 1, rng.random()]))) for i, mn in enumerate(starts)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got: dict = {}
        for r in build(spark, pairs, freq).collect():
            got.setdefault(r["id"], []).append(r["ts"])
            assert r["again"] == r["k"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for i, mn, mx in pairs:
        assert got.get(i, []) == [t.to_pydatetime(warn=False) for t in pd.date_range(mn, mx, freq=PANDAS[freq])]


@pytest.mark.parametrize("freq", grid.FREQUENCIES)
def test_rows_off_the_grid_have_no_index(spark, freq):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 2, 1, 5, 0, 1))], "mn timestamp_ntz, ts timestamp_ntz")
    assert df.select(grid.grid_index(F.col("ts"), F.col("mn"), freq)).first()[0] is None


def test_unknown_frequency(spark):
    with pytest.raises(ValueError, match="unknown frequency"):
        grid.check_freq("fortnight")
