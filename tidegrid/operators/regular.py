"""Bringing series onto a calendar grid, and setting aside those too short to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.grid import anchored_point, check_freq, grid_anchor, grid_index, last_index, micros, snapped_index, step_ahead
from tidegrid.spec import SeriesSpec, freq_code
from tidegrid.splits import join_stats, measured, nearest_known, over_series, with_group_stats

_CHUNK = 1_000_000  # grid points one array holds while a long gap is written out


def regularize(
    df: DataFrame, spec: SeriesSpec, freq: str | None = None, on_duplicate: str = "error", fill: bool = True, snap: bool = False
) -> DataFrame:
    """Every series from its first to its last timestamp at ``freq``, target carried forward.

    Rows off the grid are dropped, or with ``snap`` moved to it: to the nearest point of a daily, hourly or minute grid, to the
    end of their week or period on the others. Of several rows at one point the nearest stays, of equally near ones the
    later. On added rows all columns but the keys and the target are NULL. A frequency
    left open ('auto') returns the input. Two rows of a series at one timestamp are an error, or with
    ``on_duplicate='last'`` the last by ``spec.ties`` wins.

    Each row writes out the grid points up to the next row of its series, so the grid is never built apart and
    joined: one shuffle on the key serves the bounds, the next row and the carried value.
    """
    freq = freq or spec.freq
    if freq_code(freq) is None:
        return df
    check_freq(freq)
    spec = measured(df, spec)
    keys, ts, y = spec.keys, F.col(spec.ts), spec.target
    rows = df.where(ts.isNotNull())
    rows = with_group_stats(rows, spec, {"__mn": F.min(ts), "__mx": F.max(ts)})
    # Grid numbers are worked out once per row here, below the windows, and only carried from then on.
    rows = rows.select(
        *df.columns,
        (snapped_index if snap else grid_index)(ts, F.col("__mn"), freq).alias("__k"),
        grid_anchor(F.col("__mn"), freq).alias("__anchor"),
        (snapped_index(F.col("__mx"), F.col("__mn"), freq) if snap else last_index(F.col("__mn"), F.col("__mx"), freq)).alias("__end"),
    )
    if snap:
        rows = _one_per_point(rows, spec, freq, on_duplicate)
    rows = over_series(rows, spec, {"__prior": lambda w: F.lag(F.lit(1)).over(w)}, before=1)
    # A first row off the grid stays as an anchor: it stands for the grid points before the first row on it.
    rows = rows.where(F.col("__k").isNotNull() | F.col("__prior").isNull())
    rows = over_series(rows, spec, {"__next": lambda w: F.lead("__k").over(w)}, after=1)
    value = F.col(y)
    if fill:
        rows = nearest_known(rows, spec, {"y": F.when(F.col("__k").isNotNull(), F.col(y))}, ahead=False)
        value = F.col("__prev_y.v")
    start, upto = F.coalesce("__k", F.lit(0)), F.coalesce(F.col("__next") - 1, F.col("__end"))
    if on_duplicate == "error":
        twice = F.raise_error(F.concat(F.lit(f"duplicate timestamp in a series: {spec.ts}="), ts.cast("string"))).cast("long")
        upto = F.when(F.col("__next") == F.col("__k"), twice).otherwise(upto)
    rows = rows.withColumn("__from", start.cast("long")).withColumn("__to", upto.cast("long")).where(F.col("__to") >= F.col("__from"))
    rows = rows.withColumn("__c", F.explode(F.sequence("__from", "__to", F.lit(_CHUNK).cast("long"))))
    rows = rows.withColumn("__g", F.explode(F.sequence("__c", F.least(F.col("__c") + (_CHUNK - 1), F.col("__to")))))
    own = F.col("__g") == F.col("__k")

    def cell(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c == spec.ts:
            point = anchored_point(F.col("__g"), F.col("__anchor"), freq)
            return (point if snap else F.when(own, ts).otherwise(point)).alias(c)
        if c == y:
            return (value if fill else F.when(own, value)).alias(c)
        return F.when(own, F.col(c)).alias(c)

    return rows.select(*[cell(c) for c in df.columns])


def _one_per_point(rows: DataFrame, spec: SeriesSpec, freq: str, on_duplicate: str) -> DataFrame:
    """Of the rows moved to one grid point the nearest, or the latest of those. Partitioned by the series and the point, so the
    shuffle on the series serves this window as well, and a long series is cut by its points."""
    ts = F.col(spec.ts)
    far = F.abs(micros(ts) - micros(anchored_point(F.col("__k"), F.col("__anchor"), freq)))
    rows = rows.withColumn("__far", far)
    w = Window.partitionBy(*spec.keys, "__k").orderBy("__far", *[F.desc(c) for c in spec.order])
    place = F.row_number().over(w)
    if on_duplicate == "error":
        twice = F.raise_error(F.concat(F.lit(f"duplicate timestamp in a series: {spec.ts}="), ts.cast("string"))).cast("int")
        place = F.when(F.lead(spec.ts).over(w) == ts, twice).otherwise(place)
    return rows.withColumn("__place", place).where(F.col("__place") == 1).drop("__far", "__place")


def min_required(horizon: int) -> int:
    """Grid rows a series needs to take part in training."""
    return max(horizon + 1, 5) + horizon


def grid_profile(df: DataFrame, spec: SeriesSpec, freq: str, horizon: int, snap: bool = False) -> DataFrame:
    """Per series: rows, grid length, whether the grid adds rows, whether it is too short, rows off the grid.

    Needs no grid: the length follows from the first and the last timestamp.
    """
    ends = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(spec.ts).alias("first"), F.max(spec.ts).alias("last"))
    index = snapped_index(F.col("last"), F.col("first"), freq) if snap else last_index(F.col("first"), F.col("last"), freq)
    length = F.coalesce(index + 1, F.lit(0)).cast("long")
    return (
        ends.withColumn("grid_rows", length)
        .withColumn("extended", F.col("grid_rows") > F.col("n_rows"))
        .withColumn("short", F.col("grid_rows") < min_required(horizon))
    )


def off_grid_rows(df: DataFrame, spec: SeriesSpec, freq: str) -> DataFrame:
    """Rows per series that regularising drops because they do not lie on the grid."""
    rows = with_group_stats(df, spec, {"__mn": F.min(spec.ts)})
    off = grid_index(F.col(spec.ts), F.col("__mn"), freq).isNull()
    return rows.groupBy(*spec.keys).agg(F.count_if(off).alias("dropped")).where(F.col("dropped") > 0)


def snapped_rows(df: DataFrame, spec: SeriesSpec, freq: str) -> DataFrame:
    """Series with rows off the grid: how many snapping moves (``moved``), and how many rows it leaves out because another one
    takes their point (``merged``)."""
    first = F.col("__mn")
    rows = with_group_stats(df.where(F.col(spec.ts).isNotNull()), spec, {"__mn": F.min(spec.ts)})
    off = grid_index(F.col(spec.ts), first, freq).isNull()
    points = rows.groupBy(*spec.keys, snapped_index(F.col(spec.ts), first, freq).alias("__k")).agg(F.count_if(off).alias("__off"), F.count(F.lit(1)).alias("__n"))
    return points.groupBy(*spec.keys).agg(F.sum("__off").alias("moved"), F.sum(F.col("__n") - 1).alias("merged")).where(F.col("moved") > 0)


def split_short(regular: DataFrame, spec: SeriesSpec, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(rows of series long enough to train on, rows of the others), counted on the grid."""
    n = regular.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("__len"))
    sized = join_stats(regular, n, spec.keys)
    enough = F.col("__len") >= min_required(horizon)
    return sized.where(enough).drop("__len"), sized.where(~enough).drop("__len")


def naive_fallback(regular: DataFrame, spec: SeriesSpec, horizon: int, freq: str | None = None) -> DataFrame:
    """The last grid value of each too short series, repeated over the next ``horizon`` grid dates."""
    last = regular.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("__len"), F.max(spec.ts).alias("__last"), F.max_by(spec.target, spec.ts).alias(spec.target)
    )
    steps = last.where(F.col("__len") < min_required(horizon)).withColumn("__step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = step_ahead(F.col("__last"), F.col("__step"), freq or spec.freq)
    return steps.select(*spec.keys, ahead.alias(spec.ts), spec.target)


def run_messages(df: DataFrame, spec: SeriesSpec, freq: str, horizon: int, snap: bool = False) -> DataFrame:
    """One message per series that the grid extended, that is too short for a full forecast, or that loses rows off the grid;
    with ``snap`` one on the rows moved to the grid instead."""
    code = freq_code(freq)
    profile = grid_profile(df, spec, freq, horizon, snap)
    id = F.col(spec.id).cast("string")
    short = profile.where("short").select(
        id.alias("item_id"), F.lit("short").alias("kind"),
        F.format_string("Series %s has too few rows for a full forecast; a naive forecast was made.", id).alias("message"),
    )
    extended = profile.where(F.col("extended") & ~F.col("short")).select(
        id.alias("item_id"), F.lit("extended").alias("kind"),
        F.format_string(f"Series %s was extended to frequency {code} by forward fill.", id).alias("message"),
    )
    if snap:
        moved = snapped_rows(df, spec, code).select(
            id.alias("item_id"), F.lit("snapped").alias("kind"),
            F.format_string(f"Series %s has %d rows off the grid of frequency {code}; they were moved to it, and %d rows left out for a nearer or later one.", id, "moved", "merged").alias("message"),
        )
        return short.unionByName(extended).unionByName(moved)
    dropped = off_grid_rows(df, spec, code).select(
        id.alias("item_id"), F.lit("dropped").alias("kind"),
        F.format_string(f"Series %s has %d rows off the grid of frequency {code}; they were dropped.", id, "dropped").alias("message"),
    )
    return short.unionByName(extended).unionByName(dropped)
