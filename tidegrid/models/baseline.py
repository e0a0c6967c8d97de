"""Forecasts that need one aggregate per series. Every model returns ``(keys, step, <ts>, yhat)``.

A series is its non-NULL rows in time order; seasons are counted back from the last one. The forecast dates
are the next grid dates after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.grid import step_ahead
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, running_sums, with_positions

LAST, AT, LEN = "__last", "__at", "__len"


def known_rows(df: DataFrame, spec: SeriesSpec, extra: list[str] | None = None) -> DataFrame:
    """Keys, order, target and ``extra`` columns of the rows with a target."""
    value = F.col(spec.target).cast("double").alias(spec.target)
    return df.select(*spec.keys, *spec.order, value, *[F.col(f"`{c}`") for c in extra or []]).where(F.col(spec.target).isNotNull())


def statics_in(df: DataFrame, spec: SeriesSpec) -> list[str]:
    """The static columns that ``df`` has besides keys, order and target."""
    taken = {*spec.keys, *spec.order, spec.target}
    return [c for c in dict.fromkeys(spec.statics) if c in df.columns and c not in taken]


def covariates_in(df: DataFrame, spec: SeriesSpec) -> list[str]:
    """The columns known ahead that ``df`` has besides keys, order, target and static columns."""
    taken = {*spec.keys, *spec.order, spec.target, *statics_in(df, spec)}
    return [c for c in dict.fromkeys(spec.known) if c in df.columns and c not in taken]


def over_steps(per_series: DataFrame, spec: SeriesSpec, h: int, yhat: Column) -> DataFrame:
    """Spread one row per series (with ``LAST``) over steps 1 to h; ``yhat`` may use ``step``."""
    steps = per_series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return steps.select(*spec.keys, "step", step_ahead(F.col(LAST), F.col("step"), spec.freq).alias(spec.ts), yhat.cast("double").alias("yhat"))


def future_grid(df: DataFrame, spec: SeriesSpec, h: int) -> DataFrame:
    """The next ``h`` grid timestamps of every series."""
    return over_steps(df.groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST)), spec, h, F.lit(0.0)).drop("yhat")


#: Spark cuts a rank filter to its rows before the shuffle up to this rank.
RANK_LIMIT = 1000


def newest_rows(df: DataFrame, spec: SeriesSpec, k: int, extra: list[str] | None = None) -> DataFrame:
    """The last ``k`` known rows of each series, with ``__r`` counting from 1 at the last.

    Up to ``RANK_LIMIT`` a rank filter leaves at most k rows per series and task before the shuffle; beyond, Spark would send
    whole series to a task, so exact positions are used, which cut up long series.
    """
    rows = known_rows(df, spec, extra)
    if k <= RANK_LIMIT:
        newest = Window.partitionBy(*[F.col(c) for c in spec.keys] or [F.lit(0)]).orderBy(*[F.desc(c) for c in spec.order])
        return rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= k)
    placed = with_positions(rows, spec, AT, LEN).withColumn("__r", (F.col(LEN) - F.col(AT)).cast("int"))
    return placed.where(F.col("__r") <= k).drop(AT, LEN)


def _last_value(spec: SeriesSpec) -> Column:
    return F.max_by(spec.target, F.struct(*spec.order))


def naive(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """The last observation."""
    one = known_rows(df, spec).groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST), _last_value(spec).alias("v"))
    return over_steps(one, spec, h, F.col("v"))


def seasonal_naive(df: DataFrame, spec: SeriesSpec, h: int, season: int = 7) -> DataFrame:
    """The last observation of the same phase; the last one of all where the series has no such phase."""
    tail = newest_rows(df, spec, season)
    one = tail.groupBy(*spec.keys).agg(
        F.max(spec.ts).alias(LAST), F.map_from_entries(F.collect_list(F.struct("__r", spec.target))).alias("m")
    )
    phase = F.lit(season) - F.pmod(F.col("step") - 1, F.lit(season))
    return over_steps(one, spec, h, F.coalesce(F.try_element_at("m", phase), F.try_element_at("m", F.lit(1))))


def average(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """The mean of the history."""
    one = known_rows(df, spec).groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST), F.avg(spec.target).alias("v"))
    return over_steps(one, spec, h, F.col("v"))


def seasonal_average(df: DataFrame, spec: SeriesSpec, h: int, season: int = 7) -> DataFrame:
    """The mean of the same phase; the overall mean where the series has no such phase."""
    rows = with_positions(known_rows(df, spec), spec, AT, LEN)
    phase = (F.col(LEN) - 1 - F.col(AT)) % season
    sums = rows.groupBy(*spec.keys, phase.cast("int").alias("__p")).agg(
        F.sum(spec.target).alias("s"), F.count(F.lit(1)).alias("c"), F.max(spec.ts).alias("l")
    )
    one = sums.groupBy(*spec.keys).agg(
        F.max("l").alias(LAST), (F.sum("s") / F.sum("c")).alias("v"),
        F.map_from_entries(F.collect_list(F.struct(F.col("__p"), F.col("s") / F.col("c")))).alias("m"),
    )
    return over_steps(one, spec, h, F.coalesce(F.try_element_at("m", F.pmod(-F.col("step"), F.lit(season))), F.col("v")))


def zero(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """Zero."""
    one = known_rows(df, spec).groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST))
    return over_steps(one, spec, h, F.lit(0.0))


def line_of(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Least-squares line of each series on its row position: ``slope``, ``intercept``, ``LEN``, ``LAST``.

    A series of one row has slope 0.
    """
    y, t = spec.target, F.col(AT).cast("double")
    rows = with_positions(known_rows(df, spec), spec, AT)
    one = rows.groupBy(*spec.keys).agg(
        F.max(spec.ts).alias(LAST), F.count(F.lit(1)).alias(LEN), F.avg(y).alias("__my"), F.avg(t).alias("__mt"), F.regr_slope(F.col(y), t).alias("__b")
    )
    slope = F.when(F.col(LEN) > 1, F.col("__b")).otherwise(0.0)
    return one.withColumn("slope", slope).withColumn("intercept", F.col("__my") - F.col("slope") * F.col("__mt")).drop("__my", "__mt", "__b")


def polytrend(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """The least-squares line, continued."""
    return over_steps(line_of(df, spec), spec, h, F.col("intercept") + F.col("slope") * (F.col(LEN) - 1 + F.col("step")))


def _recency(df: DataFrame, spec: SeriesSpec, decay: float) -> DataFrame:
    rows = with_positions(known_rows(df, spec), spec, AT, LEN)
    age = (F.col(LEN) - 1 - F.col(AT)) / F.col(LEN)
    return rows.withColumn("__w", F.exp(-age * F.lit(float(decay))))


def npts(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1, decay: float = 1.0) -> DataFrame:
    """Mean of past values weighted by recency: ``exp(-decay * age / length)``."""
    rows = _recency(df, spec, decay)
    one = rows.groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST), (F.sum(F.col("__w") * F.col(spec.target)) / F.sum("__w")).alias("v"))
    return over_steps(one, spec, h, F.col("v"))


def npts_quantiles(df: DataFrame, spec: SeriesSpec, levels: list[float], decay: float = 1.0) -> DataFrame:
    """Per series the weighted quantiles of the history: the least value whose cumulative share of weight
    reaches the level. Columns are named by level."""
    rows = _recency(df, spec, decay).groupBy(*spec.keys, spec.target).agg(F.sum("__w").alias("__w"))
    by_value = SeriesSpec(id=None, by=tuple(spec.keys), ts=spec.target, longest=spec.longest)
    along = running_sums(rows, by_value, ["__w"])
    totals = rows.groupBy(*spec.keys).agg(F.sum("__w").alias("__total"))
    share = F.col("__w_cum") / F.col("__total") + F.lit(1e-9)
    return join_stats(along, totals, spec.keys).groupBy(*spec.keys).agg(
        *[F.min(F.when(share >= q, F.col(spec.target))).alias(str(q)) for q in levels]
    )
