"""Seasonal patterns, autocorrelation, period detection and decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.grid import _STEP_MICROS
from tidegrid.operators.quality import time_steps
from tidegrid.operators.series import safe_timestamp, top_series
from tidegrid.quantiles import quantiles
from tidegrid.spec import SeriesSpec
from tidegrid.splits import measured, null_safe, over_series, with_group_stats, with_positions

# Weekday names of the report, Monday first.
WEEKDAYS = ("Понедельник", "Вторник", "Среда", "Четверг", "Пятница", "Суббота", "Воскресенье")


def seasonal_patterns(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean, median and std of the target by month, weekday and quarter: rows ``(kind, key, ...)``."""
    df = safe_timestamp(df, spec.ts)
    ts, y = F.col(spec.ts), spec.target

    def entry(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))

    names = F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS]), F.weekday(ts) + 1)
    keys = F.array(entry("month", F.month(ts)), entry("weekday", names), entry("quarter", F.quarter(ts)))
    rows = df.where(ts.isNotNull()).select(F.explode(keys).alias("k"), F.col(y).alias("v")).select("k.kind", "k.key", "v")
    return quantiles(rows, ["kind", "key"], "v", {"median": 0.5}, {"mean": F.avg("v"), "std": F.stddev_samp("v")})


def _lag_products(df: DataFrame, spec: SeriesSpec, max_lag: int) -> DataFrame:
    """Per series: ``n`` and the array of sums of centred products at lags 0 to ``max_lag``."""
    y = spec.target
    rows = df.where(F.col(y).isNotNull())
    spec = measured(rows, spec)
    rows = with_group_stats(rows, spec, {"__mean": F.avg(y)}).withColumn("__c", F.col(y) - F.col("__mean"))
    rows = over_series(rows, spec, {f"__l{k}": _lagged(k) for k in range(1, max_lag + 1)}, before=max_lag)
    c = F.col("__c")
    sums = [F.sum(c * c)] + [F.coalesce(F.sum(c * F.col(f"__l{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)]
    return rows.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).select(
        *spec.keys, "n", F.array(*[f"s{k}" for k in range(max_lag + 1)]).alias("products")
    )


def _lagged(k: int):
    return lambda w: F.lag("__c", k).over(w)


def _longest(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    top = top_series(df, spec, 1)
    return df.join(F.broadcast(top), null_safe(df, top, [spec.id]), "left_semi")  # top is one row


def acf(df: DataFrame, spec: SeriesSpec, max_lag: int = 30, longest_only: bool = False) -> DataFrame:
    """Biased autocorrelation at lags 0 to ``min(max_lag, n - 1)``, for every series or the longest one."""
    products = _lag_products(_longest(df, spec) if longest_only else df, spec, max_lag)
    rows = products.select(*spec.keys, "n", F.col("products")[0].alias("__total"), F.posexplode("products").alias("lag", "__s"))
    return rows.where(F.col("lag") < F.col("n")).select(*spec.keys, "lag", F.try_divide(F.col("__s"), F.col("__total")).alias("acf"))


def pacf(df: DataFrame, spec: SeriesSpec, max_lag: int = 30, longest_only: bool = False) -> DataFrame:
    """Partial autocorrelation (Yule-Walker on autocovariances divided by n - k), lags below half the length.

    Only the lag products, one short array per series, reach the recursion."""
    products = _lag_products(_longest(df, spec) if longest_only else df, spec, max_lag)
    values = products.withColumn("p", _partial("n", "products"))
    return values.select(*spec.keys, F.posexplode("p").alias("lag", "pacf"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _partial(n: pd.Series, products: pd.Series) -> pd.Series:
    """Durbin-Levinson recursion on each row's autocovariances."""
    out = []
    for rows, sums in zip(n, products):
        lags = max(min(len(sums) - 1, rows // 2 - 1), 0)
        cov = np.asarray(sums[: lags + 1], float) / (rows - np.arange(lags + 1))
        partial, phi, err = [1.0], np.zeros(0), cov[0]
        for k in range(1, lags + 1):
            if err == 0:
                break
            last = (cov[k] - phi @ cov[k - 1 : 0 : -1]) / err
            phi = np.append(phi - last * phi[::-1], last)
            err *= 1 - last * last
            partial.append(float(last))
        out.append(partial)
    return pd.Series(out)


def detect_period(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series the usual step in whole days and the season it suggests: 7 for days, 52 for weeks, 12 for
    months and anything else."""
    usual = time_steps(df, spec).groupBy(*spec.keys).agg(F.max(F.struct(F.col("n"), -F.col("step"))).alias("m"))
    days = F.floor(-F.col("m.col2") / _STEP_MICROS["D"])
    period = F.when(F.col("step_days") == 1, 7).when(F.col("step_days") == 7, 52).otherwise(12)
    return usual.select(*spec.keys, days.alias("step_days")).withColumn("period", period)


def decompose(df: DataFrame, spec: SeriesSpec, period: int) -> DataFrame:
    """Classical additive decomposition of every series of at least two periods.

    ``trend`` is the centred moving average over one period (for an even period the two outer points count
    half), ``seasonal`` the mean detrended value of the phase, centred, ``resid`` the rest. Trend and residual
    are NULL for half a period at both ends.
    """
    y, half = spec.target, period // 2
    spec = measured(df, spec)
    rows = with_positions(df, spec, "__at", "__len").where(F.col("__len") >= 2 * period)

    def frame(w):
        return w.rowsBetween(-half, half)

    cols = {"__sum": lambda w: F.sum(y).over(frame(w)), "__cnt": lambda w: F.count(y).over(frame(w))}
    if period % 2 == 0:
        cols |= {"__a": lambda w: F.lag(y, half).over(w), "__z": lambda w: F.lead(y, half).over(w)}
    rows = over_series(rows, spec, cols, before=half, after=half)
    total = F.col("__sum") - (F.col("__a") + F.col("__z")) * 0.5 if period % 2 == 0 else F.col("__sum")
    rows = rows.withColumn("trend", F.when(F.col("__cnt") == 2 * half + 1, total / period)).withColumn("__phase", F.col("__at") % period)
    detrended = F.col(y) - F.col("trend")
    rows = with_group_stats(rows, spec.replace(by=(*spec.by, "__phase")), {"__pm": F.avg(detrended)})
    rows = with_group_stats(rows, spec, {"__mm": F.avg(F.when(F.col("__at") < period, F.col("__pm")))})
    seasonal = F.col("__pm") - F.col("__mm")
    return rows.select(
        *spec.keys, spec.ts, F.col(y).alias("observed"), "trend", seasonal.alias("seasonal"), (F.col(y) - F.col("trend") - seasonal).alias("resid")
    )


def too_short(df: DataFrame, spec: SeriesSpec, period: int) -> DataFrame:
    """Series that cannot be decomposed, with their rows and the rows needed."""
    n = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") < 2 * period).withColumn("needed", F.lit(2 * period))


def seasonal_strength(parts: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``1 - var(resid) / var(observed - trend)`` per series, and its class: strong > 0.6, moderate > 0.3, weak."""
    inner = parts.where(F.col("trend").isNotNull())
    ratio = F.try_divide(F.var_pop("resid"), F.var_pop(F.col("observed") - F.col("trend")))
    strength = inner.groupBy(*spec.keys).agg((1 - ratio).alias("strength"))
    level = F.when(F.col("strength") > 0.6, "strong").when(F.col("strength") > 0.3, "moderate").otherwise("weak")
    return strength.withColumn("level", level)
