"""Calendar, lag, rolling and target-transformation features."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.functions.numeric import box_cox, inverse_box_cox, inverse_yeo_johnson, yeo_johnson
from tidegrid.operators.series import safe_timestamp
from tidegrid.spec import SeriesSpec
from tidegrid.splits import over_series


def add_holiday(df: DataFrame, ts: str, name: str = "russian_holiday", calendar: DataFrame | None = None) -> DataFrame:
    """1.0 on a Russian public holiday, else 0.0 (also for a NULL date). A missing ``ts`` returns the input.

    The fixed dates repeat every year and need no join. ``calendar`` adds days that are announced year by
    year: a table with a ``holiday`` date column, one row per day of the calendar.
    """
    if ts not in df.columns:
        return df
    df = safe_timestamp(df, ts)
    flag = F.coalesce(cal.is_fixed_holiday(F.col(ts)), F.lit(False))
    if calendar is None:
        return df.withColumn(name, flag.cast("double"))
    days = calendar.select(F.to_date("holiday").alias("__day")).where(F.col("__day").isNotNull()).distinct()
    marked = df.join(F.broadcast(days), F.to_date(df[ts]) == days["__day"], "left")  # bounded by the calendar
    return marked.withColumn(name, (flag | F.col("__day").isNotNull()).cast("double")).drop("__day")


def add_time_features(df: DataFrame, ts: str, features: list[str] | None = None) -> DataFrame:
    """Add calendar features by name (``calendar.TIME_FEATURES``); a missing ``ts`` returns the input."""
    if ts not in df.columns:
        return df
    wanted = set(cal.DEFAULT_TIME_FEATURES if features is None else features)
    df = safe_timestamp(df, ts)
    return df.withColumns({n: make(F.col(ts)) for n, make in cal.TIME_FEATURES.items() if n in wanted})


def add_lags(df: DataFrame, spec: SeriesSpec, lags: tuple[int, ...] = (1, 7, 14, 28)) -> DataFrame:
    """``<target>_lag_k``: the target k rows earlier in the series."""
    y = spec.target
    return over_series(df, spec, {f"{y}_lag_{k}": _lag(y, k) for k in lags}, before=max(lags))


def _lag(y: str, k: int):
    return lambda w: F.lag(y, k).over(w)


_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _rolling(y: str, rows: int, name: str):
    return lambda w: _ROLLING[name](y).over(w.rowsBetween(-(rows - 1), 0))


def add_rolling(
    df: DataFrame,
    spec: SeriesSpec,
    windows: tuple[int, ...] = (7, 14, 30),
    functions: tuple[str, ...] = ("mean", "std", "min", "max"),
) -> DataFrame:
    """``<target>_rolling_<rows>_<function>`` over the current and the preceding rows; NULL targets do not
    count. Functions other than mean, std, min and max are skipped."""
    y = spec.target
    cols = {f"{y}_rolling_{n}_{f}": _rolling(y, n, f) for n in windows for f in functions if f in _ROLLING}
    return over_series(df, spec, cols, before=max(windows) - 1)


# --- transformations of the target --------------------------------------------------------------------------


@dataclass(frozen=True)
class TransformParams:
    """What the inverse of a transformation needs to know."""

    kind: str
    lam: float | None = None
    shift: float = 0.0


def transform_target(df: DataFrame, col: str, kind: str, lam: float | None = None) -> tuple[DataFrame, TransformParams]:
    """Transform ``col`` by ``log`` (log1p), ``sqrt``, ``box-cox`` or ``yeo-johnson``.

    Lambda is fitted by maximum likelihood unless given. Box-Cox shifts data with values <= 0 by
    ``|min| + 1``. Impossible values (log of a number <= -1, square root of a negative one) become NULL.
    """
    x = F.col(col).cast("double")
    if kind == "log":
        return df.withColumn(col, F.when(x > -1, F.log1p(x))), TransformParams(kind)
    if kind == "sqrt":
        return df.withColumn(col, F.when(x >= 0, F.sqrt(x))), TransformParams(kind)
    if kind == "box-cox":
        low = df.agg(F.min(x)).first()[0]
        shift = abs(low) + 1.0 if low is not None and low <= 0 else 0.0
        moved = x + F.lit(shift)
        lam = _fit_lambda(df, moved, box_cox, F.sum(F.ln(moved))) if lam is None else lam
        return df.withColumn(col, box_cox(moved, lam)), TransformParams(kind, lam, shift)
    if kind == "yeo-johnson":
        log_sum = F.sum(F.signum(x) * F.log1p(F.abs(x)))
        lam = _fit_lambda(df, x, yeo_johnson, log_sum) if lam is None else lam
        return df.withColumn(col, yeo_johnson(x, lam)), TransformParams(kind, lam)
    return df, TransformParams("none")


def inverse_target(df: DataFrame, col: str, params: TransformParams) -> DataFrame:
    """Undo ``transform_target``."""
    z = F.col(col).cast("double")
    if params.kind in ("box-cox", "yeo-johnson") and params.lam is None:
        raise ValueError(f"the inverse of {params.kind} needs its lambda")
    if params.kind == "log":
        return df.withColumn(col, F.expm1(z))
    if params.kind == "sqrt":
        return df.withColumn(col, z * z)
    if params.kind == "box-cox":
        return df.withColumn(col, inverse_box_cox(z, params.lam) - F.lit(params.shift))
    if params.kind == "yeo-johnson":
        return df.withColumn(col, inverse_yeo_johnson(z, params.lam))
    return df


def _fit_lambda(df: DataFrame, x: Column, transform, log_sum: Column, low: float = -2.0, high: float = 2.0) -> float:
    """Lambda of the greatest profile likelihood. The likelihood of a whole grid of lambdas is one aggregate
    (a variance per lambda); the grid closes in on its best point. A best point at the edge moves the grid."""
    points = 33
    best = 1.0
    for _ in range(40):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        row = df.agg(F.count(x).alias("n"), log_sum.alias("s"), *[F.var_pop(transform(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        if not row["n"]:
            return 1.0
        likelihood = [
            (g - 1) * row["s"] - row["n"] / 2 * math.log(row[f"v{i}"]) if row[f"v{i}"] and math.isfinite(row[f"v{i}"]) else -math.inf
            for i, g in enumerate(grid)
        ]
        at = max(range(points), key=likelihood.__getitem__)
        best, step = grid[at], (high - low) / (points - 1)
        if at in (0, points - 1) and abs(best) >= 64:
            raise ArithmeticError("the likelihood grows without end; the column has no Box-Cox or Yeo-Johnson lambda")
        if at in (0, points - 1):
            low, high = best - (high - low) / 2, best + (high - low) / 2
            continue
        if step < 1e-6:
            return best
        low, high = best - step, best + step
    raise ArithmeticError("the search for lambda has not converged")
