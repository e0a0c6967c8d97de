"""Backtests of whole menus from one reading of the history.

The history of every fold is a prefix of the same series, so a row need not be copied to the folds that it trains. Rows are given their position
and the newest fold they train (``UPTO``) once. Sums and newest values are then conditional aggregates, one for each fold side by side;
seasonal values are aggregates by phase; exponential smoothing runs once along a series and keeps its state at every fold's edge.

Models without such a form (the regressions, STLF, ADIDA, IMAPA, users' own) get the copied rows of ``selection.folds_of``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.models import baseline, smoothing
from tidegrid.models.baseline import AT, LEN, known_rows
from tidegrid.models.smoothing import ALPHAS, HOLT_GRID, HW_GRID, SEG, smooth_folds
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, over_series, with_positions

#: The newest fold (the smallest number is the newest) that a row trains; -1 for the rows that fold 0 holds out.
UPTO, BACK = "__upto", "__back"


def placed_rows(df: DataFrame, spec: SeriesSpec, h: int, folds: int, extra: list[str] | None = None) -> DataFrame:
    """Known rows with position, length, rows to the end (``BACK``, 1 at the last) and ``UPTO``: a row trains the folds 0 to ``UPTO``."""
    rows = with_positions(known_rows(df, spec, extra), spec, AT, LEN).withColumn(BACK, F.col(LEN) - F.col(AT))
    return rows.withColumn(UPTO, F.least(F.floor((F.col(BACK) - 1) / h) - 1, F.lit(folds - 1)).cast("int"))


def held_rows(placed: DataFrame, spec: SeriesSpec, h: int, folds: int) -> DataFrame:
    """The rows that a fold holds out, with ``fold`` and ``step``."""
    held = placed.where(F.col(BACK) <= h * folds).withColumn("fold", F.floor((F.col(BACK) - 1) / h).cast("int"))
    return held.withColumn("step", ((F.col("fold") + 1) * h - F.col(BACK) + 1).cast("int"))


def _over_steps(per_fold: DataFrame, keys: list[str], h: int, yhat: dict[str, Column]) -> DataFrame:
    """``(model, fold, keys, step, yhat)`` of one row per fold and series; ``yhat`` may use ``step``."""
    steps = per_fold.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), e.cast("double").alias("yhat")) for m, e in yhat.items()])).alias("__m")
    return steps.select("fold", *keys, "step", each).select("__m.model", "fold", *keys, "step", "__m.yhat")


@dataclass(frozen=True)
class Sums:
    """A model made of aggregates over a fold's history. ``parts`` gets the target and the position, NULL outside the history, and the history's
    length; ``yhat`` gets the parts."""

    parts: Callable[[Column, Column, Column], dict[str, Column]]
    yhat: Callable[[Column], Column]


def _line(y: Column, at: Column, n: Column) -> dict[str, Column]:
    return {"mean": F.avg(y), "slope": F.regr_slope(y, at)}


def _slope(p: Column) -> Column:
    return F.when(F.col(LEN) > 1, p["slope"]).otherwise(0.0)


def _recent(y: Column, at: Column, n: Column) -> dict[str, Column]:
    weight = F.when(at.isNotNull(), F.exp(-(n - 1 - at) / n))
    return {"weighted": F.sum(weight * y), "weights": F.sum(weight)}


SUMS: dict[Callable, Sums] = {
    baseline.naive: Sums(lambda y, at, n: {"last": F.max_by(y, at)}, lambda p: p["last"]),
    baseline.average: Sums(lambda y, at, n: {"mean": F.avg(y)}, lambda p: p["mean"]),
    baseline.zero: Sums(lambda y, at, n: {}, lambda p: F.lit(0.0)),
    baseline.polytrend: Sums(_line, lambda p: p["mean"] + _slope(p) * ((F.col(LEN) - 1) / 2 + F.col("step"))),
    baseline.npts: Sums(_recent, lambda p: p["weighted"] / p["weights"]),
}


def summed(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int, more: dict[str, Sums]) -> DataFrame:
    """``(fold, keys, LEN, scale_abs, scale_sq, __p_<model>)`` per fold with a history: the parts of the models ``more``, and the mean absolute and
    squared error of the seasonal-naive forecast inside the history. One aggregate over the rows gives all of it."""
    y = F.col(spec.target)
    rows = over_series(placed, spec, {"__before": lambda w: F.lag(y, season).over(w)}, before=season)
    e = y - F.col("__before")

    def at_fold(f: int) -> Column:
        inside = F.col(UPTO) >= f
        parts = {
            name: model.parts(F.when(inside, y), F.when(inside, F.col(AT).cast("double")), (F.col(LEN) - (f + 1) * h).cast("double"))
            for name, model in more.items()
        }
        return F.struct(
            F.lit(f).alias("fold"), (F.max(LEN) - (f + 1) * h).alias(LEN),
            F.avg(F.when(inside, F.abs(e))).alias("scale_abs"), F.avg(F.when(inside, e * e)).alias("scale_sq"),
            *[F.struct(*[c.alias(n) for n, c in p.items()]).alias(f"__p_{name}") for name, p in parts.items() if p],
        )

    one = rows.groupBy(*spec.keys).agg(F.array(*[at_fold(f) for f in range(folds)]).alias("__folds"))
    return one.select(*spec.keys, F.explode("__folds").alias("__f")).select(*spec.keys, "__f.*").where(F.col(LEN) > 0)


def _seasonal_naive(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int) -> DataFrame:
    """A row counts for the folds whose edge is at most a season after it."""
    last = F.floor((F.col(BACK) - 1) / h) - 1
    first = F.greatest(F.ceil((F.col(BACK) - season) / h) - 1, F.lit(0))
    near = placed.where((F.col(BACK) > h) & (F.col(BACK) <= folds * h + season))
    near = near.withColumn("__to", F.least(last, F.lit(folds - 1))).withColumn("__from", first).where(F.col("__from") <= F.col("__to"))
    near = near.withColumn("fold", F.explode(F.sequence(F.col("__from").cast("int"), F.col("__to").cast("int"))))
    before = (F.col(BACK) - (F.col("fold") + 1) * h).cast("int")
    one = near.groupBy("fold", *spec.keys).agg(F.map_from_entries(F.collect_list(F.struct(before, spec.target))).alias("m"))
    phase = F.lit(season) - F.pmod(F.col("step") - 1, F.lit(season))
    return _over_steps(one, spec.keys, h, {"seasonal_naive": F.coalesce(F.try_element_at("m", phase), F.try_element_at("m", F.lit(1)))})


def _seasonal_average(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int) -> DataFrame:
    y = F.col(spec.target)
    sums = [F.struct(F.sum(F.when(F.col(UPTO) >= f, y)).alias("s"), F.count(F.when(F.col(UPTO) >= f, y)).alias("c")) for f in range(folds)]
    phases = placed.groupBy(*spec.keys, (F.col(AT) % season).alias("__at")).agg(F.max(LEN).alias(LEN), F.array(*sums).alias("__s"))
    each = phases.select(*spec.keys, "__at", LEN, F.posexplode("__s").alias("fold", "__v")).where("__v.c > 0")
    phase = F.pmod(F.col(LEN) - (F.col("fold") + 1) * h - 1 - F.col("__at"), F.lit(season)).cast("int")
    one = each.groupBy("fold", *spec.keys).agg(
        (F.sum("__v.s") / F.sum("__v.c")).alias("v"), F.map_from_entries(F.collect_list(F.struct(phase, F.col("__v.s") / F.col("__v.c")))).alias("m")
    )
    return _over_steps(one, spec.keys, h, {"seasonal_average": F.coalesce(F.try_element_at("m", F.pmod(-F.col("step"), F.lit(season))), F.col("v"))})


def _history(placed: DataFrame, folds: int) -> DataFrame:
    return placed.where(F.col(UPTO) >= 0).withColumn(SEG, F.lit(folds - 1) - F.col(UPTO))


def _level() -> Column:
    return F.col("state")[0]


def _trend() -> Column:
    """A history of one row has no trend; its first difference would be with a row that is held out."""
    return F.when(F.col(LEN) > 1, F.col("state")[1]).otherwise(0.0)


def _ses(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int) -> DataFrame:
    return _over_steps(smooth_folds(_history(placed, folds), spec, ALPHAS, None, h, folds), spec.keys, h, {"ses": _level()})


def _holt(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int) -> DataFrame:
    fits = smooth_folds(_history(placed, folds), spec, HOLT_GRID, 0, h, folds)
    return _over_steps(fits, spec.keys, h, {"holt": _level() + _trend() * F.col("step")})


def _theta(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int) -> DataFrame:
    fits = smooth_folds(_history(placed, folds), spec, ALPHAS, None, h, folds)
    lines = summed(placed, spec, h, folds, 1, {"line": SUMS[baseline.polytrend]}).select("fold", *spec.keys, F.col("__p_line").alias("__line"))
    both = join_stats(fits, lines, ["fold", *spec.keys])
    a, n = F.element_at(F.array(*[F.lit(a) for a in ALPHAS]), F.col("best") + 1), F.col(LEN)
    drift = _slope(F.col("__line")) / 2 * (F.col("step") - 1 + (1 - F.pow(1 - a, n)) / a)
    return _over_steps(both, spec.keys, h, {"theta": _level() + drift})


def _holt_winters(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int) -> DataFrame:
    rows = _history(placed, folds)
    fits = smooth_folds(rows, spec, HW_GRID, season, h, folds)
    phase = F.try_element_at("state", (F.lit(3) + (F.col("step") - 1) % season).cast("int"))
    full = _over_steps(fits, spec.keys, h, {"holt_winters": F.col("state")[0] + F.col("state")[1] * F.col("step") + F.coalesce(phase, F.lit(0.0))})
    # Histories shorter than two seasons are smoothed by Holt with the same first parameters.
    pairs = tuple((p[0], p[1]) for p in HW_GRID)
    few = smooth_folds(rows.where(F.col(LEN) < 2 * season + folds * h), spec, pairs, 0, h, folds).where(F.col(LEN) < 2 * season)
    return full.unionByName(_over_steps(few, spec.keys, h, {"holt_winters": _level() + _trend() * F.col("step")}))


def _croston(placed: DataFrame, spec: SeriesSpec, h: int, folds: int, season: int, alpha: float = 0.1) -> DataFrame:
    """With a fixed alpha a smoothed level is a weighted sum; the weights of a fold count back from its own newest demand."""
    rows = placed.where(F.col(spec.target) != 0)
    beside = {"__gap_from": lambda w: F.lag(AT).over(w)}
    rows = over_series(with_positions(rows, spec, "__i", "__d"), spec, beside, before=1)
    gap = (F.col(AT) - F.coalesce(F.col("__gap_from"), F.lit(-1))).cast("double")
    first = F.when(F.col("__i") == 0, 1.0).otherwise(alpha)
    sums = []
    for f in range(folds):
        inside = F.col(UPTO) >= f
        weight = F.when(inside, first * F.pow(F.lit(1 - alpha), F.col(f"__newest_{f}") - F.col("__i")))
        sums.append(F.struct(F.sum(weight * F.col(spec.target)).alias("size"), F.sum(weight * gap).alias("gap")))
    newest = rows.groupBy(*spec.keys).agg(*[F.max(F.when(F.col(UPTO) >= f, F.col("__i"))).alias(f"__newest_{f}") for f in range(folds)])
    levels = join_stats(rows, newest, spec.keys).groupBy(*spec.keys).agg(F.array(*sums).alias("__s"))
    lengths = placed.groupBy(*spec.keys).agg(F.max(LEN).alias(LEN))
    one = join_stats(lengths, levels, spec.keys).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    one = one.where(F.col(LEN) > (F.col("fold") + 1) * h).withColumn("__v", F.col("__s")[F.col("fold")])
    return _over_steps(one, spec.keys, h, {"croston": F.coalesce(F.try_divide("__v.size", "__v.gap"), F.lit(0.0))})


#: Models with a form for all folds at once, besides ``SUMS``.
RUNS: dict[Callable, Callable] = {
    baseline.seasonal_naive: _seasonal_naive, baseline.seasonal_average: _seasonal_average,
    smoothing.ses: _ses, smoothing.holt: _holt, smoothing.theta: _theta, smoothing.holt_winters: _holt_winters,
    smoothing.croston: _croston,
}


def forecasts(
    placed: DataFrame, spec: SeriesSpec, models: dict[str, Callable], h: int, folds: int, season: int
) -> tuple[DataFrame | None, DataFrame, dict[str, Callable]]:
    """(forecasts ``(model, fold, keys, step, yhat)``, scales per fold, the models that need copied rows)."""
    sums = {m: SUMS[f] for m, f in models.items() if f in SUMS}
    runs = {m: RUNS[f] for m, f in models.items() if f in RUNS}
    per_fold = summed(placed, spec, h, folds, season, sums)
    out = [_over_steps(per_fold, spec.keys, h, {m: s.yhat(F.col(f"`__p_{m}`")) for m, s in sums.items()})] if sums else []
    out += [run(placed, spec, h, folds, season).withColumn("model", F.lit(m)) for m, run in runs.items()]
    scales = per_fold.select("fold", *spec.keys, "scale_abs", "scale_sq")
    done = reduce(lambda a, b: a.unionByName(b), out) if out else None
    return done, scales, {m: f for m, f in models.items() if m not in sums and m not in runs}
