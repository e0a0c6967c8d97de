"""Exponential smoothing: simple, Holt, Holt-Winters (additive), and the models built on them.

Parameters are chosen per series from a grid by the sum of squared one-step errors. Simple and Holt smoothing
of ordinary series run inside the JVM as a fold over the series' array. Smoothing is a linear recursion
``x' = A x + g y`` with error ``y - c x``, so a *block* of rows acts on the state as one affine map and on the
error sum as one quadratic form. Series too long for one task are therefore cut into blocks that are
summarised in parallel; neighbouring summaries are joined in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.models.baseline import AT, LAST, LEN, known_rows, line_of, over_steps
from tidegrid.operators.seasonal import decompose
from tidegrid.spec import SeriesSpec
from tidegrid.splits import BLOCK, POS, hot_groups, join_stats, measured, over_series, parted, rows_per_task, split, with_positions

# The parameter grids.
ALPHAS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
HOLT_GRID = tuple(product((0.1, 0.3, 0.5, 0.7, 0.9), (0.1, 0.3, 0.5, 0.7, 0.9)))
HW_GRID = tuple(product((0.1, 0.3, 0.5, 0.7, 0.9), (0.1, 0.3, 0.5), (0.1, 0.3, 0.5)))
INTERMITTENT_ALPHAS = (0.1, 0.2, 0.3)

#: A stretch of a series between two folds' edges.
SEG = "__seg"
#: Values of one series that are held as one array.
ARRAY_ROWS = 500_000


# --- the linear recursion -----------------------------------------------------------------------------------


def _gains(grid: tuple, season: int | None) -> tuple[np.ndarray, ...]:
    """What an error of one moves level, trend and phase by, for every parameter set."""
    sets = np.array([p if isinstance(p, tuple) else (p,) for p in grid], float)
    none = np.zeros(len(grid))
    trend = none if season is None else sets[:, 0] * sets[:, 1]
    return sets[:, 0], trend, sets[:, 2] if season else none


def _start(y: np.ndarray, season: int | None) -> tuple[np.ndarray, int]:
    """State (level[, trend[, season phases, next one first]]) before the first row that is smoothed, and that row's position."""
    if season is None:
        return y[:1], 1
    if season == 0:
        return np.array([y[0], y[1] - y[0] if len(y) > 1 else 0.0]), 1
    first, second = y[:season].mean(), y[season : 2 * season].mean()
    slope = (second - first) / season
    centre = (season - 1) / 2
    phases = y[:season] - (first + slope * (np.arange(season) - centre))
    return np.concatenate([[first + slope * centre, slope], phases]), season


def _run_many(series: list[np.ndarray], grid: tuple, season: int | None) -> list[tuple[int, np.ndarray, float]]:
    """Smooth whole series; (best set, its final state, its error sum) of each."""
    return [fits[0] for fits in _run_stops(series, grid, season, [[len(y)] for y in series])]


def _run_stops(series: list[np.ndarray], grid: tuple, season: int | None, stops: list[list[int]]) -> list[list[tuple[int, np.ndarray, float]]]:
    """Smooth series, all of them and under every parameter set at once; for each and every stop of it (a number of values) the
    best set up to there, its state and its error sum.

    The state is one array per part of it, series by parameter sets, and a ring of phases: a value costs the same at any season.
    """
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))  # those that go on are always the first
    starts = [_start(series[i], season) for i in order]
    at = 1 if not season else season
    lengths = np.array([len(series[i]) - at for i in order])
    most = max(int(lengths.max(initial=0)), 0)
    values = np.zeros((most, len(order)))
    for k, i in enumerate(order):
        values[: max(lengths[k], 0), k] = series[i][at:]
    going = np.searchsorted(-lengths, -np.arange(most))  # series longer than t
    a, b, g = _gains(grid, season)
    level = np.repeat([[x[0]] for x, _ in starts], len(grid), 1)
    trend = np.repeat([[x[1] if season is not None else 0.0] for x, _ in starts], len(grid), 1)
    ring = [np.repeat([[x[2 + p]] for x, _ in starts], len(grid), 1) for p in range(season or 0)]
    sse = np.zeros_like(level)
    out: list = [[None] * len(x) for x in stops]
    due: dict[int, list[tuple[int, int, int]]] = {}
    for k, i in enumerate(order):
        for j, stop in enumerate(stops[i]):
            due.setdefault(max(stop - at, 0), []).append((k, i, j))

    def note(t: int) -> None:
        for k, i, j in due.get(t, ()):
            p = np.argmin(np.round(sse[k], 9))
            state = [level[k, p]] + ([trend[k, p]] if season is not None else [])
            state += [ring[(t + q) % season][k, p] for q in range(season or 0)]
            out[i][j] = (int(p), np.array(state), float(sse[k, p]))

    note(0)
    for t in range(most):
        n = going[t]
        ahead = level[:n] + trend[:n] if season is not None else level[:n].copy()
        phase = ring[t % season][:n] if season else 0.0
        e = values[t, :n, None] - ahead - phase
        sse[:n] += e * e
        level[:n] = ahead + a * e
        if season is not None:
            trend[:n] += b * e
        if season:
            phase += g * e
        note(t + 1)
    return out


def _run(y: np.ndarray, grid: tuple, season: int | None) -> tuple[int, np.ndarray, float]:
    """Smooth one whole series."""
    return _run_many([y], grid, season)[0]


#: Errors whose products are summed at once.
_ERRORS = 256


def _summary(y: np.ndarray, grid: tuple, season: int | None) -> tuple[np.ndarray, ...]:
    """What a block does: x' = M x + v, and its error sum q + b.x + x'Cx, for every parameter set.

    The recursion runs once from every unit state without values and once from zero with them, as columns of one array; errors
    are linear in the state, so the error sum is their product with themselves.
    """
    a, b, g = (x[:, None] for x in _gains(grid, season))
    size = 1 + (season is not None) + (season or 0)
    unit = np.eye(size + 1)[:size]  # a row per part of the state, a column per start; the last column is the one with values
    parts = [np.tile(row, (len(grid), 1)) for row in unit]
    value = np.zeros((len(grid), size + 1))
    total = np.zeros((len(grid), size + 1, size + 1))
    errors: list[np.ndarray] = []
    trend = season is not None

    def add() -> None:
        e = np.stack(errors, 1)  # sets, steps, columns
        total[:] += e.transpose(0, 2, 1) @ e
        errors.clear()

    for t, v in enumerate(y):
        value[:, -1] = v
        ahead = parts[0] + parts[1] if trend else parts[0]
        at = 2 + t % season if season else 0
        e = value - ahead - parts[at] if season else value - ahead
        errors.append(e)
        if len(errors) == _ERRORS:
            add()
        parts[0] = ahead + a * e
        if trend:
            parts[1] = parts[1] + b * e
        if season:
            parts[at] = parts[at] + g * e
    if errors:
        add()
    turn = len(y) % season if season else 0
    now = np.stack(parts[: 1 + trend] + parts[2 + turn :] + parts[2 : 2 + turn] if season else parts, 1)
    return now[:, :, :-1], now[:, :, -1], total[:, -1, -1], 2 * total[:, -1, :-1], total[:, :-1, :-1]


def _joined(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What two blocks do one after the other."""
    (m1, v1, q1, b1, c1), (m2, v2, q2, b2, c2) = first, second
    over = m1.transpose(0, 2, 1)
    cv = (c2 @ v1[:, :, None])[:, :, 0]
    return (
        m2 @ m1,
        (m2 @ v1[:, :, None])[:, :, 0] + v2,
        q1 + q2 + (b2 * v1).sum(1) + (v1 * cv).sum(1),
        b1 + (over @ (b2 + 2 * cv)[:, :, None])[:, :, 0],
        c1 + over @ c2 @ m1,
    )


def _unpack(raw: bytes, sets: int, size: int) -> tuple[np.ndarray, ...]:
    shapes = [(sets, size, size), (sets, size), (sets,), (sets, size), (sets, size, size)]
    flat = np.split(np.frombuffer(raw, float), np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
    return tuple(f.reshape(x) for f, x in zip(flat, shapes))


def _pack(effect: tuple[np.ndarray, ...]) -> bytes:
    return np.concatenate([np.ravel(p) for p in effect]).tobytes()


def _smooth(df: DataFrame, spec: SeriesSpec, grid: tuple, season: int | None) -> DataFrame:
    """Per series: LAST, LEN, ``best`` (number of the chosen parameter set), ``state``, ``sse``.

    ``season`` None is simple smoothing, 0 Holt, above that Holt-Winters (series shorter than two seasons are
    smoothed by Holt with the same first parameters)."""
    y = spec.target
    s = split(known_rows(df, spec), spec, reach=2 * (season or 1), most=ARRAY_ROWS)
    schema = T.StructType(
        [s.cold.schema[k] for k in s.keys]
        + [T.StructField(LAST, s.cold.schema[spec.ts].dataType), T.StructField(LEN, T.LongType()), T.StructField("best", T.IntegerType()),
           T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType())]
    )
    if season:
        arrays = _arrays(s.cold, spec)
        cold = arrays.mapInPandas(_whole(s.keys, grid, season), schema)
    else:
        cold = _fold(_arrays(s.cold, spec), spec, grid, season == 0)
    if s.hot is None:
        return cold
    return cold.unionByName(_long(s.hot.withColumn(SEG, F.lit(0)), spec, s.keys, grid, season).drop(SEG))


def _long(hot: DataFrame, spec: SeriesSpec, keys: list[str], grid: tuple, season: int | None) -> DataFrame:
    """Long series with the stretches ``SEG``: ``(keys, SEG, LAST, LEN, best, state, sse)`` at the end of every stretch."""
    schema = T.StructType(
        [hot.schema[k] for k in keys]
        + [T.StructField(SEG, T.IntegerType()), T.StructField(LAST, hot.schema[spec.ts].dataType), T.StructField(LEN, T.LongType()),
           T.StructField("best", T.IntegerType()), T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType())]
    )
    if _effect_size(grid, season) > _EFFECT:
        return _streamed(hot, spec, keys, grid, season, schema)
    most = hot.agg(F.max(BLOCK)).first()[0] + 1  # blocks of the longest series
    return _chained(hot, spec, keys, grid, season, schema, most)


def smooth_folds(rows: DataFrame, spec: SeriesSpec, grid: tuple, season: int | None, h: int, folds: int) -> DataFrame:
    """What ``_smooth`` finds at the end of every fold's history, from one run along each series:
    ``(keys, fold, LEN, best, state, sse)``.

    ``rows`` are the history of fold 0 with ``SEG``, which counts from the rows that every fold trains on (0) to those that only fold 0
    trains on (``folds - 1``). With ``season`` above 0, folds shorter than two seasons have no row here."""
    y, cuts = spec.target, folds - 1
    s = split(rows.select(*spec.keys, *spec.order, y, SEG), spec, reach=2 * (season or 1), most=ARRAY_ROWS)
    names = [*s.keys, "fold", LEN, "best", "state", "sse"]
    schema = T.StructType(
        [rows.schema[k] for k in s.keys]
        + [T.StructField("fold", T.IntegerType()), T.StructField(LEN, T.LongType()), T.StructField("best", T.IntegerType()),
           T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType())]
    )
    arrays = _arrays(s.cold, spec)
    cold = arrays.mapInPandas(_whole_folds(s.keys, grid, season, h, folds), schema) if season else _fold_cuts(arrays, spec, grid, season == 0, h, folds)
    if s.hot is None:
        return cold.select(*names)
    return cold.select(*names).unionByName(_long(s.hot, spec, s.keys, grid, season).withColumn("fold", F.lit(cuts) - F.col(SEG)).select(*names))


def _fold_cuts(arrays: DataFrame, spec: SeriesSpec, grid: tuple, trend: bool, h: int, folds: int) -> DataFrame:
    """Simple and Holt smoothing as one fold over the array that keeps the states at every cut, in the JVM."""
    y, size = F.col("__y"), F.size("__y")

    def cut(f: int) -> Column:
        return F.greatest(size - f * h, F.lit(1))

    bounds = [F.lit(1), *[cut(f) for f in reversed(range(folds))]]
    parts = F.array(*[F.slice(y, a + 1, b - a) for a, b in zip(bounds, bounds[1:])])
    slope = F.when(size > 1, F.try_element_at(y, F.lit(2)) - y[0]).otherwise(0.0) if trend else F.lit(0.0)
    sets = [(p[0], p[0] * p[1]) if trend else (p, 0.0) for p in grid]
    start = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), y[0].alias("l"), slope.alias("t"), F.lit(0.0).alias("sse"))
        for i, (a, b) in enumerate(sets)
    ])

    def step(s: Column, v: Column) -> Column:
        ahead = s["l"] + s["t"]
        e = v - ahead
        return F.struct(s["i"].alias("i"), s["a"].alias("a"), s["b"].alias("b"),
                        (ahead + s["a"] * e).alias("l"), (s["t"] + s["b"] * e).alias("t"), (s["sse"] + e * e).alias("sse"))

    def further(states: Column, part: Column) -> Column:
        return F.concat(states, F.array(F.transform(F.element_at(states, -1), lambda s: F.aggregate(part, s, step))))

    states = arrays.select(*spec.keys, LEN, F.aggregate(parts, F.array(start), further).alias("__s"))
    each = states.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    each = each.withColumn(LEN, F.col(LEN) - F.col("fold") * h).where(F.col(LEN) > 0)
    ranked = F.transform(F.col("__s")[folds - F.col("fold")], lambda s: F.struct(F.round(s["sse"], 9).alias("k"), s["i"].alias("i"), s["l"].alias("l"), s["t"].alias("t"), s["sse"].alias("sse")))
    best = each.select(*spec.keys, "fold", LEN, F.array_min(ranked).alias("__b"))
    state = F.array("__b.l", "__b.t") if trend else F.array("__b.l")
    return best.select(*spec.keys, "fold", LEN, F.col("__b.i").alias("best"), state.alias("state"), F.col("__b.sse").alias("sse"))


def _whole_folds(keys: list[str], grid: tuple, season: int, h: int, folds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.asarray(v, float) for v in pdf["__y"]]
            stops = [[len(v) - f * h for f in range(folds) if len(v) - f * h >= 2 * season] for v in values]
            mine = sorted((i for i, x in enumerate(stops) if x), key=lambda i: len(values[i]))
            while mine:
                take = max(1, min(_TOGETHER, _VALUES // len(values[mine[-1]]), _VALUES // (len(grid) * season)))
                chunk, mine = mine[-take:], mine[:-take]
                fits = _run_stops([values[i] for i in chunk], grid, season, [stops[i] for i in chunk])
                at = [(i, f) for i in chunk for f in range(len(stops[i]))]
                out = pdf[keys].iloc[[i for i, _ in at]].reset_index(drop=True)
                found = [fit for one in fits for fit in one]
                out["fold"], out[LEN] = [f for _, f in at], [stops[i][f] for i, f in at]
                out["best"], out["state"], out["sse"] = [f[0] for f in found], [f[1].tolist() for f in found], [f[2] for f in found]
                yield out

    return run


def _arrays(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per (short) series with its values in time order."""
    ordered = F.array_sort(F.collect_list(F.struct(*spec.order, F.col(spec.target).alias("__v"))))
    # Without keys an empty frame still has one group.
    return rows.groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST), ordered.alias("__a")).where(F.size("__a") > 0).select(
        *spec.keys, LAST, F.size("__a").cast("long").alias(LEN), F.transform("__a", lambda r: r["__v"]).alias("__y")
    )


def _fold(arrays: DataFrame, spec: SeriesSpec, grid: tuple, trend: bool) -> DataFrame:
    """Simple and Holt smoothing as a fold over the array, once per parameter set, in the JVM."""
    if trend:
        options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(a * b).alias("b")) for i, (a, b) in enumerate(grid)])
    else:
        options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(0.0).alias("b")) for i, a in enumerate(grid)])
    y = F.col("__y")
    slope = F.when(F.size(y) > 1, F.try_element_at(y, F.lit(2)) - y[0]).otherwise(0.0) if trend else F.lit(0.0)
    start = F.struct(y[0].alias("l"), slope.alias("t"), F.lit(0.0).alias("sse"))

    def fit(p: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            ahead = s["l"] + s["t"]
            e = v - ahead
            return F.struct((ahead + p["a"] * e).alias("l"), (s["t"] + p["b"] * e).alias("t"), (s["sse"] + e * e).alias("sse"))

        end = F.aggregate(F.slice(y, F.lit(2), F.size(y)), start, step)
        return F.struct(F.round(end["sse"], 9).alias("k"), p["i"].alias("i"), end["l"].alias("l"), end["t"].alias("t"), end["sse"].alias("sse"))

    best = arrays.withColumn("__b", F.array_min(F.transform(options, fit)))
    state = F.array("__b.l", "__b.t") if trend else F.array("__b.l")
    return best.select(*spec.keys, LAST, LEN, F.col("__b.i").alias("best"), state.alias("state"), F.col("__b.sse").alias("sse"))


#: Series that are smoothed together, and values of them.
_TOGETHER, _VALUES = 256, 1 << 20


def _whole(keys: list[str], grid: tuple, season: int):
    pairs = tuple((p[0], p[1]) for p in grid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.asarray(v, float) for v in pdf["__y"]]
            fits: list = [None] * len(values)
            for long in (True, False):
                mine = sorted((i for i, v in enumerate(values) if (len(v) >= 2 * season) == long), key=lambda i: len(values[i]))
                while mine:
                    # The longest first; all of a chunk are laid out as long as its longest.
                    take = max(1, min(_TOGETHER, _VALUES // max(1, len(values[mine[-1]])), _VALUES // (len(grid) * (season if long else 1))))
                    chunk, mine = mine[-take:], mine[:-take]
                    for i, fit in zip(chunk, _run_many([values[i] for i in chunk], grid if long else pairs, season if long else 0)):
                        fits[i] = fit
            out = pdf[[*keys, LAST, LEN]].copy()
            out["best"] = [f[0] for f in fits]
            out["state"] = [f[1].tolist() for f in fits]
            out["sse"] = [f[2] for f in fits]
            yield out

    return run


#: Blocks whose effects one task joins into one.
_JOINED = 64
#: Numbers of a block's effect, at most; above that a long series is streamed through one task instead.
_EFFECT = 1 << 21


def _effect_size(grid: tuple, season: int | None) -> int:
    size = 1 + (season is not None) + (season or 0)
    return len(grid) * (2 * size * size + 2 * size + 1)


def _chained(hot: DataFrame, spec: SeriesSpec, keys: list[str], grid: tuple, season: int | None, schema: T.StructType, most: int) -> DataFrame:
    """Long series: blocks are summarised in parallel, and the summaries of a stretch (``SEG``) joined in rounds, ``_JOINED`` neighbours
    at a time, until one task chains the few that are left of a series. It gives the outcome at the end of every stretch."""
    y, skip = spec.target, (season or 1)
    sets, size = len(grid), 1 + (season is not None) + (season or 0)
    key_fields = [hot.schema[k] for k in keys]
    block_schema = T.StructType(
        key_fields
        + [T.StructField(SEG, T.IntegerType()), T.StructField(BLOCK, T.LongType()), T.StructField("head", T.ArrayType(T.DoubleType())), T.StructField("effect", T.BinaryType()),
           T.StructField(LAST, hot.schema[spec.ts].dataType), T.StructField(LEN, T.LongType())]
    )

    def one(pdf: pd.DataFrame, row: dict) -> pd.DataFrame:
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {k: [v] for k, v in row.items()})

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        values, pos = pdf[y].to_numpy(float), pdf[POS].to_numpy()
        effect = _pack(_summary(values[pos >= skip], grid, season))
        return one(pdf, {SEG: int(pdf[SEG].iloc[0]), BLOCK: int(pdf[BLOCK].iloc[0]), "head": values[pos < 2 * skip].tolist(), "effect": effect, LAST: pdf[spec.ts].max(), LEN: len(pdf)})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        effects = [_unpack(e, sets, size) for e in pdf["effect"]]
        head = np.concatenate([np.asarray(h, float) for h in pdf["head"]])
        return one(pdf, {SEG: int(pdf[SEG].iloc[0]), BLOCK: int(pdf[BLOCK].iloc[0]) // _JOINED, "head": head.tolist(), "effect": _pack(reduce(_joined, effects)), LAST: pdf[LAST].max(), LEN: int(pdf[LEN].sum())})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([SEG, BLOCK])
        x0, _ = _start(np.concatenate([np.asarray(h, float) for h in pdf["head"]]), season)
        x, sse, n, ends = np.tile(x0, (sets, 1)), np.zeros(sets), 0, []
        for seg, part in pdf.groupby(SEG):
            for raw in part["effect"]:
                m, v, q, b, quad = _unpack(raw, sets, size)
                sse += q + (b * x).sum(1) + ((quad @ x[:, :, None])[:, :, 0] * x).sum(1)
                x = (m @ x[:, :, None])[:, :, 0] + v
            best, n = int(np.argmin(np.round(sse, 9))), n + int(part[LEN].sum())
            if n >= 2 * (season or 0):
                ends.append(one(part, {SEG: seg, LAST: part[LAST].max(), LEN: n, "best": best, "state": x[best].tolist(), "sse": float(sse[best])}))
        return pd.concat(ends) if ends else pd.DataFrame(columns=schema.names)

    blocks = hot.select(*keys, spec.ts, y, POS, SEG, BLOCK).groupBy(*keys, SEG, BLOCK).applyInPandas(summarise, block_schema)
    while most > _JOINED:
        near = F.floor(F.col(BLOCK) / _JOINED).alias("__near")
        blocks = blocks.groupBy(*keys, SEG, near).applyInPandas(join, block_schema)
        most = -(-most // _JOINED)
    return blocks.groupBy(*keys).applyInPandas(chain, schema)


def _streamed(hot: DataFrame, spec: SeriesSpec, keys: list[str], grid: tuple, season: int, schema: T.StructType) -> DataFrame:
    """Long series whose season is so long that a block's effect would be larger than the block: each passes through one task in order.

    A task holds the state of one series, and values of one batch. It gives the outcome at the end of every stretch (``SEG``)."""
    y = spec.target
    names = [*keys, SEG, LAST, LEN, "best", "state", "sse"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seg, smoother, last, n = None, None, None, None, 0

        def done() -> Iterator[pd.DataFrame]:
            if smoother is not None and n >= 2 * season:
                best, state, sse = smoother.finish()
                yield pd.DataFrame([(*now, seg, last, n, best, state.tolist(), sse)], columns=names)

        for pdf in batches:
            for key, part in pdf.groupby([*keys, SEG], dropna=False, sort=False):
                *key, stretch = (None if pd.isna(k) else k for k in key)
                if smoother is None or key != now or stretch != seg:
                    yield from done()
                if smoother is None or key != now:
                    now, smoother, n = key, _Stream(grid, season), 0
                smoother.add(part[y].to_numpy(float))
                seg, last, n = stretch, part[spec.ts].iloc[-1], n + len(part)
        yield from done()

    rows = hot.select(*keys, spec.ts, y, POS, SEG)
    ordered = rows.repartition(*keys) if keys else rows.coalesce(1)
    return ordered.sortWithinPartitions(*keys, POS).mapInPandas(run, schema)


class _Stream:
    """Smooths one series as its values come. ``season`` is above 0."""

    def __init__(self, grid: tuple, season: int):
        self.gains, self.season = _gains(grid, season), season
        self.head, self.level, self.t = np.zeros(0), None, 0
        self.sse = np.zeros(len(grid))

    def add(self, y: np.ndarray) -> None:
        if self.level is None:
            self.head = np.concatenate([self.head, y])
            if len(self.head) < 2 * self.season:
                return
            x, at = _start(self.head, self.season)
            self.level, self.trend = np.full_like(self.sse, x[0]), np.full_like(self.sse, x[1])
            self.ring = np.repeat(x[2:, None], len(self.sse), 1)
            y = self.head[at:]
        a, b, g = self.gains
        for v in y:
            phase = self.ring[self.t]
            ahead = self.level + self.trend
            e = v - ahead - phase
            self.sse += e * e
            self.level = ahead + a * e
            self.trend = self.trend + b * e
            phase += g * e
            self.t = (self.t + 1) % self.season

    def finish(self) -> tuple[int, np.ndarray, float]:
        best = int(np.argmin(np.round(self.sse, 9)))
        phases = np.roll(self.ring[:, best], -self.t)
        return best, np.concatenate([[self.level[best], self.trend[best]], phases]), float(self.sse[best])


# --- the models ---------------------------------------------------------------------------------------------


def fit_ses(df: DataFrame, spec: SeriesSpec, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Per series ``alpha``, ``level``, ``sse``, LEN and LAST."""
    fit = _smooth(df, spec, alphas, None)
    alpha = F.element_at(F.array(*[F.lit(a) for a in alphas]), F.col("best") + 1)
    return fit.select(*spec.keys, LAST, LEN, alpha.alias("alpha"), F.col("state")[0].alias("level"), "sse")


def ses(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """Simple exponential smoothing."""
    return over_steps(fit_ses(df, spec), spec, h, F.col("level"))


def holt(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """Holt's linear trend."""
    return over_steps(_smooth(df, spec, HOLT_GRID, 0), spec, h, F.col("state")[0] + F.col("state")[1] * F.col("step"))


def holt_winters(df: DataFrame, spec: SeriesSpec, h: int, season: int = 7) -> DataFrame:
    """Additive Holt-Winters; series shorter than two seasons fall back to Holt."""
    fit = _smooth(df, spec, HW_GRID, season)
    phase = F.try_element_at("state", (F.lit(3) + (F.col("step") - 1) % season).cast("int"))
    line = F.col("state")[0] + F.col("state")[1] * F.col("step")
    return over_steps(fit, spec, h, line + F.coalesce(phase, F.lit(0.0)))


def theta(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """Theta method: simple smoothing plus a drift of half the slope of the least-squares line."""
    spec = measured(df, spec)
    both = join_stats(fit_ses(df, spec), line_of(df, spec).select(*spec.keys, "slope"), spec.keys)
    a, n = F.col("alpha"), F.col(LEN)
    drift = F.col("slope") / 2 * (F.col("step") - 1 + (1 - F.pow(1 - a, n)) / a)
    return over_steps(both, spec, h, F.col("level") + drift)


def _demand(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with demand, and the number of rows since the one before (for the first: since the start)."""
    rows = with_positions(known_rows(df, spec), spec, AT, LEN).where(F.col(spec.target) != 0)
    rows = over_series(rows, spec, {"__before": lambda w: F.lag(AT).over(w)}, before=1)
    return rows.withColumn("__gap", (F.col(AT) - F.coalesce(F.col("__before"), F.lit(-1))).cast("double"))


def _ends(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return known_rows(df, spec).groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST))


def croston(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1, alpha: float = 0.1) -> DataFrame:
    """Croston: smoothed demand sizes over smoothed intervals; 0 for a series without demand.

    With a fixed alpha a smoothed level is a weighted sum, so one aggregate gives both.
    """
    spec = measured(df, spec)
    demand = with_positions(_demand(df, spec), spec, "__i", "__n")
    weight = F.when(F.col("__i") == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("__n") - 1 - F.col("__i"))
    levels = demand.groupBy(*spec.keys).agg(F.sum(weight * F.col(spec.target)).alias("size"), F.sum(weight * F.col("__gap")).alias("gap"))
    one = join_stats(_ends(df, spec), levels, spec.keys)
    return over_steps(one, spec, h, F.coalesce(F.try_divide("size", "gap"), F.lit(0.0)))


def _bucketed(df: DataFrame, spec: SeriesSpec, all_widths: bool) -> DataFrame:
    """Sums over ``k`` rows counted back from the end (an incomplete first bucket is dropped), for k equal to
    the rounded mean interval between demands, ``__kmax``, or for every k up to it.

    Only buckets with demand have a row: ``__order`` is the bucket's number from the oldest, ``__buckets`` how many there are.
    A series of n rows has about n / __kmax demands, so all widths together take about n rows.
    """
    y, back = spec.target, F.col(LEN) - 1 - F.col(AT)
    demand = _demand(df, spec)
    mean_gap = demand.groupBy(*spec.keys).agg(F.greatest(F.round(F.avg("__gap")), F.lit(1.0)).cast("int").alias("__kmax"))
    rows = join_stats(demand, mean_gap, spec.keys, "inner")
    widths = F.explode(F.sequence(F.lit(1), F.col("__kmax"))) if all_widths else F.col("__kmax")
    rows = rows.withColumn("__k", widths).withColumn("__buckets", F.floor(F.col(LEN) / F.col("__k")))
    rows = rows.withColumn("__order", F.col("__buckets") - 1 - F.floor(back / F.col("__k"))).where("__order >= 0")
    return rows.groupBy(*spec.keys, "__kmax", "__k", "__buckets", "__order").agg(F.sum(y).alias(y))


def _sparse_levels(buckets: DataFrame, inner: SeriesSpec, alphas: tuple[float, ...]) -> DataFrame:
    """Final level of simple smoothing over buckets of which only those with demand have a row.

    m empty buckets after a level L leave L (1 - a)^m and add L^2 (1 - (1 - a)^2m) / (1 - (1 - a)^2) to the error sum.
    Series with more such buckets than one array should hold get rows for the empty ones and are chained.
    """
    y, size = inner.target, min(rows_per_task(buckets.sparkSession), ARRAY_ROWS)
    long = None if inner.longest is not None and inner.longest <= size else hot_groups(buckets, inner.keys, size)
    hot, cold = parted(buckets, inner.keys, long) if long else (None, buckets)
    arrays = cold.groupBy(*inner.keys).agg(F.max("__buckets").alias("__n"), F.array_sort(F.collect_list(F.struct("__order", F.col(y).alias("v")))).alias("__y"))
    start = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("sse"), F.lit(0).cast("long").alias("next"))

    def fit(p: Column) -> Column:
        stay = F.lit(1.0) - p["a"]

        def empty(s: Column, until: Column) -> tuple[Column, Column]:
            share = F.pow(stay, until - s["next"])
            return s["l"] * share, s["sse"] + s["l"] * s["l"] * (1 - share * share) / (1 - stay * stay)

        def step(s: Column, r: Column) -> Column:
            ahead, sse = empty(s, r["__order"])
            e, first = r["v"] - ahead, r["__order"] == 0
            level, error = F.when(first, r["v"]).otherwise(ahead + p["a"] * e), F.when(first, 0.0).otherwise(sse + e * e)
            return F.struct(level.alias("l"), error.alias("sse"), (r["__order"] + 1).alias("next"))

        def finish(s: Column) -> Column:
            level, sse = empty(s, F.col("__n"))
            return F.struct(F.round(sse, 9).alias("k"), p["i"].alias("i"), level.alias("l"))

        return F.aggregate("__y", start, step, finish)

    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(alphas)])
    levels = arrays.select(*inner.keys, F.array_min(F.transform(options, fit))["l"].alias("level"))
    if hot is None:
        return levels
    beside = {"__next": lambda w: F.lead("__order").over(w), "__before": lambda w: F.lag("__order").over(w)}
    at = F.sequence(F.col("__order"), F.coalesce(F.col("__next"), F.col("__buckets")) - 1)
    # Empty buckets before the first demand change nothing, except that smoothing starts at zero.
    at = F.when(F.col("__before").isNull() & (F.col("__order") > 0), F.concat(F.array(F.lit(0).cast("long")), at)).otherwise(at)
    full = over_series(hot, inner, beside, before=1, after=1).withColumn("__at", F.explode(at))
    value = F.when(F.col("__at") == F.col("__order"), F.col(y)).otherwise(0.0)
    filled = full.select(*inner.keys, F.col("__at").alias("__order"), value.alias(y))
    return levels.unionByName(fit_ses(filled, inner.replace(longest=None), alphas).select(*inner.keys, "level"))


def _aggregated(df: DataFrame, spec: SeriesSpec, h: int, all_widths: bool) -> DataFrame:
    inner = SeriesSpec(id=None, by=(*spec.keys, "__kmax", "__k"), ts="__order", target=spec.target, longest=spec.longest)
    levels = _sparse_levels(_bucketed(df, spec, all_widths), inner, INTERMITTENT_ALPHAS)
    # A width without demand in its complete buckets has the level 0.
    widths = F.max("__kmax") if all_widths else F.lit(1)
    one = levels.groupBy(*spec.keys).agg((F.sum(F.col("level") / F.col("__k")) / widths).alias("v"))
    # Rounded, so that the order of the arithmetic does not show.
    return over_steps(join_stats(_ends(df, spec), one, spec.keys), spec, h, F.coalesce(F.round("v", 12), F.lit(0.0)))


def adida(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """ADIDA: smooth demand summed over buckets of the mean interval, spread back evenly."""
    return _aggregated(df, measured(df, spec), h, False)


def imapa(df: DataFrame, spec: SeriesSpec, h: int, season: int = 1) -> DataFrame:
    """IMAPA: the mean of ADIDA forecasts over every bucket width up to the mean interval."""
    return _aggregated(df, measured(df, spec), h, True)


def stlf(df: DataFrame, spec: SeriesSpec, h: int, season: int = 7) -> DataFrame:
    """Decompose, forecast the seasonally adjusted series by Holt, add the phase back.

    Series shorter than two seasons are forecast by Holt alone."""
    spec = measured(df, spec)
    rows = known_rows(df, spec)
    parts = decompose(rows, spec, season)
    at = with_positions(parts, spec, AT, LEN)
    phases = at.withColumn("__p", (F.col(AT) % season).cast("int")).groupBy(*spec.keys, "__p").agg(F.first("seasonal").alias("s"), F.max(LEN).alias(LEN))
    phases = phases.groupBy(*spec.keys).agg(F.max(LEN).alias("__n"), F.map_from_entries(F.collect_list(F.struct("__p", "s"))).alias("m"))
    adjusted = parts.select(*spec.keys, spec.ts, (F.col("observed") - F.col("seasonal")).alias(spec.target))
    short = rows.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") < 2 * season)
    rest = join_stats(rows, short, spec.keys, "inner").select(*adjusted.columns)
    plain = spec.replace(ties=())
    fit = join_stats(_smooth(adjusted.unionByName(rest), plain, HOLT_GRID, 0), phases, spec.keys)
    phase = F.try_element_at("m", ((F.col("__n") - 1 + F.col("step")) % season).cast("int"))
    return over_steps(fit, spec, h, F.col("state")[0] + F.col("state")[1] * F.col("step") + F.coalesce(phase, F.lit(0.0)))
