"""Ordered work on series of any length.

A window over ``partitionBy(id)`` puts a whole series into one task. That is right for ordinary series and
wrong for one that holds a large share of the table. ``split`` measures the series once (one aggregate over
the key columns) and separates

* ``cold`` rows: series short enough for one task. They keep the plain one-shuffle window.
* ``hot`` rows: the few long series. They are range-partitioned by (key, time), given their exact position,
  and cut into equal blocks. A window then runs per block, and what it needs from other blocks arrives
  either as a *halo* (copies of the neighbouring rows) or as a *carry* (one small row per block).

With nothing hot the hot side does not exist in the plan at all.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.session import checkpointed
from tidegrid.spec import SeriesSpec

ROWS_PER_TASK = "spark.tidegrid.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000
#: A side table (a row per long series or per block) is broadcast up to so many rows; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Range partitions for the rows of long series, at most; one may hold many blocks.
RANGE_PARTITIONS = 4_096

POS, BLOCK, HOME, COUNT = "__pos", "__block", "__home", "__n"
_IDX, _CELL = "__idx", "__cell"


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on ``keys`` under which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach per-group ``stats`` to the rows. NULL keys match. A join, unlike a window, lets adaptive
    execution split a skewed key or broadcast a small ``stats``."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # one row
    renamed = stats.select([F.col(f"`{c}`").alias(f"__k_{c}" if c in keys else c) for c in stats.columns])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys])
    return df.join(renamed, cond, how).drop(*[f"__k_{k}" for k in keys])


@dataclass(frozen=True)
class HotGroups:
    """Groups with more rows than one task should take: a frame of keys and COUNT, how many, how many blocks, and whether there are other groups."""

    keys: DataFrame
    groups: int
    blocks: int
    others: bool = True

    def __bool__(self) -> bool:
        return self.groups > 0


def hot_groups(df: DataFrame, keys: list[str], limit: int | None = None) -> HotGroups:
    """The groups of more than ``limit`` rows, all of them, however many there are.

    One aggregate with map-side combine; its outcome stays distributed, only two numbers reach the driver.
    """
    limit = limit or rows_per_task(df.sparkSession)
    every, hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT)), F.col(COUNT) > limit
    counts = every.where(hot)
    n, blocks, groups = every.agg(F.count_if(hot), F.coalesce(F.sum(F.when(hot, F.ceil(F.col(COUNT) / limit))), F.lit(0)), F.count(F.lit(1))).first()
    return HotGroups(checkpointed(counts) if n else counts, n, int(blocks), groups > n)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows allows one."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parted(df: DataFrame, keys: list[str], hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """The rows of hot groups, and the others."""
    side = small_side(hot.keys, hot.groups)
    cond = null_safe(df, hot.keys, keys)
    return df.join(side, cond, "left_semi"), df.join(side, cond, "left_anti")


@dataclass(frozen=True)
class Split:
    """Rows of short series, and rows of long ones with POS and BLOCK; ``hot`` is None if there are none."""

    cold: DataFrame
    hot: DataFrame | None
    keys: list[str]
    block_rows: int
    groups: int = 0
    blocks: int = 0


def split(df: DataFrame, spec: SeriesSpec, reach: int = 0, most: int | None = None) -> Split:
    """Separate long series. ``reach`` is how many rows a window looks beyond a block's edge; ``most`` lowers
    the size of a block for work that holds a block in memory."""
    keys = spec.keys
    size = max(min(rows_per_task(df.sparkSession), most or sys.maxsize), reach + 1)
    fits = spec.longest is not None and spec.longest <= size
    found = None if fits else hot_groups(df, keys, size)
    if not found:
        return Split(df, None, keys, size)
    rows, cold = parted(df, keys, found) if keys else (df, df.limit(0))
    parts = min(2 * found.blocks, RANGE_PARTITIONS)
    # The range partitioner samples, so its cut points exist only for this one run: keep the outcome.
    ranged = checkpointed(
        rows.repartitionByRange(parts, *keys, *spec.order)
        .sortWithinPartitions(*keys, *spec.order)
        .withColumn(_IDX, F.monotonically_increasing_id())
        .withColumn(_CELL, F.shiftright(F.col(_IDX), 33))
    )
    cells = ranged.groupBy(*keys, _CELL).agg(F.min(_IDX).alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per (range partition, key): parts + number of hot groups.
    base = cells.select(*keys, _CELL, (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    hot = (
        _join_small(ranged, base, [*keys, _CELL], parts + found.groups)
        .withColumn(POS, F.col(_IDX) + F.col("__base"))
        .withColumn(BLOCK, F.floor(F.col(POS) / size))
        .drop(_IDX, _CELL, "__base")
    )
    return Split(cold, hot, keys, size, found.groups, found.blocks + found.groups)


def _join_small(rows: DataFrame, small: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Left join a table of at most ``count`` rows: one per block or hot group."""
    renamed = small.select([F.col(f"`{c}`").alias(f"__k_{c}" if c in keys else c) for c in small.columns])
    cond = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys], F.lit(True))
    return rows.join(small_side(renamed, count), cond, "left").drop(*[f"__k_{k}" for k in keys])


def measured(df: DataFrame, spec: SeriesSpec) -> SeriesSpec:
    """``spec`` with the length of the longest series of ``df``. Holds for any subset of the rows as well."""
    if spec.longest is not None:
        return spec
    counts = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias(COUNT))
    return spec.replace(longest=counts.agg(F.max(COUNT)).first()[0] or 0)


def with_group_stats(df: DataFrame, spec: SeriesSpec, aggs: dict[str, Column]) -> DataFrame:
    """Add per-series aggregates to every row: in the series window if series are short, by a join if not."""
    if measured(df, spec).longest <= rows_per_task(df.sparkSession):
        w = series_window(spec.keys, spec).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select("*", *[e.over(w).alias(n) for n, e in aggs.items()])
    return join_stats(df, df.groupBy(*spec.keys).agg(*[e.alias(n) for n, e in aggs.items()]), spec.keys)


def series_window(keys: list[str], spec: SeriesSpec, backwards: bool = False) -> WindowSpec:
    order = [F.desc(c) for c in spec.order] if backwards else spec.order
    return Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order)


def _both(cold: DataFrame, hot: DataFrame | None) -> DataFrame:
    return cold if hot is None else cold.unionByName(hot)


def with_positions(df: DataFrame, spec: SeriesSpec, pos: str = POS, total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in its series and, if asked, the length of the series."""
    s = split(df, spec)
    w = series_window(s.keys, spec)
    cold = s.cold.withColumn(pos, (F.row_number().over(w) - 1).cast("long"))
    if total:
        everything = Window.partitionBy(*[F.col(k) for k in s.keys] or [F.lit(0)])
        cold = cold.withColumn(total, F.count(F.lit(1)).over(everything))
    hot = s.hot
    if hot is not None:
        sizes = hot.groupBy(*s.keys).agg((F.max(POS) + 1).alias("__total"))
        hot = hot.withColumn(pos, F.col(POS)).drop(BLOCK, *([POS] if pos != POS else []))
        if total:
            hot = _join_small(hot, sizes, s.keys, s.groups).withColumnRenamed("__total", total)
    return _both(cold, hot)


def over_series(
    df: DataFrame,
    spec: SeriesSpec,
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead."""
    s = split(df, spec, max(before, after))

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = series_window(keys, spec)
        return rows.select("*", *[make(w).alias(name) for name, make in columns.items()])

    cold = add(s.cold, s.keys)
    if s.hot is None:
        return cold
    offset = F.col(POS) % s.block_rows
    targets = F.array(
        F.col(BLOCK),
        F.when(offset >= s.block_rows - before, F.col(BLOCK) + 1),
        F.when(offset < after, F.col(BLOCK) - 1),
    )
    haloed = s.hot.withColumn(HOME, F.col(BLOCK)).withColumn(BLOCK, F.explode(F.array_compact(targets)))
    hot = add(haloed, [*s.keys, BLOCK]).where(F.col(BLOCK) == F.col(HOME)).drop(HOME, BLOCK, POS)
    return cold.unionByName(hot)


def nearest_known(
    df: DataFrame, spec: SeriesSpec, cols: dict[str, Column], pos: str | None = None, ahead: bool = True
) -> DataFrame:
    """For every named expression add ``__prev_<name>`` (last non-NULL at or before the row) and, if ``ahead``,
    ``__next_<name>`` (first non-NULL at or after it), each a struct ``(p, v)`` of position and value.
    The row's own position is added as ``pos`` when a name is given.

    Looking ahead is a running value along the series read backwards: a frame that *ends* at the last row would
    be recomputed for every row.
    """
    sides = ("prev", "next") if ahead else ("prev",)
    s = split(df, spec)

    def known(position: Column) -> dict[str, Column]:
        return {n: F.when(e.isNotNull(), F.struct(position.alias("p"), e.alias("v"))) for n, e in cols.items()}

    def add(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
        for side in sides:
            w = series_window(keys, spec, side == "next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = rows.select("*", *[F.last(e, ignorenulls=True).over(w).alias(f"__{side}_{n}") for n, e in known(F.col(position)).items()])
        return rows

    numbered = s.cold.withColumn(POS, (F.row_number().over(series_window(s.keys, spec)) - 1).cast("long"))
    cold = add(numbered, s.keys, POS)
    if s.hot is None:
        return cold.withColumnRenamed(POS, pos) if pos else cold.drop(POS)

    at_block = [*s.keys, BLOCK]
    edges = s.hot.groupBy(*at_block).agg(
        *[F.max(e).alias(f"__last_{n}") for n, e in known(F.col(POS)).items()],
        *[F.min(e).alias(f"__first_{n}") for n, e in known(F.col(POS)).items()],
    )
    w = Window.partitionBy(*[F.col(k) for k in s.keys] or [F.lit(0)])
    carry = edges
    for side in sides:
        edge, order = ("__last", F.col(BLOCK)) if side == "prev" else ("__first", F.desc(BLOCK))
        earlier = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.select("*", *[F.last(f"{edge}_{n}", ignorenulls=True).over(earlier).alias(f"__carry_{side}_{n}") for n in cols])
    carry = carry.drop(*[f"{edge}_{n}" for edge in ("__last", "__first") for n in cols])
    hot = _join_small(add(s.hot, at_block, POS), carry, at_block, s.blocks)
    both_sides = [f"{side}_{n}" for side in sides for n in cols]
    hot = hot.withColumns({f"__{x}": F.coalesce(f"__{x}", f"__carry_{x}") for x in both_sides})
    hot = hot.drop(BLOCK, *[f"__carry_{x}" for x in both_sides])
    both = cold.unionByName(hot)
    return both.withColumnRenamed(POS, pos) if pos else both.drop(POS)


def running_sums(df: DataFrame, spec: SeriesSpec, cols: list[str], suffix: str = "_cum") -> DataFrame:
    """Add running totals of ``cols`` along each series."""
    s = split(df, spec)

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = series_window(keys, spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", *[F.sum(c).over(w).alias(c + suffix) for c in cols])

    cold = add(s.cold, s.keys)
    if s.hot is None:
        return cold
    at_block = [*s.keys, BLOCK]
    w = (
        Window.partitionBy(*[F.col(k) for k in s.keys] or [F.lit(0)])
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = s.hot.groupBy(*at_block).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    carry = totals.select(*at_block, *[F.coalesce(F.sum(f"__t_{c}").over(w), F.lit(0)).alias(f"__b_{c}") for c in cols])
    hot = _join_small(add(s.hot, at_block), carry, at_block, s.blocks)
    hot = hot.withColumns({c + suffix: F.col(c + suffix) + F.col(f"__b_{c}") for c in cols})
    return cold.unionByName(hot.drop(BLOCK, POS, *[f"__b_{c}" for c in cols]))
