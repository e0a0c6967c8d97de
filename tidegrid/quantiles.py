"""Exact quantiles (linear interpolation) of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Groups too long for that are solved by
selection instead, in two passes for all levels: one digest brackets the wanted ranks, then one aggregate counts each
distinct value inside a bracket and, as one row each, what lies between brackets. Running counts over that short list,
cut up where it is long, give the ranks. A group with a rank outside its bracket is counted once more by all its distinct
values, so a rank is never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import checkpointed
from tidegrid.spec import SeriesSpec
from tidegrid.splits import hot_groups, join_stats, parted, rows_per_task, running_sums, small_side

_ACCURACY = 10_000
_SLACK = 4.0 / _ACCURACY


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], extra: dict[str, Column] | None = None):
    """One row per group with the named exact quantiles of ``value`` and any ``extra`` aggregates.

    NULL values are skipped, as is a group without any row. The median is ``{"median": 0.5}``.
    """
    extra = extra or {}
    limit = rows_per_task(df.sparkSession)
    groups = hot_groups(df, keys, limit)
    # One buffer of values serves all levels.
    aggs = [F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__q"), *[e.alias(n) for n, e in extra.items()]]
    columns = [*[F.col(k) for k in keys], *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)], *[F.col(f"`{n}`") for n in extra]]
    if not groups:
        return df.groupBy(*keys).agg(*aggs).select(*columns)
    hot_rows, cold = df, None
    if keys and groups.others:
        hot_rows, rest = parted(df, keys, groups)
        cold = rest.groupBy(*keys).agg(*aggs).select(*columns)
    out = hot_rows.groupBy(*keys).agg(*[e.alias(n) for n, e in extra.items()]) if extra else groups.keys
    out = join_stats(out, _select(hot_rows.where(F.col(value).isNotNull()), keys, value, probs, groups.groups), keys)
    out = out.select(*[F.col(f"`{c}`") for c in (*keys, *probs, *extra)])
    return out if cold is None else cold.unionByName(out)


def _select(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], groups: int) -> DataFrame:
    """The quantiles of the long groups in ``rows``, from brackets around the two ranks of each level."""
    v, levels = F.col(value), sorted(set(probs.values()))
    edges = [max(p - _SLACK, 0.0) for p in levels] + [min(p + _SLACK, 1.0) for p in levels]
    digest = F.percentile_approx(v, F.array(*[F.lit(float(e)) for e in edges]), _ACCURACY)
    found = rows.groupBy(*keys).agg(F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"), digest.alias("__edges"))
    state = checkpointed(found)
    ends = {f"__lo{i}": F.col("__edges")[i] for i in range(len(levels))} | {f"__hi{i}": F.col("__edges")[len(levels) + i] for i in range(len(levels))}
    out = checkpointed(_ranked(rows, keys, value, levels, state.withColumns(ends).drop("__edges"), groups))
    missed = out.where("__missed").count()
    if missed:
        whole = state.withColumns({c: F.col("__min" if c.startswith("__lo") else "__max") for c in ends}).drop("__edges")
        whole = join_stats(whole, out.where("__missed").select(*keys, F.lit(1).alias("__again")), keys, "inner").drop("__again")
        out = out.where(~F.col("__missed")).unionByName(_ranked(rows, keys, value, levels, whole, missed))
    return out.select(*keys, *[F.col(f"__v{levels.index(p)}").alias(n) for n, p in probs.items()])


def _ranked(rows: DataFrame, keys: list[str], value: str, levels: list[float], state: DataFrame, groups: int) -> DataFrame:
    """Each group of ``state`` with its quantiles ``__v0, ...``, and ``__missed`` if a rank lies between its brackets ``__lo``, ``__hi``."""
    v, each = F.col(value), range(len(levels))
    near = join_stats(rows, small_side(state.drop("__n", "__min", "__max"), groups), keys, "inner")
    # Both ends ascend with the level: a value is inside a bracket if more of them begin than end before it.
    begun = sum((F.when(v >= F.col(f"__lo{i}"), 1).otherwise(0) for i in each), F.lit(0))
    ended = sum((F.when(v > F.col(f"__hi{i}"), 1).otherwise(0) for i in each), F.lit(0))
    near = near.select(*keys, v.alias("__x"), begun.alias("__begun"), ended.alias("__ended"))
    gap = F.when(F.col("__begun") <= F.col("__ended"), F.col("__ended")).alias("__gap")
    inside = F.when(F.col("__begun") > F.col("__ended"), F.col("__x")).alias("__in")
    counted = near.groupBy(*keys, gap, inside).agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__first"), F.max("__x").alias("__last"))
    placed = running_sums(checkpointed(counted), SeriesSpec(id=None, ts="__first", by=tuple(keys)), ["__c"], "_to")
    placed = join_stats(placed, small_side(state.select(*keys, "__n"), groups), keys)
    start, end = F.col("__c_to") - F.col("__c"), F.col("__c_to")

    def at(k: Column) -> tuple[Column, Column]:
        """The value of rank ``k`` in an aggregate, and whether it is hidden between brackets. The first and the last there are known."""
        here = (start <= k) & (k < end)
        hidden = here & F.col("__gap").isNotNull() & (k != start) & (k != end - 1)
        return F.max(F.when(here, F.when(k == start, F.col("__first")).otherwise(F.col("__last")))), F.bool_or(hidden)

    values, hidden = [], F.lit(False)
    for i, p in enumerate(levels):
        rank = (F.col("__n") - 1) * F.lit(float(p))
        k = F.floor(rank)
        (low, a), (high, b) = at(k), at(F.least(k + 1, F.col("__n") - 1))
        values.append((low + (high - low) * F.max(rank - k)).alias(f"__v{i}"))
        hidden = hidden | a | b
    return placed.groupBy(*keys).agg(*values, hidden.alias("__missed"))
