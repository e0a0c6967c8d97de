"""Filling missing numbers inside groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.numeric import nan_to_null, numeric_columns
from tidegrid.session import checkpointed
from tidegrid.spec import SeriesSpec
from tidegrid.splits import HotGroups, hot_groups, join_stats, nearest_known, null_safe, parted, rows_per_task, small_side, with_group_stats, with_positions

# Every spelling of the fill methods that callers use, and the method it means.
FILL_METHODS = {
    "none": "none",
    "constant=0": "constant", "constant": "constant", "constant_zero": "constant",
    "forward fill": "ffill", "forward_fill": "ffill", "ffill": "ffill", "backfill": "ffill", "bfill": "ffill",
    "group mean": "group_mean", "group_mean": "group_mean", "mean": "group_mean",
    "interpolate": "interpolate",
    "knn imputer": "knn", "knn_imputer": "knn", "knn": "knn",
}


def fill_method(name: str | None) -> str:
    key = (name or "none").strip().lower()
    if key not in FILL_METHODS:
        raise ValueError(f"unknown fill method {name!r}; expected one of {sorted(set(FILL_METHODS.values()))}")
    return FILL_METHODS[key]


def fill(
    df: DataFrame,
    method: str | None,
    spec: SeriesSpec,
    group_cols: tuple[str, ...] | list[str] | None = None,
    cols: list[str] | None = None,
    k: int = 5,
) -> DataFrame:
    """Fill NULLs of the numeric columns. ``group_cols`` defaults to the series keys; ``()`` means the whole
    table is one group. Order inside a group is the timestamp. A NULL group key is a group of its own."""
    method = fill_method(method)
    if method == "none":
        return df
    groups = tuple(spec.keys if group_cols is None else group_cols)
    cols = cols or numeric_columns(df, exclude=[*spec.keys, *groups, spec.ts])
    df = nan_to_null(df)
    by_group = SeriesSpec(id=None, ts=spec.ts, by=groups, ties=spec.ties, longest=spec.longest if groups == tuple(spec.keys) else None)
    if method == "constant":
        return df.na.fill(0, subset=cols)
    if method == "ffill":
        return _nearest(df, by_group, cols, lambda c: F.coalesce(f"__prev_{c}.v", f"__next_{c}.v"))
    if method == "group_mean":
        means = with_group_stats(df, by_group, {f"__mean_{c}": F.avg(c) for c in cols})
        return _replace(means, df.columns, {c: F.coalesce(c, f"__mean_{c}") for c in cols})
    if method == "interpolate":
        return _nearest(df, by_group, cols, _line, "__p")
    return fill_knn(df, by_group, cols, k)


def _replace(wide: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    return wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def _nearest(df: DataFrame, spec: SeriesSpec, cols: list[str], value, pos: str | None = None) -> DataFrame:
    near = nearest_known(df, spec, {c: F.col(c) for c in cols}, pos)
    return _replace(near, df.columns, {c: value(c) for c in cols})


def _line(c: str) -> Column:
    """Straight line by position between the known neighbours; the last known value after the last one."""
    before, after = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
    share = F.try_divide(F.col("__p") - before["p"], after["p"] - before["p"])
    return F.coalesce(
        F.col(c).cast("double"), before["v"] + (after["v"] - before["v"]) * share, before["v"].cast("double")
    )


# --- nearest neighbours -------------------------------------------------------------------------------------

#: Rows of one group that meet in one task; larger groups are cut into blocks of neighbouring rows.
KNN_BLOCK_ROWS = 20_000
#: Steps into which the quantiles of a column cut a large group, as a power of two.
_Z_BITS = 5


def fill_knn(df: DataFrame, spec: SeriesSpec, cols: list[str], k: int = 5, block_rows: int | None = None) -> DataFrame:
    """Replace a NULL by the mean of that column over the ``k`` nearest rows of the group that have it.

    Distance is Euclidean over the columns both rows have, scaled up by the share of columns compared.
    Equally distant donors are taken in time order. If no donor is comparable the column mean is used.
    Rows must be unique on (group, timestamp, ``spec.ties``).

    A group of up to ``block_rows`` rows is one task's work. In a larger one the donors of each column are cut into blocks of rows with the
    same columns and similar values of the others (along a Z curve over quantiles), each with the bounds of its columns. A missing
    cell first meets the block that can be nearest, which gives a k-th best distance, and then only blocks whose bounds are not farther than that. So the result
    is that of comparing all pairs, no task sees a whole large group, and how many blocks a cell meets follows from the data's
    density and not from the group's size. Only the bounds of blocks are compared with every cell.
    """
    block_rows = block_rows or min(KNN_BLOCK_ROWS, rows_per_task(df.sparkSession))
    sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    total, longest = sizes.agg(F.sum("n"), F.max("n")).first()
    spec = spec.replace(longest=longest or 0)
    big = hot_groups(df, spec.keys, block_rows) if spec.longest > block_rows else None
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (*spec.keys, *spec.order)]
    rows = df.withColumn("__row", F.concat_ws("\x1f", *named))
    numbers = [F.col(c).cast("double").alias(c) for c in cols]
    by = ["__g", *[f"__g_{g}" for g in spec.keys]]
    slim = rows.select("__row", F.lit(0).alias("__g"), *[F.col(g).alias(f"__g_{g}") for g in spec.keys], F.col(spec.ts).alias("__ts"), *numbers)
    filled = None
    if big:
        incomplete = F.lit(False)
        for c in cols:
            incomplete = incomplete | F.col(c).isNull()
        keys = HotGroups(big.keys.withColumn("__g", F.lit(0)).withColumnsRenamed({g: f"__g_{g}" for g in spec.keys}), big.groups, big.blocks)
        large, slim = parted(slim, by, keys)
        # A group without gaps needs no donors.
        gaps = large.where(incomplete).select(*by).distinct()
        found = _pruned(large.join(gaps, null_safe(large, gaps, by), "left_semi"), by, cols, k, block_rows, keys)
        best = Window.partitionBy("__row", "column").orderBy("distance", "at", "value")
        filled = (
            found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k)
            .groupBy("__row").pivot("column", cols).agg(F.avg("value"))
            .withColumnsRenamed({c: f"__knn_{c}" for c in cols})
        )
    if not big or spec.keys:
        small = _of_small_groups(slim, by, cols, k, -(-(total or 1) // block_rows))
        filled = small if filled is None else filled.unionByName(small)
    means = with_group_stats(rows, spec, {f"__mean_{c}": F.avg(c) for c in cols})
    wide = means.join(filled, "__row", "left")
    return _replace(wide, df.columns, {c: F.coalesce(F.col(c).cast("double"), f"__knn_{c}", f"__mean_{c}") for c in cols})


def _of_small_groups(rows: DataFrame, by: list[str], cols: list[str], k: int, buckets: int) -> DataFrame:
    """Per row with gaps ``__row`` the means ``__knn_<column>`` over its nearest donors, from groups that are dealt out whole to ``buckets``."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    # As texts, in which NULL differs from NaN, but zero not from its negative.
    texts = {g: (F.col(g) + F.lit(0.0) if isinstance(kinds[g], T.FractionalType) and not isinstance(kinds[g], T.DecimalType) else F.col(g)).cast("string") for g in by}
    dealt = rows.withColumns(texts).withColumn("__bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    out = T.StructType([T.StructField("__row", T.StringType()), *[T.StructField(f"__knn_{c}", T.DoubleType()) for c in cols]])
    return dealt.groupBy("__bucket").applyInPandas(_group_means(by, cols, k), out)


def _cells(rows: DataFrame, cols: list[str]) -> DataFrame:
    """``rows`` once for each missing column, whose number is ``__c``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(cols)]))
    return rows.withColumn("__c", F.explode(missing))


def _found_schema(rows: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField("__row", rows.schema["__row"].dataType), T.StructField("column", T.StringType()),
         T.StructField("distance", T.DoubleType()), T.StructField("at", rows.schema["__ts"].dataType),
         T.StructField("value", T.DoubleType())]
    )


def _count_below(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda q: q < value))


def _blocks(rows: DataFrame, by: list[str], cols: list[str], block_rows: int, big: HotGroups) -> DataFrame:
    """``rows`` once for each column ``__c`` that they can give to others, with ``__p``, which columns they have, and ``__b``, their block."""
    steps = 1 << _Z_BITS
    levels = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    cuts = rows.groupBy(*by).agg(*[F.percentile_approx(c, levels, 1000).alias(f"__q_{c}") for c in cols])
    rows = join_stats(rows, small_side(cuts, big.groups), by)
    step = [_count_below(F.col(f"__q_{c}"), F.col(c)) for c in cols]
    wanted = rows.agg(*[F.bool_or(F.col(c).isNull()) for c in cols]).first()
    given = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(cols) if wanted[i]]))
    rows = rows.withColumn("__c", F.explode(given))
    compared = [F.col(c).isNotNull() & (F.col("__c") != i) for i, c in enumerate(cols)]
    bits = [F.when(use, F.shiftright(n, b).bitwiseAND(1).cast("string")) for b in reversed(range(_Z_BITS)) for use, n in zip(compared, step)]
    known = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    rows = rows.withColumns({"__p": known, "__z": F.concat_ws("", *bits)}).drop(*[f"__q_{c}" for c in cols])
    curve = SeriesSpec(id=None, by=(*by, "__c", "__p"), ts="__z", ties=("__row",))
    placed = with_positions(rows, curve, "__pos").withColumn("__b", F.floor(F.col("__pos") / block_rows))
    return checkpointed(placed.drop("__z", "__pos"))


def _pruned(rows: DataFrame, by: list[str], cols: list[str], k: int, block_rows: int, big: HotGroups) -> DataFrame:
    """The best donors of each missing cell of large groups, among others that are no better."""
    placed = _blocks(rows, by, cols, block_rows, big)
    lows = [F.min(c).alias(f"__lo_{c}") for c in cols] + [F.max(c).alias(f"__hi_{c}") for c in cols]
    boxes = checkpointed(placed.groupBy(*by, "__c", "__p", "__b").agg(F.count(F.lit(1)).alias("__n"), *lows))
    count = boxes.count()
    cells = _cells(rows, cols)
    # The least distance from a cell's row to a block: none inside its bounds.
    shared = sum((F.when(F.col(c).isNotNull() & F.col(f"__lo_{c}").isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    off = [F.greatest(F.col(f"__lo_{c}") - F.col(c), F.col(c) - F.col(f"__hi_{c}"), F.lit(0.0)) for c in cols]
    least = F.sqrt(sum((F.coalesce(x * x, F.lit(0.0)) for x in off), F.lit(0.0)) * F.try_divide(F.lit(float(len(cols))), shared))

    def near(left: DataFrame) -> DataFrame:
        return join_stats(left, small_side(boxes, count), [*by, "__c"], "inner").where(shared > 0).withColumn("__least", least)

    cell = [*by, "__row", "__c"]
    closest = F.min(F.struct("__least", "__p", "__b")).alias("__home")
    home = near(cells).where(F.col("__n") >= k).groupBy(*cell, "__ts", *cols).agg(closest)
    home = checkpointed(home.withColumns({"__p": F.col("__home.__p"), "__b": F.col("__home.__b")}).drop("__home"))
    first = checkpointed(_meet(home, placed, by, cols, k, block_rows))
    column = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("__c") + 1)
    reach = first.groupBy(F.col("__row").alias("__r"), "column").agg(F.max("distance").alias("__reach"))
    known = home.withColumnsRenamed({"__p": "__hp", "__b": "__hb"}).withColumn("__name", column)
    known = known.join(reach, (F.col("__row") == F.col("__r")) & (F.col("__name") == F.col("column"))).select("__row", "__c", "__hp", "__hb", "__reach")
    # A cell without such a block, in a group of few donors, meets all.
    wide = near(cells.join(known, ["__row", "__c"], "left")).where("__least <= coalesce(__reach * (1 + 1e-9), double('infinity'))")
    rest = wide.where("__hb IS NULL OR __p <> __hp OR __b <> __hb").select(*home.columns)
    return first.unionByName(_meet(rest, placed, by, cols, k, block_rows))


def _meet(cells: DataFrame, donors: DataFrame, by: list[str], cols: list[str], k: int, block_rows: int) -> DataFrame:
    """The best donors of each cell in the block (``__p``, ``__b``) that it was sent to. Many cells of a block are dealt out, with a copy of it each."""
    at = [*by, "__c", "__p", "__b"]
    crowd = cells.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__parts"))
    cells = join_stats(cells, crowd, at, "inner").withColumn("__part", F.pmod(F.xxhash64("__row", "__c"), F.col("__parts")).cast("int"))
    copies = join_stats(donors, crowd, at, "inner").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    tagged = cells.withColumn("__q", F.lit(True)).unionByName(copies.withColumn("__q", F.lit(False)))
    return tagged.groupBy(*at, "__part").applyInPandas(_nearest_donors(cols, k), _found_schema(donors))


#: Distances that a task holds at once.
_DISTANCES = 1 << 20


def _nearest_rows(x: np.ndarray, y: np.ndarray, k: int):
    """The ``k`` nearest rows of ``y`` for each row of ``x``: chunks of row numbers of both and distances, in the order of ``x`` and by distance.
    Equally distant rows come in the order of ``y``."""
    step = max(1, _DISTANCES // max(1, len(y)))
    for a in range(0, len(x), step) if len(y) else ():
        some = x[a : a + step]
        total, shared = np.zeros((len(some), len(y))), np.zeros((len(some), len(y)))
        for c in range(x.shape[1]):
            gap = y[:, c][None, :] - some[:, c][:, None]
            both = ~np.isnan(gap)
            total += np.where(both, gap * gap, 0.0)
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(shared > 0, np.sqrt(total * (x.shape[1] / shared)), np.inf)
        last = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(y) > k else np.full(len(some), np.inf)
        i, n = np.nonzero((dist <= last[:, None]) & (shared > 0))  # all that tie with the k-th
        order = np.lexsort((n, dist[i, n], i))
        i, n = i[order], n[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, n = i[rank < k], n[rank < k]
        yield i + a, n, dist[i, n]


def _nearest_donors(cols: list[str], k: int):
    """Kernel: missing cells of column number ``__c`` (rows with ``__q``) against donors, the k best donors of each cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf["__q"]], pdf[~pdf["__q"]].sort_values("__ts", kind="stable")
        x, y = q[cols].to_numpy(float), d[cols].to_numpy(float)
        at, ids, wanted = d["__ts"].to_numpy(), q["__row"].to_numpy(), q["__c"].to_numpy(int)
        out = []
        for j in np.unique(wanted):
            mine, givers = np.flatnonzero(wanted == j), np.flatnonzero(~np.isnan(y[:, j]))
            for i, n, dist in _nearest_rows(x[mine], y[givers], k):
                out.append(pd.DataFrame({"__row": ids[mine[i]], "column": cols[j], "distance": dist, "at": at[givers[n]], "value": y[givers[n], j]}))
        return pd.concat(out) if out else pd.DataFrame({"__row": [], "column": [], "distance": [], "at": at[:0], "value": []})

    return run


def _numbered(values) -> tuple[np.ndarray, list]:
    """Each value's number, and the distinct values. Unlike in pandas, texts may hold zero characters."""
    numbers: dict = {}
    return np.array([numbers.setdefault(v, len(numbers)) for v in values], dtype=np.int64), list(numbers)


def _group_means(by: list[str], cols: list[str], k: int):
    """Kernel: whole groups, many at once; the means over the k best donors of each missing cell, a row per ``__row`` with gaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__ts", kind="stable")
        group, _ = _numbered(zip(*[pdf[g].astype(object).where(pdf[g].notna(), None) for g in by]))
        order = np.argsort(group, kind="stable")
        pdf, group = pdf.iloc[order], group[order]
        y = pdf[cols].to_numpy(float)
        gone = np.isnan(y)
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=group.max(initial=-1) + 1))
        cell, giver, column, far = [], [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            for j in np.flatnonzero(gone[a:b].any(axis=0)):
                mine, givers = a + np.flatnonzero(gone[a:b, j]), a + np.flatnonzero(~gone[a:b, j])
                for i, n, dist in _nearest_rows(y[mine], y[givers], k):
                    cell.append(mine[i]), giver.append(givers[n]), column.append(np.full(len(i), j)), far.append(dist)
        ids, names = _numbered(pdf["__row"])
        sums, counts = np.zeros((len(names), len(cols))), np.zeros((len(names), len(cols)))
        if cell:
            cell, giver, column, far = ids[np.concatenate(cell)], np.concatenate(giver), np.concatenate(column), np.concatenate(far)
            value = y[giver, column]
            if len(names) < len(pdf):  # rows of one key share the best of their donors
                best = pd.DataFrame({"c": cell, "j": column, "d": far, "at": pdf["__ts"].to_numpy()[giver], "v": value}).sort_values(["c", "j", "d", "at", "v"], na_position="first")
                best = best.groupby(["c", "j"]).head(k)
                cell, column, value = best["c"].to_numpy(), best["j"].to_numpy(), best["v"].to_numpy()
            np.add.at(sums, (cell, column), value)
            np.add.at(counts, (cell, column), 1)
        with np.errstate(invalid="ignore"):
            means = np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
        out = pd.DataFrame(means, columns=[f"__knn_{c}" for c in cols])
        out.insert(0, "__row", names)
        return out[counts.any(axis=1)]

    return run
