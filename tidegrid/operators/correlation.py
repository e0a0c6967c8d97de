"""Correlation, collinearity and variance inflation of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.numeric import nan_to_null, numeric_columns


def _features(df: DataFrame, cols: list[str], target: str | None) -> list[str]:
    numeric = numeric_columns(df)
    kept = [c for c in cols if c in numeric and c != target]
    return kept + [target] if target in numeric else kept


#: What is summed over the rows that have both columns: rows, x y, x, y, x x, y y.
_SUMS = ("n", "xy", "x", "y", "xx", "yy")
#: Sums of tasks that one task adds up.
_FANS = (4096, 64, 1)
#: A variance below this share of the second moment is rounding.
_NO_VARIANCE = 1e-14


def _pair_sums(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """For each column of ``left`` (by its number ``i``) the ``_SUMS`` with every column of ``right``, as arrays.

    Every task multiplies its rows, with zeros for missing values, and the matrix of what is known; the plan has one column per sum however
    many columns are compared. Values are taken relative to the column's mean, so that large means cost no digits.
    """
    names = list(dict.fromkeys([*left, *right]))
    numbers = nan_to_null(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)]))
    columns = numbers.columns
    about = [F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)) for c in columns]
    shift = np.array([x or 0.0 for x in numbers.agg(*[a.alias(c) for a, c in zip(about, columns)]).first()], float)
    a, b = [names.index(c) for c in left], [names.index(c) for c in right]
    lists = [pa.list_(pa.float64())] * len(_SUMS)

    def batch_of(numbered: list[int], part: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(list(s), t) for s, t in zip(sums, lists)]
        return pa.RecordBatch.from_arrays([pa.array(numbered, pa.int32()), pa.array([part] * len(numbered), pa.int32()), *arrays], ["i", "part", *_SUMS])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(a), len(b))) for _ in _SUMS]
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float) - shift
            known = ~np.isnan(x)
            x[~known] = 0.0
            k = known.astype(float)
            xa, xb, ka, kb = x[:, a], x[:, b], k[:, a], k[:, b]
            for s, (u, v) in zip(total, ((ka, kb), (xa, xb), (xa, kb), (ka, xb), (xa * xa, kb), (ka, xb * xb))):
                s += u.T @ v
        yield batch_of(list(range(len(a))), TaskContext.get().partitionId(), total)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {c: [np.sum(np.stack(pdf[c].to_list()), 0)] for c in _SUMS}
        return pd.DataFrame({"i": pdf["i"].iloc[:1].to_list(), "part": pdf["part"].iloc[:1].to_list(), **sums})

    schema = "i int, part int, " + ", ".join(f"{c} array<double>" for c in _SUMS)
    sums = numbers.mapInArrow(multiplied, schema)
    for fan in _FANS:
        sums = sums.withColumn("part", F.col("part") % fan).groupBy("i", "part").applyInPandas(added, schema)
    return sums.drop("part")


def _between(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Rows (f1, f2, r) of every pair of a column of ``left`` and one of ``right``."""
    each = _pair_sums(df, left, right).select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "s")).select("i", "j", "s.*")
    n, spread = F.col("n"), {}
    for c in ("x", "y"):
        moment = F.col(c + c) - F.try_divide(F.col(c) * F.col(c), n)
        spread[c] = F.when(moment > F.col(c + c) * _NO_VARIANCE, moment)
    r = (F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)) / F.sqrt(spread["x"] * spread["y"])
    first, second = (F.element_at(F.array(*[F.lit(c) for c in names]), F.col(at) + 1) for names, at in ((left, "i"), (right, "j")))
    bounded = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return each.select(first.alias("f1"), second.alias("f2"), F.when(first == second, F.when(spread["x"].isNotNull(), 1.0)).otherwise(bounded).alias("r"))


def correlations(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """Pearson correlation of all pairs as rows ``(f1, f2, r)``; a pair uses the rows that have both values.

    NULL where one of them does not vary. Two passes over the rows (means, then products), whatever the number of columns.
    """
    names = _features(df, cols, target)
    if not names:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, r double")
    return _between(df, names, names)


def target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Correlation of every feature with the target: strong above 0.7, weak below 0.1 in absolute value."""
    r = F.abs("r")
    level = F.when(r > 0.7, "strong").when(r < 0.1, "weak").otherwise("moderate")
    features = [c for c in _features(df, cols, target) if c != target]
    if not features or target not in numeric_columns(df):
        return df.sparkSession.createDataFrame([], "feature string, r double, level string")
    rows = _between(df, features, [target])
    return rows.select(F.col("f1").alias("feature"), "r", level.alias("level"))


def collinear_pairs(df: DataFrame, cols: list[str], threshold: float = 0.7) -> DataFrame:
    """Pairs of features (each once, in the order given) correlated beyond ``threshold``; high beyond 0.9."""
    names = _features(df, cols, None)
    place = F.array(*[F.lit(n) for n in names])
    rows = correlations(df, names).where(F.array_position(place, F.col("f1")) < F.array_position(place, F.col("f2")))
    severity = F.when(F.abs("r") > 0.9, "high").otherwise("moderate")
    return rows.where(F.abs("r") > threshold).withColumn("severity", severity)


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factor (with intercept) of each feature over complete rows: > 5 warn, > 10 strong.

    The factors are the diagonal of the inverse correlation matrix: one aggregate over the data, then a
    matrix as wide as the list of features.
    """
    names = _features(df, cols, None)
    complete = nan_to_null(df).select(*names).na.drop()
    at = {n: i for i, n in enumerate(names)}
    matrix = np.eye(len(names))
    for r in correlations(complete, names).collect():
        matrix[at[r["f1"]], at[r["f2"]]] = np.nan if r["r"] is None else r["r"]
    if np.isnan(matrix).any():
        factors = np.full(len(names), np.nan)
    elif np.linalg.matrix_rank(matrix) < len(names):
        factors = np.full(len(names), np.inf)
    else:
        factors = np.diag(np.linalg.inv(matrix))
    level = F.when(F.col("vif") > 10, "strong").when(F.col("vif") > 5, "warn").otherwise("ok")
    rows = [(n, None if np.isnan(f) else float(f)) for n, f in zip(names, factors)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").withColumn("level", level)
