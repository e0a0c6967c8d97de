"""The register of queries: a Spark callable and, where one exists, the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def eliminated(size: int, by: str = "") -> dict[str, str]:
    """Steps ``s1`` to ``s<size>``: Gauss-Jordan elimination on the first ``size`` pivots of a matrix ``s0 (i, j, v)`` in SQL.

    In the last step the first ``size`` rows and columns hold the inverse, and a further column the solutions. ``by``
    names a column with the number of the matrix."""
    on, key = (f"AND a.{by} = {{0}}.{by}", f"a.{by}, ") if by else ("", "")
    step = """SELECT {key}a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN 1 / p.v WHEN a.i = {k} THEN a.v / p.v WHEN a.j = {k} THEN -a.v / p.v
        ELSE a.v - c.v * r.v / p.v END AS v FROM s{before} a JOIN s{before} p ON p.i = {k} AND p.j = {k} {on_p}
        JOIN s{before} c ON c.i = a.i AND c.j = {k} {on_c} JOIN s{before} r ON r.i = {k} AND r.j = a.j {on_r}"""
    return {f"s{k}": step.format(key=key, k=k, before=k - 1, on_p=on.format("p"), on_c=on.format("c"), on_r=on.format("r")) for k in range(1, size + 1)}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, integers as BIGINT; ``+ 0.0`` turns -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
