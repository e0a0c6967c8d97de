"""The numbers behind the charts: histograms, box plots, monthly trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.quantiles import quantiles
from tidegrid.splits import join_stats


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Counts in ``bins`` equal intervals between the least and the greatest value, optionally per ``by``.

    The last interval includes the greatest value. Intervals without a row are left out.
    """
    rows = df.where(F.col(col).isNotNull())
    ends = rows.agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("__lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    binned = rows.crossJoin(F.broadcast(ends)).select(*keys, place.alias("bin"), (F.col("__lo") + width * place).alias("lower"))
    return binned.groupBy(*keys, "bin").agg(F.min("lower").alias("lower"), F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Quartiles, and whiskers at the furthest values within 1.5 interquartile ranges of them; one row per ``by``."""
    keys = [by] if by else []
    q = quantiles(df, keys, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, {"n": F.count(col)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(col)
    whiskers = join_stats(df.select(*keys, col), q, keys).groupBy(*keys).agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("lower"), F.max(F.when(v <= F.col("q3") + reach, v)).alias("upper")
    )
    return join_stats(q, whiskers, keys)


def monthly_trend(df: DataFrame, ts: str, col: str, by: str | None = None) -> DataFrame:
    """Mean by calendar month over all series, labelled with the month's last day."""
    keys = [by] if by else []
    month = F.last_day(ts).cast("timestamp_ntz").alias("month")
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, month).agg(F.avg(col).alias("mean"))
