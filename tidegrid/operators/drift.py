"""Comparing a new sample with a historical one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.series import label_samples, safe_timestamp
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, running_sums, with_positions

_TINY = 1e-10
#: Spark cuts a rank filter to its rows before the shuffle up to this rank.
RANK_LIMIT = 1000


def ks_two_sample(historical: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic of two samples, its asymptotic p-value, and whether p < 0.05.

    Values are counted first (equal values collapse before the shuffle); the empirical distributions are
    running totals of the counts along the values.
    """
    both = label_samples(historical.select(col), new.select(col)).where(F.col(col).isNotNull() & ~F.isnan(col))
    is_new = (F.col("source") == "new").cast("long")
    counts = both.groupBy(col).agg(F.sum(1 - is_new).alias("h"), F.sum(is_new).alias("n"))
    along = running_sums(counts, SeriesSpec(id=None, ts=col), ["h", "n"])
    totals = counts.agg(F.sum("h").alias("__th"), F.sum("n").alias("__tn"))
    gap = F.abs(F.try_divide(F.col("h_cum"), F.col("__th")) - F.try_divide(F.col("n_cum"), F.col("__tn")))
    out = along.crossJoin(F.broadcast(totals)).agg(  # totals is one row
        F.max(gap).alias("statistic"), F.max("__th").alias("n_hist"), F.max("__tn").alias("n_new")
    )
    size = F.try_divide(F.col("n_hist") * F.col("n_new"), F.col("n_hist") + F.col("n_new"))
    out = out.withColumn("p_value", _kolmogorov_tail(F.sqrt(size) * F.col("statistic")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def _kolmogorov_tail(x: Column) -> Column:
    """P(K > x) of the Kolmogorov distribution; below 0.2 it is 1 to all digits."""
    terms = [F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x) for j in range(1, 21)]
    tail = reduce(lambda a, b: a + b, terms)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def moment_drift(historical: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """Percent change of mean and standard deviation; significant beyond 20 and 30 percent."""
    both = label_samples(historical.select(col), new.select(col))
    old, fresh = F.col("source") == "historical", F.col("source") == "new"
    v = F.col(col)
    one = both.agg(
        F.avg(F.when(old, v)).alias("mean_hist"), F.avg(F.when(fresh, v)).alias("mean_new"),
        F.stddev_samp(F.when(old, v)).alias("std_hist"), F.stddev_samp(F.when(fresh, v)).alias("std_new"),
    )

    def change(name: str) -> Column:
        a, b = F.col(f"{name}_hist"), F.col(f"{name}_new")
        return F.abs(b - a) / (F.abs(a) + _TINY) * 100

    out = one.withColumns({"mean_change_pct": change("mean"), "std_change_pct": change("std")})
    return out.withColumn("significant", F.coalesce((F.col("mean_change_pct") > 20) | (F.col("std_change_pct") > 30), F.lit(False)))


def rolling_drift(historical: DataFrame, new: DataFrame, spec: SeriesSpec, window: int = 30) -> DataFrame:
    """Mean distance of new rows from the last ``window`` historical rows, in their standard deviations.

    Per series present in both samples with at least ``window`` historical and 5 new rows; ``spec.id=None``
    compares the samples as one series. Above 2 counts as drift.
    """
    y, keys = spec.target, spec.keys
    historical, new = safe_timestamp(historical, spec.ts), safe_timestamp(new, spec.ts)
    if window <= RANK_LIMIT:
        # row_number() <= window is cut to ``window`` rows per task before the shuffle, however long a series is.
        latest = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*[F.desc_nulls_last(c) for c in spec.order])
        tail = historical.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") <= window)
    else:  # exact positions, which cut up long series; rows without a time come first, so they are the oldest here too
        at = with_positions(historical, spec, "__at", "__len")
        tail = at.where(F.col("__len") - F.col("__at") <= window)
    enough = F.count(y) >= 5
    base = tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__nh"), F.when(enough, F.avg(y)).alias("hist_mean"), F.when(enough, F.stddev_samp(y)).alias("hist_std")
    ).where(F.col("__nh") >= window).drop("__nh")
    z = F.abs(F.col(y) - F.col("hist_mean")) / (F.col("hist_std") + _TINY)
    out = join_stats(new, base, keys, "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_new"), F.first("hist_mean").alias("hist_mean"), F.first("hist_std").alias("hist_std"), F.avg(z).alias("mean_z")
    )
    out = out.where(F.col("n_new") >= 5)
    drift = F.coalesce(F.col("mean_z") > 2, F.lit(False))
    return out.withColumn("drift", drift).withColumn("intensity", F.when(drift, F.least(F.lit(1.0), F.col("mean_z") / 5)).otherwise(0.0))


def drift_findings(historical: DataFrame, new: DataFrame, spec: SeriesSpec, window: int = 30) -> DataFrame:
    """Every test as a row ``(test, subject, score, detected, reason)``."""
    y = spec.target
    ks = ks_two_sample(historical, new, y).select(
        F.lit("ks").alias("test"), F.lit(y).alias("subject"), F.when(F.col("significant"), F.col("statistic")).otherwise(0.0).alias("score"),
        F.col("significant").alias("detected"), F.lit("the distribution of the target has changed").alias("reason"),
    )
    moments = moment_drift(historical, new, y)

    def moment(name: str, limit: int) -> DataFrame:
        pct = F.col(f"{name}_change_pct")
        hit = F.coalesce(pct > limit, F.lit(False))
        text = F.format_string(f"the {name} of the target has changed by %.2f%%", pct)
        return moments.select(
            F.lit(name).alias("test"), F.lit(y).alias("subject"), F.when(hit, F.least(F.lit(1.0), pct / 100)).otherwise(0.0).alias("score"),
            hit.alias("detected"), text.alias("reason"),
        )

    subject = F.col(spec.id).cast("string") if spec.id else F.lit("all")
    rolling = rolling_drift(historical, new, spec, window).select(
        F.lit("rolling").alias("test"), subject.alias("subject"), F.col("intensity").alias("score"), F.col("drift").alias("detected"),
        F.format_string("new values lie off the recent level (mean z = %.2f)", "mean_z").alias("reason"),
    )
    return ks.unionByName(moment("mean", 20)).unionByName(moment("std", 30)).unionByName(rolling)


def drift_report(historical: DataFrame, new: DataFrame, spec: SeriesSpec, window: int = 30) -> DataFrame:
    """One row: whether any test detected drift, the highest score, and how many tests fired. The reasons are the
    rows of ``drift_findings``."""
    return drift_findings(historical, new, spec, window).agg(
        F.coalesce(F.bool_or("detected"), F.lit(False)).alias("drift_detected"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("drift_score"),
        F.count_if("detected").alias("findings"),
    )
