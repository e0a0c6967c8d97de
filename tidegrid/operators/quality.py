"""Validation, profiling, outliers, gaps and missing cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.grid import micros
from tidegrid.functions.numeric import nan_to_null, numeric_columns
from tidegrid.operators.series import count_invalid, label_segments, safe_timestamp
from tidegrid.quantiles import quantiles
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, over_series

#: Fixed value: the choice that stands for "no column".
NO_COLUMN = "<нет>"

_Q = {"q1": 0.25, "q3": 0.75}


def _outside(y: str) -> Column:
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return F.coalesce((F.col(y) < F.col("q1") - reach) | (F.col(y) > F.col("q3") + reach), F.lit(False))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def _given(col: str | None) -> bool:
    return bool(col) and col != NO_COLUMN


def errors(df: DataFrame, spec: SeriesSpec) -> list[tuple[str, float | None]]:
    """What makes the table unusable, as (code, value): the first failing check. One aggregate at most."""
    ts, y, id = (c if _given(c) else None for c in (spec.ts, spec.target, spec.id))
    missing = [c for c in (ts, y, id) if c and c not in df.columns]
    if missing:
        return [(f"missing column: {c}", None) for c in missing]
    bad = count_invalid(df, ts).first()["invalid"] if ts else 0
    if bad:
        return [(f"invalid dates: {ts}", float(bad))]
    if y and not isinstance(df.schema[y].dataType, T.NumericType):
        return [(f"not numeric: {y}", None)]
    return []


def validate(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Findings as rows ``(severity, code, value, detail)``; no row of severity ``error`` means valid.

    Stops at the first failing check: missing columns, then unparseable dates, then a non-numeric target.
    Otherwise warnings: NULL dates, NULL targets (count and percent), outliers (count and percent), gaps
    (count and number of series).
    """
    spark = df.sparkSession
    schema = "severity string, code string, value double, detail double"
    ts, y, id = (c if _given(c) else None for c in (spec.ts, spec.target, spec.id))
    wrong = errors(df, spec)
    if wrong:
        return spark.createDataFrame([("error", code, value, None) for code, value in wrong], schema)
    df = nan_to_null(safe_timestamp(df, ts) if ts else df)
    none = F.lit(0).cast("long")
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(ts).isNull()) if ts else none).alias("no_ts"),
        (F.count_if(F.col(y).isNull()) if y else none).alias("no_y"),
    )
    found = [("missing dates", F.col("no_ts"), None), ("missing target", F.col("no_y"), _percent(F.col("no_y"), F.col("n")))]
    if y:
        facts = facts.crossJoin(F.broadcast(target_outliers(df, y)))
        found.append(("outliers", F.col("outliers"), F.col("percent")))
    if ts:
        facts = facts.crossJoin(F.broadcast(find_gaps(df, spec.replace(id=id))))
        found.append(("gaps", F.col("gaps"), F.col("series").cast("double")))
    rows = F.array(
        *[
            F.struct(
                F.lit("warning").alias("severity"), F.lit(code).alias("code"), value.cast("double").alias("value"),
                (F.lit(None) if detail is None else detail).cast("double").alias("detail"),
            )
            for code, value, detail in found
        ]
    )
    return facts.select(F.explode(rows).alias("r")).select("r.*").where(F.col("value") > 0)


def is_valid(findings: DataFrame) -> bool:
    return findings.where(F.col("severity") == "error").isEmpty()


def profile(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row of statistics: rows, target min/max/mean/median/std, missing dates and targets, outliers, ids."""
    y = F.col(spec.target)
    extra = {
        "rows_count": F.count(F.lit(1)),
        "target_min": F.min(y), "target_max": F.max(y), "target_mean": F.avg(y), "target_std": F.stddev_samp(y),
        "missing_dt": F.count_if(F.col(spec.ts).isNull()), "missing_target": F.count_if(y.isNull()),
    }
    if spec.id:
        extra["unique_ids"] = F.count_distinct(spec.id)
    stats = quantiles(df, [], spec.target, {**_Q, "target_median": 0.5}, extra)
    beyond = df.crossJoin(F.broadcast(stats.select("q1", "q3"))).agg(F.count_if(_outside(spec.target)).alias("outliers_count"))
    return stats.drop("q1", "q3").crossJoin(F.broadcast(beyond))


def missing_counts(df: DataFrame) -> DataFrame:
    """NULLs (and NaNs) per column as rows ``(column, missing)``."""
    df = nan_to_null(df)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max of each numeric column, one row per column.

    For the quartiles the columns become rows, so that the same passes serve all of them and no task orders more than one
    column's values; the rest needs the table only as it is."""
    cols = cols or numeric_columns(df)
    values = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    facts = values.agg(*[F.struct(F.lit(c).alias("column"), *[f(F.col(c)).alias(n) for n, f in stats.items()]).alias(f"__{i}") for i, c in enumerate(cols)])
    facts = facts.select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(cols))])).alias("r")).select("r.*")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    long = values.select(F.explode(cells).alias("r")).select("r.*")
    quartiles = quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_stats(quartiles, F.broadcast(facts), ["column"])


def target_outliers(df: DataFrame, y: str) -> DataFrame:
    """Values beyond 1.5 interquartile ranges from the quartiles of the whole table: count and percent."""
    bounds = quantiles(df, [], y, _Q)
    counts = df.crossJoin(F.broadcast(bounds)).agg(F.count_if(_outside(y)).alias("outliers"), F.count(F.lit(1)).alias("__n"))
    return counts.select("outliers", _percent(F.col("outliers"), F.col("__n")).alias("percent"))


def flag_outliers(df: DataFrame, spec: SeriesSpec, method: str = "iqr", per_id: bool = True) -> DataFrame:
    """Rows with ``is_outlier``, by interquartile range or by |z| > 3, per series or over the table."""
    keys, y = (spec.keys if per_id else []), spec.target
    if method == "iqr":
        return join_stats(df, quantiles(df, keys, y, _Q), keys).withColumn("is_outlier", _outside(y)).drop("q1", "q3")
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(y).alias("__m"), F.stddev_samp(y).alias("__s"))
        z = F.abs(F.try_divide(F.col(y) - F.col("__m"), F.col("__s")))
        return join_stats(df, stats, keys).withColumn("is_outlier", F.coalesce(z > 3, F.lit(False))).drop("__m", "__s")
    raise ValueError(f"unknown outlier method {method!r}; expected 'iqr' or 'zscore'")


def detect_outliers(df: DataFrame, spec: SeriesSpec, method: str = "iqr", per_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows without outliers, outlier rows)."""
    flagged = flag_outliers(df, spec, method, per_id)
    return flagged.where(~F.col("is_outlier")).drop("is_outlier"), flagged.where("is_outlier").drop("is_outlier")


def time_steps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Distances in microseconds between consecutive timestamps of each series, counted per series."""
    rows = safe_timestamp(df, spec.ts).select(*spec.keys, spec.ts).where(F.col(spec.ts).isNotNull())
    # Repeated timestamps give distance 0; leaving that out equals comparing distinct timestamps.
    steps = over_series(rows, spec.replace(ties=()), {"__prev": lambda w: F.lag(spec.ts).over(w)}, before=1)
    diff = micros(F.col(spec.ts)) - micros(F.col("__prev"))
    return steps.withColumn("step", diff).where(F.col("step") > 0).groupBy(*spec.keys, "step").agg(F.count(F.lit(1)).alias("n"))


def find_gaps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row: the usual step in seconds (mode over all series, the smallest on a tie), the number of steps
    longer than it by more than a second, and the number of series that have one."""
    steps = time_steps(df, spec)
    usual = steps.groupBy("step").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "step").limit(1).select(F.col("step").alias("mode"))
    gap = F.col("step") > F.col("mode") + 1_000_000
    series = F.count_distinct(F.when(gap, F.struct(*spec.keys))) if spec.keys else F.max(gap.cast("long"))
    return steps.crossJoin(F.broadcast(usual)).agg(
        (F.max("mode") / 1_000_000.0).alias("step_seconds"),
        F.coalesce(F.sum(F.when(gap, F.col("n"))), F.lit(0)).alias("gaps"),
        F.coalesce(series, F.lit(0)).alias("series"),
    )


def duplicate_keys(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(key, timestamp) pairs that occur more than once, with their counts."""
    return df.groupBy(*spec.keys, spec.ts).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_summary(df: DataFrame) -> DataFrame:
    """Rows, missing cells (NULL, NaN or empty text) and their percentage of all cells."""
    cells = df.select(_missing_in_row(df).alias("m"))
    out = cells.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"))
    return out.withColumn("percent", _percent(F.col("missing"), F.col("total") * len(df.columns)))


def _missing_in_row(df: DataFrame) -> Column:
    total = F.lit(0)
    for f in df.schema.fields:
        gone = F.col(f.name).isNull()
        if isinstance(f.dataType, T.StringType):
            gone = gone | (F.col(f.name) == "")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            gone = gone | F.isnan(f.name)
        total = total + F.coalesce(gone, F.lit(True)).cast("int")
    return total


def missing_profile(df: DataFrame, spec: SeriesSpec, bins: int = 12) -> DataFrame:
    """Missing cells in ``bins`` stretches of ``ceil(rows / bins)`` rows in time order.

    A stretch is named by its first and last date if a column's name speaks of a date or time, else by its
    number. Stretches beyond the last row are kept, empty.
    """
    label = next((c for c in df.columns if re.search("date|время|time", c.lower())), None)

    def cuts(n: int) -> list[int]:
        size = -(-n // bins) if n else 1
        return [size * i for i in range(1, bins) if size * i < n]

    rows = label_segments(df.withColumn("__m", _missing_in_row(df)), spec, cuts, "__bin")
    aggs = [F.sum("__m").alias("missing"), F.count(F.lit(1)).alias("total")]
    if label:
        by = F.struct(*spec.order)
        aggs += [F.min_by(F.col(label).cast("string"), by).alias("__a"), F.max_by(F.col(label).cast("string"), by).alias("__z")]
    found = rows.groupBy("__bin").agg(*aggs)
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("__bin"))
    out = every.join(found, "__bin", "left")
    number = (F.col("__bin") + 1).cast("string")
    name = F.coalesce(F.concat(F.substring("__a", 1, 10), F.lit(" - "), F.substring("__z", 1, 10)), number) if label else number
    zero = F.lit(0).cast("long")
    return out.select(
        (F.col("__bin") + 1).alias("bin"), name.alias("name"), F.coalesce("missing", zero).alias("missing"), F.coalesce("total", zero).alias("total")
    )
