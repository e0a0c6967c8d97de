"""Shaping tables into series, looking at them, splitting and combining them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.numeric import nan_to_null
from tidegrid.sources.dates import DEFAULT_FORMATS, parse_timestamp
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, null_safe, with_positions

_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def safe_timestamp(df: DataFrame, col: str, formats: tuple[str, ...] = DEFAULT_FORMATS) -> DataFrame:
    """Parse ``col`` to TIMESTAMP_NTZ, with NULL for what does not parse. Timestamps stay as they are."""
    require(df, [col])
    if isinstance(df.schema[col].dataType, _TIMESTAMPS):
        return df
    return df.withColumn(col, parse_timestamp(df, col, formats))


def count_invalid(df: DataFrame, col: str, formats: tuple[str, ...] = DEFAULT_FORMATS) -> DataFrame:
    """How many non-NULL values of ``col`` are not timestamps."""
    parsed = F.col(col) if isinstance(df.schema[col].dataType, _TIMESTAMPS) else parse_timestamp(df, col, formats)
    return df.agg(F.count_if(F.col(col).isNotNull() & parsed.isNull()).alias("invalid"))


def to_series(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Canonical columns ``item_id`` (string), ``timestamp``, ``target``; other columns ride along.

    Rows are not sorted: every operator states the order it needs.
    """
    require(df, [spec.id, spec.ts, spec.target])
    renamed = nan_to_null(safe_timestamp(df, spec.ts)).withColumnsRenamed(
        {spec.id: "item_id", spec.ts: "timestamp", spec.target: "target"}
    )
    rest = [c for c in renamed.columns if c not in ("item_id", "timestamp", "target")]
    return renamed.select(F.col("item_id").cast("string").alias("item_id"), "timestamp", "target", *rest)


def static_table(df: DataFrame, id: str, cols: list[str], ts: str) -> DataFrame:
    """The first row of each id, by timestamp (rows without one come last), of the static columns that exist."""
    present = [c for c in cols if c in df.columns and c != id]
    first = df.groupBy(id).agg(F.min(F.struct(F.col(ts).isNull().alias("__undated"), F.col(ts).alias("__at"), *present)).alias("s"))
    return first.select(id, *[F.col(f"s.{c}").alias(c) for c in present])


def attach_statics(preds: DataFrame, statics: DataFrame, id: str) -> DataFrame:
    """Left join of the statics on id. ``statics`` is reduced to one row per id first."""
    cols = [c for c in statics.columns if c != id]
    one = statics.groupBy(id).agg(F.min(F.struct(*cols)).alias("s")).select(id, *[F.col(f"s.{c}") for c in cols])
    return join_stats(preds, one, [id])


def forecast_columns(preds: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Forecast with canonical names back to the caller's names, timestamps as text."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias(spec.ts)
    rest = [c for c in preds.columns if c not in ("item_id", "timestamp", "mean")]
    return preds.select(F.col("item_id").alias(spec.id), stamp, F.col("mean").alias(spec.target), *rest)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows as text, with the table's row count in ``total_rows``."""
    head = df.orderBy(*order).limit(n).select([F.col(c).cast("string").alias(c) for c in df.columns])
    return head.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total_rows"))))


def series_thin(df: DataFrame, spec: SeriesSpec, max_points: int = 50) -> DataFrame:
    """At most ``max_points`` rows per series, evenly spaced: those at positions ``int(i * n / max_points)``."""
    step = F.col("__total") / F.lit(float(max_points))
    nearest = F.floor(F.col("__at") / step)

    def picked(i: Column) -> Column:
        return (i >= 0) & (i < max_points) & (F.floor(i * step) == F.col("__at"))

    keep = (F.col("__total") <= max_points) | picked(nearest) | picked(nearest + 1) | picked(nearest - 1)
    return with_positions(df, spec, "__at", "__total").where(keep).drop("__at", "__total")


def series_by_id(df: DataFrame, spec: SeriesSpec, value: str, max_points: int = 50) -> DataFrame:
    """The (thinned) rows of one series; an error if there are none."""
    require(df, [spec.id])
    rows = series_thin(df.where(F.col(spec.id).cast("string") == str(value)), spec, max_points)
    if rows.isEmpty():
        raise ValueError(f"no series with id {value!r}")
    return rows


def label_segments(df: DataFrame, spec: SeriesSpec, cuts: Callable[[int], list[int]], name: str) -> DataFrame:
    """Number the stretches of the table between row positions ``cuts(row count)`` in time order (NULLs last).

    Rows are counted per day first (a table as long as the calendar); only days that a cut falls into are
    ordered, so the table as a whole is neither sorted nor shuffled.
    """
    day = F.coalesce(F.to_date(spec.ts), F.lit("9999-12-31").cast("date"))
    per_day = sorted((r["d"], r["n"]) for r in df.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    at, seen, marks = 0, 0, []
    positions = sorted(cuts(sum(n for _, n in per_day)))
    for d, n in per_day:
        while at < len(positions) and positions[at] < seen + n:
            marks.append((d, max(positions[at] - seen, 0)))
            at += 1
        seen += n
    # Cuts at or beyond the last row pass no row.
    whole = F.lit(0)
    for d, inner in marks:
        passed = (day > F.lit(d)) if inner else (day >= F.lit(d))
        whole = whole + passed.cast("int")
    inside = sorted({d for d, inner in marks if inner})
    if not inside:
        return df.withColumn(name, whole)
    cut_days = day.isin([F.lit(d) for d in inside])
    plain = df.where(~cut_days).withColumn(name, whole)
    ranked = with_positions(
        df.where(cut_days).withColumn("__day", day), SeriesSpec(id=None, ts=spec.ts, ties=spec.ties, by=("__day",)), "__at"
    )
    extra = F.lit(0)
    for d, inner in marks:
        if inner:
            extra = extra + ((F.col("__day") == F.lit(d)) & (F.col("__at") >= inner)).cast("int")
    return plain.unionByName(ranked.withColumn(name, whole + extra).drop("__day", "__at"))


def split_by_time(df: DataFrame, spec: SeriesSpec, test: float = 0.2, val: float = 0.0):
    """(train, test, val) by row share in time order; ``val`` is None when its share is 0."""
    labelled = label_by_time(df, spec, test, val)
    parts = {p: labelled.where(F.col("part") == p).drop("part") for p in ("train", "test", "val")}
    return parts["train"], parts["test"], parts["val"] if val > 0 else None


def label_by_time(df: DataFrame, spec: SeriesSpec, test: float = 0.2, val: float = 0.0) -> DataFrame:
    """Rows with ``part`` = train, val or test: cuts at ``int(n(1-test-val))`` and ``int(n(1-test))``."""
    names = ["train", "val", "test"] if val > 0 else ["train", "test"]

    def cuts(n: int) -> list[int]:
        return ([int(n * (1 - test - val))] if val > 0 else []) + [int(n * (1 - test))]

    labelled = label_segments(safe_timestamp(df, spec.ts), spec, cuts, "__part")
    return labelled.withColumn("part", F.element_at(F.array(*[F.lit(p) for p in names]), F.col("__part") + 1)).drop("__part")


def top_series(df: DataFrame, spec: SeriesSpec, k: int = 5, non_null: bool = False) -> DataFrame:
    """The ``k`` longest series with their row (or non-NULL target) counts; the smaller id wins a tie."""
    n = F.count(spec.target) if non_null else F.count(F.lit(1))
    return df.groupBy(spec.id).agg(n.alias("n")).orderBy(F.desc("n"), spec.id).limit(k)


def top_series_rows(df: DataFrame, spec: SeriesSpec, k: int = 5, non_null: bool = True) -> DataFrame:
    """All rows of the ``k`` best covered series."""
    top = top_series(df, spec, k, non_null)
    return df.join(F.broadcast(top), null_safe(df, top, [spec.id]), "left_semi")  # top has k rows


def union_forecasts(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def label_samples(historical: DataFrame, new: DataFrame, name: str = "source") -> DataFrame:
    """Both samples in one table, labelled ``historical`` and ``new``."""
    return historical.withColumn(name, F.lit("historical")).unionByName(new.withColumn(name, F.lit("new")), allowMissingColumns=True)


def overlay(facts: DataFrame, forecasts: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Facts and forecasts in one table with ``kind``; rows without a valid date or number are dropped."""

    def part(df: DataFrame, kind: str) -> DataFrame:
        rows = df.select(F.col(spec.id).cast("string").alias(spec.id), spec.ts, F.col(spec.target).cast("double").alias(spec.target))
        return rows.where(F.col(spec.ts).isNotNull() & F.col(spec.target).isNotNull() & ~F.isnan(spec.target)).withColumn("kind", F.lit(kind))

    return part(facts, "fact").unionByName(part(forecasts, "forecast"))


def common_ids(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    return a.select(id).intersect(b.select(id))
