"""Recognising dates in text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extra patterns tried after the ISO forms that a cast understands. Callers may pass their own.
DEFAULT_FORMATS: tuple[str, ...] = ()


def parse_timestamp(df: DataFrame, col: str, formats: tuple[str, ...] = DEFAULT_FORMATS) -> Column:
    """TIMESTAMP_NTZ of a text, date or timestamp column; NULL where it does not parse."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.StringType):
        return F.col(col).try_cast("timestamp_ntz") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("timestamp_ntz")
    tries = [F.col(col).try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(F.col(col), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return reduce(lambda a, b: F.coalesce(a, b), tries)


def date_report(df: DataFrame, formats: tuple[str, ...] = DEFAULT_FORMATS) -> DataFrame:
    """Per text column: non-NULL values, how many of them are dates, and whether the column converts."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for c in text:
        aggs += [F.count(c).alias(f"{c}__n"), F.count(parse_timestamp(df, c, formats)).alias(f"{c}__ok")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("non_null"), F.col(f"{c}__ok").alias("parsed")) for c in text])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("converts", F.col("parsed") == F.col("non_null"))


def auto_convert_dates(df: DataFrame, formats: tuple[str, ...] = DEFAULT_FORMATS) -> DataFrame:
    """Turn each text column whose non-NULL values are all dates into TIMESTAMP_NTZ.

    The result's schema depends on the data, so this runs one aggregate when called.
    """
    if not any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        return df
    convert = [r["column"] for r in date_report(df, formats).where("converts").collect()]
    return df.withColumns({c: parse_timestamp(df, c, formats) for c in convert})
