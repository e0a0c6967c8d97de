"""Reading and writing files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegrid.functions.numeric import nan_to_null

# Separators in the order they are tried, and those tried where none of them splits the header.
SEPARATORS = (";", ",", "\t", "|")
RARE_SEPARATORS = ("^", "~", ":", " ")
_BOM = "﻿"


def _fields(lines: list[str], sep: str) -> list[int]:
    """How many fields each line has, separators inside quotes not counted."""
    return [re.sub('"[^"]*"', "", line).count(sep) + 1 for line in lines]


def separator_of(lines: list[str]) -> str:
    """The separator that splits the header and gives the most lines as many fields as the header has.

    Among equally good ones the first of SEPARATORS; RARE_SEPARATORS count only where none of those splits the header, and only
    if all lines agree. A comma if the table has one column."""
    lines = [line.lstrip(_BOM) for line in lines if line.strip()]
    for group, share in ((SEPARATORS, 0.0), (RARE_SEPARATORS, 1.0)):
        agreeing = {}
        for sep in group:
            counts = _fields(lines, sep)
            if counts and counts[0] > 1:
                agreeing[sep] = sum(c == counts[0] for c in counts) / len(counts)
        best = max(agreeing, key=agreeing.get, default=None)
        if best and agreeing[best] >= share:
            return best
    return ","


def detect_separator(spark: SparkSession, path: str, sample_lines: int = 20) -> str:
    """The separator of a CSV file, found from its first lines. Only the head of the file is read."""
    lines = [r.value for r in spark.read.text(path).limit(sample_lines).collect()]
    if not lines:
        raise ValueError(f"{path} is empty")
    return separator_of(lines)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line. The scan is split over tasks, so large files need no chunking.

    Without a ``schema`` the types are inferred by one extra pass; give one for large data. Quoted line breaks
    are not supported, because they would forbid splitting a file.
    """
    sep = sep or detect_separator(spark, path)
    reader = spark.read.option("header", True).option("sep", sep).option("timestampType", "TIMESTAMP_NTZ")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True).option("preferDate", False)
    df = reader.csv(path)
    first = df.columns[0]
    if first.startswith(_BOM):
        df = df.withColumnRenamed(first, first.lstrip(_BOM))
    return nan_to_null(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error", sep: str = ",", bom: bool = True) -> None:
    """CSV with header, one file per task. ``bom`` starts every file with a byte order mark, as spreadsheet
    programs expect of UTF-8."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], _BOM + df.columns[0])
    df.write.mode(mode).option("header", True).option("sep", sep).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
