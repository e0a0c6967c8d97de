"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, called once per worker process; plans are unpickled anew for every task, ``sys`` is not."""
    kept = vars(sys).setdefault("_tidegrid_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``limit`` at most; a row above the limit is a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
