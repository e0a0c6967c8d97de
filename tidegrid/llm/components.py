"""Connected components of a graph of long identifiers, by alternating stars.

A round links every node's larger neighbours, then its smaller ones, to the smallest node around it. Each is a grouped
minimum and a join, so a node with many neighbours is pre-aggregated and its join can be split; no component is ever
gathered in one task. Rounds grow with the logarithm of a component's size; each ends in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns u and v. Returns (u, v): each node that is not its component's least, and that least."""
    now = checkpointed(edges.where("u <> v").select("u", "v"))
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        if not mark[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
    return now
