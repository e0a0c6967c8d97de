"""The report of a run: one table per section in one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.plans.runs import RunStore
from tidegrid.sources.files import write_csv
from tidegrid.spec import RunParams


def parameter_rows(spark: SparkSession, params: RunParams | str) -> DataFrame:
    """The parameters as rows ``(Parameter, Value)``."""
    values = json.loads(params.to_json() if isinstance(params, RunParams) else params)
    rows = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in values.items()]
    return spark.createDataFrame(rows, "Parameter string, Value string")


def series_boards(board: DataFrame, id: str, metric: str) -> DataFrame:
    """Leaderboards of all series in one table: ``(unique_id, Model, <METRIC>)``."""
    return board.select(F.col(id).cast("string").alias("unique_id"), F.col("model").alias("Model"), F.col("metric").alias(metric.split()[0].upper()))


def placeholder(spark: SparkSession, what: str) -> DataFrame:
    return spark.createDataFrame([(f"{what} not found",)], "info string")


def report_sections(store: RunStore, run_id: str) -> dict[str, DataFrame]:
    """Sections by name; what a run did not produce is a one-row table saying so."""
    spark = store.spark
    status = store.status(run_id).first()

    def stored(name: str, what: str, shape=lambda df: df) -> DataFrame:
        return shape(store.read(run_id, name)) if store.has(run_id, name) else placeholder(spark, what)

    params = status["params"]
    known = json.loads(params) if params else {}
    return {
        "Prediction": stored("predictions", "Prediction"),
        "Leaderboard": stored("leaderboard", "Leaderboard", lambda d: d.orderBy(F.desc_nulls_last("score_val"), "model")),
        "TrainingParams": parameter_rows(spark, params) if params else placeholder(spark, "Training parameters"),
        "WeightedEnsemble": stored("weights", "WeightedEnsemble weights", lambda d: d.withColumnsRenamed({"model": "Model", "weight": "Weight"})),
        "Messages": stored("messages", "Messages", lambda d: d.select(F.col("message").alias("messages"))),
        "SeriesLeaderboards": stored("series_leaderboard", "Series leaderboards", lambda d: series_boards(d, known["item_id_column"], known["evaluation_metric"])),
    }


def write_report(store: RunStore, run_id: str, path: str) -> None:
    """Write every section as CSV into its own folder below ``path``."""
    for name, section in report_sections(store, run_id).items():
        write_csv(section, f"{path.rstrip('/')}/{name}", mode="overwrite")
