"""Queries on reading, writing and updating tables, and on whole runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.forecasting import _AHEAD, _FOLDS, _FOUR, _backtest, _greedy
from catalog.frames import with_frames as sql
from catalog.registry import ORACLES, query, rounded
from tidegrid.models import selection
from tidegrid.plans import forecast, report, runs
from tidegrid.session import shared_folder
from tidegrid.sources import files, tables
from tidegrid.spec import RunParams, SeriesSpec

S = SeriesSpec()


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/tidegrid-{uuid.uuid4().hex}"


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_READ_TYPES = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query(_ORDERS)
def csv_semicolon(spark, sf):
    """Write with semicolons and a byte order mark, read back with the separator found."""
    path = _scratch(spark)
    files.write_csv(fr.table(spark, sf, "orders"), path, sep=";")
    return files.read_csv(spark, path, schema=_READ_TYPES)


@query(_ORDERS)
def csv_comma_inferred(spark, sf):
    path = _scratch(spark)
    files.write_csv(fr.table(spark, sf, "orders"), path, bom=False)
    back = files.read_csv(spark, path)
    return back.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query(_ORDERS)
def parquet_round_trip(spark, sf):
    path = _scratch(spark)
    files.write_parquet(fr.table(spark, sf, "orders"), path, partition_by=("o_orderpriority",))
    return files.read_parquet(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT * FROM lineitem LIMIT 1000)")
def table_rows(spark, sf):
    return tables.table_rows(fr.table(spark, sf, "lineitem"), 1000).agg(F.count(F.lit(1)).alias("n"))


_SRC = "SELECT 2 * o_custkey AS c_custkey, o_totalprice AS c_acctbal, o_orderkey AS seq FROM orders"


def _upsert(spark, sf):
    """Every order changes the balance of customer ``2 * o_custkey``, which may be a new one."""
    o = fr.table(spark, sf, "orders")
    source = o.select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    return fr.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), source


_UPSERTED = """SELECT COALESCE(c.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NULL THEN c.c_acctbal ELSE s.c_acctbal END AS c_acctbal, c.c_mktsegment
    FROM customer c FULL JOIN (SELECT c_custkey, arg_max(c_acctbal, seq) AS c_acctbal FROM src GROUP BY 1) s ON c.c_custkey = s.c_custkey"""


@query(sql("", _UPSERTED, src=_SRC))
def upsert(spark, sf):
    target, source = _upsert(spark, sf)
    return tables.upsert(target, source, ["c_custkey"], "seq")


@query(sql("", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal, c_mktsegment FROM u", src=_SRC, u=_UPSERTED))
def upsert_table(spark, sf):
    """The same through a catalog table with a primary key, in storage types."""
    target, source = _upsert(spark, sf)
    name = f"tidegrid_{uuid.uuid4().hex}"
    tables.create_table(target, name, _scratch(spark), ["c_custkey"])
    tables.upsert_table(target, name)
    tables.upsert_table(source, name, order="seq")
    return spark.table(name)


@query(sql("", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal, c_mktsegment FROM u", src=_SRC, u=_UPSERTED))
def upsert_buckets(spark, sf):
    """The same with the rows in buckets of the key, of which an upsert replaces those that it hits."""
    target, source = _upsert(spark, sf)
    name = f"tidegrid_{uuid.uuid4().hex}"
    tables.create_table(target, name, _scratch(spark), ["c_custkey"], buckets=16)
    tables.upsert_table(target, name)
    tables.upsert_table(source, name, order="seq")
    return tables.stored_rows(spark, name)


@query(sql("", "SELECT * FROM customer_rows UNION ALL SELECT c_custkey, c_acctbal, NULL FROM src", src=_SRC, customer_rows="SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"))
def upsert_without_key(spark, sf):
    target, source = _upsert(spark, sf)
    return tables.upsert(target, source.drop("seq"), [])


@query(
    sql(
        "type_daily",
        "SELECT item_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, y FROM type_daily",
    )
)
def save_forecast(spark, sf):
    """A forecast table with text dates and quantile columns, saved into a new table."""
    t = fr.type_daily(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    t = t.withColumns({"0.1": F.col("y") * 0.9, "0.9": F.col("y") * 1.1})
    name = f"tidegrid_{uuid.uuid4().hex}"
    tables.save_forecast(t, name, True, _scratch(spark), ["item_id", "ts"])
    tables.save_forecast(t, name, False)
    return spark.table(name)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, MAX(ts) AS ts FROM events GROUP BY 1")
def latest_status(spark, sf):
    e = fr.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return runs.latest(e, "user_id", "ts", ("event_id",)).select("user_id", "event_type", "ts")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, MAX(ts + to_microseconds(event_id)) AS at, arg_max(event_type, ts + to_microseconds(event_id)) AS status, arg_max(props, ts + to_microseconds(event_id)) FILTER (event_type = 'purchase') AS params FROM events GROUP BY 1")
def run_registry(spark, sf):
    """Events as statuses of their users' runs, in two batches of the store's log; a purchase gives parameters."""
    e = fr.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.timestamp_add("MICROSECOND", F.col("event_id"), F.col("ts")).alias("at"),
        F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("params"), "event_id",
    )
    store = runs.RunStore(spark, _scratch(spark), batches=1)
    store.append(e.where(F.col("event_id") % 2 == 0))
    store.append(e.where(F.col("event_id") % 2 == 1))
    return store.newest().select("run_id", "at", "status", "params")


@query(sql("type_daily", 'SELECT item_id AS unique_id, model AS "Model", ROUND(metric, 6) + 0.0 AS "MASE" FROM ss', **_FOLDS))
def report_series_boards(spark, sf):
    scores = selection.series_scores(_backtest(spark, sf), S, "MASE")
    return rounded(report.series_boards(scores, "item_id", "MASE"))


_QUANTILES = [f"0.{i}" for i in range(1, 10)]
#: A whole run over the type series in SQL: weights, scores of the four models and their ensemble, the best one's forecast and errors.
_REPORT = {
    **_greedy("abs(e) / NULLIF(scale_abs, 0)"),
    **_AHEAD,
    "te": """SELECT model, fold, item_id, step, y, yhat, scale_abs FROM bt UNION ALL SELECT 'WeightedEnsemble', fold, item_id, step, y, SUM(yhat * weight) / SUM(weight), scale_abs
        FROM bt JOIN ew USING (model) WHERE weight > 0 GROUP BY fold, item_id, step, y, scale_abs""",
    "sc": """SELECT model, -AVG(metric) AS score_val FROM (SELECT model, item_id, AVG(e) AS metric FROM
        (SELECT model, fold, item_id, AVG(abs(y - yhat) / NULLIF(scale_abs, 0)) AS e FROM te GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
    "tp": "SELECT model FROM sc ORDER BY score_val DESC, model LIMIT 1",
    "pr": """SELECT model, item_id, step, yhat FROM ac UNION ALL SELECT 'WeightedEnsemble', item_id, step, SUM(yhat * weight) / SUM(weight)
        FROM ac JOIN ew USING (model) WHERE weight > 0 GROUP BY item_id, step""",
    "er": "SELECT model, step, " + ", ".join(f"quantile_cont(y - yhat, {q}) AS q{i}" for i, q in enumerate(_QUANTILES)) + " FROM te GROUP BY 1, 2",
}


def _section(spark, sf, name):
    """One section of the report of a run over the type series, stored and read back."""
    store, run_id = runs.RunStore(spark, _scratch(spark)), runs.new_run_id()
    forecast.run(fr.type_daily(spark, sf), _REPORT_PARAMS, store=store, run_id=run_id)
    return report.report_sections(store, run_id)[name]


_REPORT_PARAMS = RunParams("ts", "y", "item_id", "MASE", frequency="D", models_to_train=tuple(_FOUR), prediction_length=7)


@query(
    sql(
        "type_daily",
        "SELECT item_id, strftime(last + to_days(CAST(step AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts, ROUND(yhat, 4) + 0.0 AS y, "
        + ", ".join(f'ROUND(yhat + q{i}, 4) + 0.0 AS "{q}"' for i, q in enumerate(_QUANTILES))
        + " FROM pr JOIN tp USING (model) JOIN er USING (model, step) JOIN en USING (item_id)",
        **_REPORT,
    )
)
def report_prediction(spark, sf):
    return rounded(_section(spark, sf, "Prediction"), 4)


@query(sql("type_daily", "SELECT model, ROUND(score_val, 6) + 0.0 AS score_val, 'global' AS strategy FROM sc", **_REPORT))
def report_leaderboard(spark, sf):
    return rounded(_section(spark, sf, "Leaderboard"))


@query(sql("type_daily", 'SELECT model AS "Model", ROUND(weight, 6) + 0.0 AS "Weight" FROM ew WHERE weight > 0', **_REPORT))
def report_weights(spark, sf):
    return rounded(_section(spark, sf, "WeightedEnsemble"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v if isinstance(v, str) else json.dumps(v)}')" for k, v in json.loads(_REPORT_PARAMS.to_json()).items()) + ') t("Parameter", "Value")')
def report_parameters(spark, sf):
    return _section(spark, sf, "TrainingParams")


@query("SELECT message AS messages FROM (" + ORACLES["run_messages"] + ")")
def report_messages(spark, sf):
    """The messages of a run over the users' series."""
    store, run_id = runs.RunStore(spark, _scratch(spark)), runs.new_run_id()
    p = RunParams("ts", "y", "item_id", "MAE", frequency="D", models_to_train=("naive",), prediction_length=14)
    forecast.run(fr.user_daily(spark, sf).select("item_id", "ts", "y"), p, store=store, run_id=run_id)
    return report.report_sections(store, run_id)["Messages"]


def _run(spark, sf, **params):
    n = fr.nation_daily(spark, sf)
    p = RunParams("ts", "y", "item_id", "MASE", frequency="D", static_feature_columns=("region",), prediction_length=7, **params)
    return forecast.run(n, p).predictions


_LEVELS = [f"0.{i}" for i in range(1, 10)]


@query(
    sql(
        "nation_daily",
        "SELECT f.item_id, strftime(last + to_days(CAST(step AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts, ROUND(y, 4) + 0.0 AS y, region, "
        + ", ".join(f'ROUND(y + q{i}, 4) + 0.0 AS "{q}"' for i, q in enumerate(_LEVELS))
        + " FROM (SELECT item_id, MAX(ts) AS last, arg_max(y, ts) AS y, ANY_VALUE(region) AS region FROM nation_daily GROUP BY 1) f, errors",
        days="SELECT item_id, unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 1 DAY)) AS ts FROM nation_daily GROUP BY 1",
        filled="""SELECT d.item_id, d.ts, n.y, ROW_NUMBER() OVER (PARTITION BY d.item_id ORDER BY d.ts DESC) AS back
            FROM days d ASOF JOIN (SELECT * FROM nation_daily WHERE y IS NOT NULL) n ON d.item_id = n.item_id AND d.ts >= n.ts""",
        errors="SELECT (8 - (h.back - 7 * fold)) AS step, "
        + ", ".join(f"quantile_cont(h.y - l.y, {q}) AS q{i}" for i, q in enumerate(_LEVELS))
        + """ FROM range(0, 3) folds(fold) JOIN filled h ON h.back BETWEEN 7 * fold + 1 AND 7 * fold + 7
            JOIN filled l ON l.item_id = h.item_id AND l.back = 7 * fold + 8 GROUP BY 1""",
    )
)
def forecast_run(spark, sf):
    """A whole run: statics, holidays, fill, daily grid, naive model with its backtest and quantiles, naive fallback, statics again."""
    return rounded(_run(spark, sf, use_russian_holidays=True, fill_missing_method="Forward fill", fill_group_columns=("item_id",), models_to_train=("NaiveModel",)), 4)


@query(
    sql(
        "user_daily",
        "SELECT CAST(COUNT(DISTINCT item_id) AS BIGINT) AS series, CAST(7 * COUNT(DISTINCT item_id) AS BIGINT) AS forecasts FROM user_daily WHERE y IS NOT NULL",
    )
)
def forecast_run_auto(spark, sf):
    """A run without a grid over many series of a few rows: every one of them is forecast."""
    p = RunParams("ts", "y", "item_id", "MAE", prediction_length=7, models_to_train=("naive", "seasonal_naive"))
    points = forecast.run(fr.user_daily(spark, sf), p).predictions
    return points.agg(F.count_distinct("item_id").alias("series"), F.count("y").alias("forecasts"))


@query()
def forecast_run_chosen(spark, sf):
    """A run that picks between a per-series and a global choice of models, with quantiles."""
    return rounded(_run(spark, sf, models_to_train=("naive", "average", "seasonal_naive"), pycaret_models=("snaive", "polytrend", "exp_smooth")), 4)
