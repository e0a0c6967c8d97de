"""Series derived from the given tables, once as Spark frames and once as SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(c: str):
    return F.to_date(c).cast("timestamp_ntz")


def type_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Value per event type and day: few long series without holes."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("item_id"), _day("ts").alias("ts")).agg(F.round(F.sum("value"), 2).alias("y"))


def user_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Value per user and day: many series with missing days; ``bought`` is NULL on days without a purchase."""
    e = table(spark, sf, "events")
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return e.groupBy(F.col("user_id").cast("string").alias("item_id"), _day("ts").alias("ts")).agg(
        F.round(F.sum("value"), 2).alias("y"),
        F.round(F.sum(bought), 2).alias("bought"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.round(F.max("value"), 2).alias("top"),
    )


def priority_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Order value per priority and month end."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("item_id"), F.last_day("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("y")
    )


def customer_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per customer and month end: very many short, intermittent series."""
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.col("o_custkey").cast("string").alias("item_id"), F.last_day("o_orderdate").cast("timestamp_ntz").alias("ts")
    ).agg(F.count(F.lit(1)).cast("double").alias("y"))


def nation_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Order value per nation and day, with the nation's region as a static column."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    return j.groupBy(F.col("n_name").alias("item_id"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("y")
    )


def order_series(spark: SparkSession, sf: str) -> DataFrame:
    """Single orders as observations of their priority's series."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"), "o_orderkey"
    )


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    """Single events as observations of their type's series."""
    return table(spark, sf, "events").select(F.col("event_type").alias("item_id"), "ts", F.col("value").alias("y"), "event_id", "user_id")


def samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and from 2000 on."""
    o = order_series(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return o.where(F.col("ts") < cut), o.where(F.col("ts") >= cut)


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), disc.alias("disc_price"),
        (disc * (1 + F.col("l_tax"))).alias("charge"), F.col("l_tax").alias("tax"),
    )


SQL = {
    "type_daily": "SELECT event_type AS item_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, ROUND(SUM(value), 2) AS y FROM events GROUP BY 1, 2",
    "user_daily": """SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts,
        ROUND(SUM(value), 2) AS y, ROUND(SUM(CASE WHEN event_type = 'purchase' THEN value END), 2) AS bought,
        CAST(COUNT(*) AS DOUBLE) AS n, ROUND(MAX(value), 2) AS top FROM events GROUP BY 1, 2""",
    "priority_monthly": "SELECT o_orderpriority AS item_id, CAST(last_day(o_orderdate) AS TIMESTAMP) AS ts, ROUND(SUM(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2",
    "customer_monthly": "SELECT CAST(o_custkey AS VARCHAR) AS item_id, CAST(last_day(o_orderdate) AS TIMESTAMP) AS ts, CAST(COUNT(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2",
    "nation_daily": """SELECT n_name AS item_id, r_name AS region, o_orderdate AS ts, ROUND(SUM(o_totalprice), 2) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "order_series": "SELECT o_orderpriority AS item_id, o_orderdate AS ts, o_totalprice AS y, o_orderkey FROM orders",
    "event_series": "SELECT event_type AS item_id, ts, value AS y, event_id, user_id FROM events",
    "hist": "SELECT o_orderpriority AS item_id, o_orderdate AS ts, o_totalprice AS y, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'",
    "fresh": "SELECT o_orderpriority AS item_id, o_orderdate AS ts, o_totalprice AS y, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
    "line_features": """SELECT l_quantity AS qty, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS disc_price,
        l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_tax AS tax FROM lineitem""",
    # Steps that several queries share.
    "user_bounds": "SELECT item_id, MIN(ts) AS mn, MAX(ts) AS mx FROM user_daily GROUP BY 1",
    "user_grid": """SELECT b.item_id, g.ts FROM user_bounds b, LATERAL (SELECT unnest(generate_series(b.mn, b.mx, INTERVAL 1 DAY)) AS ts) g""",
    "user_regular": """SELECT g.item_id, g.ts, LAST_VALUE(u.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y
        FROM user_grid g LEFT JOIN user_daily u ON g.item_id = u.item_id AND g.ts = u.ts""",
    "cust_bounds": "SELECT item_id, MIN(ts) AS mn, MAX(ts) AS mx FROM customer_monthly GROUP BY 1",
    "cust_grid": """SELECT b.item_id, CAST(last_day(g.m) AS TIMESTAMP) AS ts FROM cust_bounds b,
        LATERAL (SELECT unnest(generate_series(date_trunc('month', b.mn), date_trunc('month', b.mx), INTERVAL 1 MONTH)) AS m) g""",
    "cust_regular": """SELECT g.item_id, g.ts, LAST_VALUE(c.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y
        FROM cust_grid g LEFT JOIN customer_monthly c ON g.item_id = c.item_id AND g.ts = c.ts""",
    "cust_zero": """SELECT g.item_id, g.ts, COALESCE(c.y, 0) AS y
        FROM cust_grid g LEFT JOIN customer_monthly c ON g.item_id = c.item_id AND g.ts = c.ts""",
    "month_bounds": "SELECT item_id, MIN(ts) AS mn, MAX(ts) AS mx FROM priority_monthly GROUP BY 1",
}

_NEEDS = {
    "user_bounds": ["user_daily"], "user_grid": ["user_bounds"], "user_regular": ["user_grid"],
    "cust_bounds": ["customer_monthly"], "cust_grid": ["cust_bounds"], "cust_regular": ["cust_grid"],
    "cust_zero": ["cust_grid"], "month_bounds": ["priority_monthly"],
}


def with_frames(names: str, body: str, **steps: str) -> str:
    """A statement with the named frames, then the extra ``steps``, as common table expressions."""
    ordered: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in ordered:
            ordered.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({SQL[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in steps.items()]
    recursive = "RECURSIVE " if "rec" in steps else ""
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body
