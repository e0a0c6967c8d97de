"""Queries on shaping, filling, regularising and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import with_frames as sql
from catalog.registry import query, rounded
from tidegrid.operators import features, missing, regular, series
from tidegrid.sources import dates
from tidegrid.spec import SeriesSpec

S = SeriesSpec()


def r4(*cols: str) -> str:
    return ", ".join(f"ROUND({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in cols)


# --- shaping ------------------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT orders.*, strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders)
    SELECT o_orderkey, TRY_CAST(day_text AS TIMESTAMP) AS parsed, TRY_CAST(o_orderpriority AS TIMESTAMP) AS priority FROM t"""
)
def safe_timestamps(spark, sf):
    o = fr.table(spark, sf, "orders").withColumn("day_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    both = series.safe_timestamp(series.safe_timestamp(o, "day_text"), "o_orderpriority")
    return both.select("o_orderkey", F.col("day_text").alias("parsed"), F.col("o_orderpriority").alias("priority"))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS invalid FROM orders")
def invalid_timestamps(spark, sf):
    return series.count_invalid(fr.table(spark, sf, "orders"), "o_orderpriority")


@query("SELECT CAST(user_id AS VARCHAR) AS item_id, ts AS timestamp, value AS target, event_id, event_type FROM events")
def to_series(spark, sf):
    e = fr.table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return series.to_series(e, SeriesSpec("user_id", "ts", "value"))


@query(
    sql("nation_daily", "SELECT item_id, arg_min(region, ts) AS region FROM nation_daily GROUP BY 1")
)
def static_table(spark, sf):
    return series.static_table(fr.nation_daily(spark, sf), "item_id", ["region", "absent", "item_id"], "ts")


@query(
    sql(
        "nation_daily",
        """SELECT p.item_id, p.ts, p.y, s.region FROM p LEFT JOIN s ON p.item_id = s.item_id""",
        p="SELECT item_id, ts, y FROM nation_daily",
        s="SELECT item_id, MIN(region) AS region FROM nation_daily GROUP BY 1",
    )
)
def attach_statics(spark, sf):
    n = fr.nation_daily(spark, sf)
    return series.attach_statics(n.drop("region"), series.static_table(n, "item_id", ["region"], "ts"), "item_id")


@query(
    sql("type_daily", "SELECT item_id AS shop, strftime(ts, '%Y-%m-%d %H:%M:%S') AS day, y AS sales FROM type_daily")
)
def forecast_columns(spark, sf):
    preds = fr.type_daily(spark, sf).withColumnsRenamed({"ts": "timestamp", "y": "mean"})
    return series.forecast_columns(preds, SeriesSpec("shop", "day", "sales"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props,
    CAST((SELECT COUNT(*) FROM events) AS BIGINT) AS total_rows FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 10)"""
)
def preview(spark, sf):
    e = fr.table(spark, sf, "events")
    return series.preview(e, ["ts", "event_id"]).select("event_id", "user_id", "event_type", "props", "total_rows")


_THIN = """SELECT item_id, ts, y, event_id FROM n WHERE total <= 50
    OR EXISTS (SELECT 1 FROM range(50) i(k) WHERE CAST(floor(k * (total / 50.0::DOUBLE)) AS BIGINT) = pos)"""
_THIN_N = "SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts, event_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS total FROM event_series"


@query(sql("event_series", _THIN, n=_THIN_N))
def series_thin(spark, sf):
    e = fr.event_series(spark, sf)
    return series.series_thin(e, S.replace(ties=("event_id",))).select("item_id", "ts", "y", "event_id")


@query(sql("event_series", f"SELECT * FROM ({_THIN}) WHERE item_id = 'click'", n=_THIN_N))
def series_by_id(spark, sf):
    e = fr.event_series(spark, sf)
    return series.series_by_id(e, S.replace(ties=("event_id",)), "click").select("item_id", "ts", "y", "event_id")


@query(
    sql(
        "order_series",
        """SELECT item_id, ts, y, o_orderkey, CASE WHEN pos < CAST(floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) AS BIGINT) THEN 'train'
        WHEN pos < CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS part FROM p""",
        p="SELECT *, ROW_NUMBER() OVER (ORDER BY ts, o_orderkey) - 1 AS pos, COUNT(*) OVER () AS n FROM order_series",
    )
)
def split_by_time(spark, sf):
    o = fr.order_series(spark, sf)
    return series.label_by_time(o, S.replace(ties=("o_orderkey",)), test=0.2, val=0.1)


@query(sql("user_daily", "SELECT item_id, CAST(COUNT(*) AS BIGINT) AS n FROM user_daily GROUP BY 1 ORDER BY n DESC, item_id LIMIT 5"))
def top_series(spark, sf):
    return series.top_series(fr.user_daily(spark, sf), S)


@query(
    sql(
        "user_daily",
        "SELECT item_id, ts, bought FROM user_daily WHERE item_id IN (SELECT item_id FROM t)",
        t="SELECT item_id, COUNT(bought) AS n FROM user_daily GROUP BY 1 ORDER BY n DESC, item_id LIMIT 5",
    )
)
def top_series_lines(spark, sf):
    return series.top_series_rows(fr.user_daily(spark, sf).select("item_id", "ts", "bought"), S.replace(target="bought"))


@query(
    sql(
        "hist fresh",
        "SELECT item_id, ts, y, o_orderkey, 'historical' AS source FROM hist UNION ALL SELECT item_id, ts, y, o_orderkey, 'new' FROM fresh",
    )
)
def label_samples(spark, sf):
    return series.label_samples(*fr.samples(spark, sf))


@query(sql("hist fresh", "SELECT DISTINCT CAST(c.o_custkey AS BIGINT) AS o_custkey FROM a c SEMI JOIN b USING (o_custkey)",
           a="SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'",
           b="SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'"))
def common_ids(spark, sf):
    o = fr.table(spark, sf, "orders")
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return series.common_ids(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_custkey")


@query(
    """WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS day_text, event_type, CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS bought_at FROM events)
    SELECT 'bought_at' AS "column", CAST(COUNT(bought_at) AS BIGINT) AS non_null, CAST(COUNT(TRY_CAST(bought_at AS TIMESTAMP)) AS BIGINT) AS parsed, TRUE AS converts FROM t
    UNION ALL SELECT 'day_text', COUNT(day_text), COUNT(TRY_CAST(day_text AS TIMESTAMP)), TRUE FROM t
    UNION ALL SELECT 'event_type', COUNT(event_type), COUNT(TRY_CAST(event_type AS TIMESTAMP)), FALSE FROM t"""
)
def date_report(spark, sf):
    return dates.date_report(_dated(spark, sf).drop("event_id"))


def _dated(spark, sf):
    return fr.table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day_text"), "event_type",
        F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("bought_at"),
    )


@query(
    """SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_text, event_type,
    CASE WHEN event_type = 'purchase' THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END AS bought_at FROM events"""
)
def auto_convert_dates(spark, sf):
    return dates.auto_convert_dates(_dated(spark, sf))


# --- missing values -----------------------------------------------------------------------------------------


def _holes(spark, sf):
    return fr.user_daily(spark, sf).select("item_id", "ts", F.col("bought").alias("y"))


@query(sql("user_daily", "SELECT item_id, ts, COALESCE(bought, 0) AS y FROM user_daily"))
def fill_constant(spark, sf):
    return missing.fill(_holes(spark, sf), "constant", S)


@query(
    sql(
        "user_daily",
        """SELECT item_id, ts, COALESCE(LAST_VALUE(bought IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts),
        FIRST_VALUE(bought IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM user_daily""",
    )
)
def fill_ffill(spark, sf):
    return missing.fill(_holes(spark, sf), "Forward fill", S)


@query(
    sql(
        "user_daily",
        "SELECT item_id, ts, ROUND(COALESCE(bought, AVG(bought) OVER (PARTITION BY item_id)), 6) + 0.0 AS y FROM user_daily",
    )
)
def fill_group_mean(spark, sf):
    return rounded(missing.fill(_holes(spark, sf), "group_mean", S))


@query(sql("user_daily", "SELECT item_id, ts, ROUND(COALESCE(bought, (SELECT AVG(bought) FROM user_daily)), 6) + 0.0 AS y FROM user_daily"))
def fill_table_mean(spark, sf):
    return rounded(missing.fill(_holes(spark, sf), "group_mean", S, group_cols=()))


@query(
    sql(
        "user_daily",
        """SELECT item_id, ts, ROUND(COALESCE(y, v0 + (v1 - v0) * (p - p0) / NULLIF(p1 - p0, 0), v0), 6) + 0.0 AS y FROM w""",
        n="SELECT item_id, ts, bought AS y, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) AS p FROM user_daily",
        w="""SELECT *, LAST_VALUE(y IGNORE NULLS) OVER b AS v0, LAST_VALUE(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
            FIRST_VALUE(y IGNORE NULLS) OVER f AS v1, FIRST_VALUE(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER f AS p1 FROM n
            WINDOW b AS (PARTITION BY item_id ORDER BY ts), f AS (PARTITION BY item_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    )
)
def fill_interpolate(spark, sf):
    return rounded(missing.fill(_holes(spark, sf), "interpolate", S))


@query(
    sql(
        "user_daily",
        """SELECT u.item_id, u.ts, ROUND(COALESCE(u.bought, k.v), 6) + 0.0 AS bought, u.n, u.top
        FROM user_daily u LEFT JOIN (SELECT item_id, ts, AVG(v) AS v FROM near WHERE r <= 5 GROUP BY 1, 2) k ON u.item_id = k.item_id AND u.ts = k.ts""",
        near="""SELECT q.item_id, q.ts, d.bought AS v, ROW_NUMBER() OVER (PARTITION BY q.item_id, q.ts
            ORDER BY sqrt(((d.n - q.n) * (d.n - q.n) + (d.top - q.top) * (d.top - q.top)) * 1.5::DOUBLE), d.ts) AS r
            FROM user_daily q JOIN user_daily d ON q.item_id = d.item_id WHERE q.bought IS NULL AND d.bought IS NOT NULL""",
    )
)
def fill_knn(spark, sf):
    u = fr.user_daily(spark, sf).select("item_id", "ts", "bought", "n", "top")
    return rounded(missing.fill(u, "KNN imputer", S))


# --- regular grids ------------------------------------------------------------------------------------------


@query(sql("user_regular", "SELECT * FROM user_regular"))
def regularize_daily(spark, sf):
    return regular.regularize(fr.user_daily(spark, sf).select("item_id", "ts", "y"), S, "D")


@query(sql("cust_regular", "SELECT * FROM cust_regular"))
def regularize_monthly(spark, sf):
    return regular.regularize(fr.customer_monthly(spark, sf), S, "M")


@query(
    sql(
        "user_daily user_bounds",
        """SELECT g.item_id, g.ts, LAST_VALUE(u.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y
        FROM g LEFT JOIN user_daily u ON g.item_id = u.item_id AND g.ts = u.ts""",
        g="""SELECT b.item_id, s.ts FROM user_bounds b, LATERAL (SELECT unnest(generate_series(
            b.mn + to_days(CAST((7 - isodow(b.mn)) AS INTEGER)), b.mx, INTERVAL 7 DAY)) AS ts) s""",
    )
)
def regularize_weekly(spark, sf):
    return regular.regularize(fr.user_daily(spark, sf).select("item_id", "ts", "y"), S, "W")


_QUARTERLY = sql(
    "customer_monthly cust_bounds",
    """SELECT g.item_id, g.ts, LAST_VALUE(c.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y
    FROM g LEFT JOIN customer_monthly c ON g.item_id = c.item_id AND g.ts = c.ts""",
    g="""SELECT item_id, ts FROM (SELECT b.item_id, b.mn, b.mx, CAST(last_day(s.q + INTERVAL 2 MONTH) AS TIMESTAMP) AS ts FROM cust_bounds b,
        LATERAL (SELECT unnest(generate_series(date_trunc('quarter', b.mn), date_trunc('quarter', b.mx), INTERVAL 3 MONTH)) AS q) s) WHERE ts <= mx""",
)


@query(_QUARTERLY)
def regularize_quarterly(spark, sf):
    return regular.regularize(fr.customer_monthly(spark, sf), S, "Q")


_SNAPPED = sql(
    "",
    """SELECT g.item_id, g.ts, LAST_VALUE(p.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y
    FROM g LEFT JOIN (SELECT item_id, CAST(last_day(ts) AS TIMESTAMP) AS ts, arg_max(y, ts) AS y FROM p GROUP BY 1, 2) p ON p.item_id = g.item_id AND p.ts = g.ts""",
    p="SELECT CAST(o_custkey AS VARCHAR) AS item_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, CAST(COUNT(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2",
    g="""SELECT item_id, CAST(last_day(unnest(generate_series(date_trunc('month', MIN(ts)), date_trunc('month', MAX(ts)), INTERVAL 1 MONTH))) AS TIMESTAMP) AS ts FROM p GROUP BY 1""",
)


@query(_SNAPPED)
def regularize_snapped(spark, sf):
    """Orders on any day of the month, moved to the end of their month; of several the latest stays."""
    o = fr.table(spark, sf, "orders")
    p = o.groupBy(F.col("o_custkey").cast("string").alias("item_id"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return regular.regularize(p, S, "M", snap=True)


def _stepped(unit: str, freq: str):
    """Events per type and hour or minute, on their grid: the statement, and the query."""
    statement = sql(
        "",
        """SELECT g.item_id, g.ts, LAST_VALUE(e.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y
        FROM g LEFT JOIN e ON g.item_id = e.item_id AND g.ts = e.ts""",
        e=f"SELECT event_type AS item_id, date_trunc('{unit}', ts) AS ts, CAST(COUNT(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2",
        g=f"SELECT item_id, unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 1 {unit})) AS ts FROM e GROUP BY 1",
    )

    def run(spark, sf):
        e = fr.table(spark, sf, "events")
        counts = e.groupBy(F.col("event_type").alias("item_id"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))
        return regular.regularize(counts, S, freq)

    run.__name__ = f"regularize_by_{unit}"
    return query(statement)(run)


regularize_by_hour, regularize_by_minute = _stepped("hour", "H"), _stepped("minute", "T")


@query(
    sql(
        "customer_monthly",
        """SELECT g.item_id, g.ts, LAST_VALUE(c.y IGNORE NULLS) OVER (PARTITION BY g.item_id ORDER BY g.ts) AS y FROM g LEFT JOIN c ON g.item_id = c.item_id AND g.ts = c.ts""",
        c="SELECT item_id, CAST(last_day(date_trunc('year', ts) + INTERVAL 11 MONTH) AS TIMESTAMP) AS ts, SUM(y) AS y FROM customer_monthly GROUP BY 1, 2",
        g="SELECT item_id, CAST(last_day(unnest(generate_series(date_trunc('month', MIN(ts)), MAX(ts), INTERVAL 1 YEAR))) AS TIMESTAMP) AS ts FROM c GROUP BY 1",
    )
)
def regularize_yearly(spark, sf):
    c = fr.customer_monthly(spark, sf)
    ends = F.make_date(F.year("ts"), F.lit(12), F.lit(31)).cast("timestamp_ntz")
    return regular.regularize(c.groupBy("item_id", ends.alias("ts")).agg(F.sum("y").alias("y")), S, "Y")


@query(
    sql(
        "",
        """SELECT g.ts, LAST_VALUE(o.y IGNORE NULLS) OVER (ORDER BY g.ts) AS y FROM g LEFT JOIN o ON g.ts = o.ts""",
        o="SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, CAST(COUNT(*) AS DOUBLE) AS y FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
        g="SELECT unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 1 DAY)) AS ts FROM o",
    )
)
def regularize_one_series(spark, sf):
    """A table without an id is one series."""
    o = fr.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    daily = o.groupBy(F.to_date("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return regular.regularize(daily, S.replace(id=None), "D")


_PROFILE = """SELECT item_id, COUNT(*) AS n, date_diff('day', MIN(ts), MAX(ts)) + 1 AS len FROM user_daily GROUP BY 1"""


@query(sql("user_daily", "SELECT item_id, CAST(n AS BIGINT) AS n_rows, CAST(len AS BIGINT) AS grid_rows, len > n AS extended, len < 29 AS short FROM p", p=_PROFILE))
def grid_profile(spark, sf):
    return regular.grid_profile(fr.user_daily(spark, sf), S, "D", 14).drop("first", "last")


_SHORT = "SELECT *, COUNT(*) OVER (PARTITION BY item_id) AS len FROM user_regular"


@query(sql("user_regular", "SELECT item_id, ts, y, len < 29 AS short FROM c", c=_SHORT))
def split_short(spark, sf):
    grid = regular.regularize(fr.user_daily(spark, sf).select("item_id", "ts", "y"), S, "D")
    kept, short = regular.split_short(grid, S, 14)
    return kept.withColumn("short", F.lit(False)).unionByName(short.withColumn("short", F.lit(True)))


@query(
    sql(
        "user_regular",
        """SELECT item_id, last + to_days(CAST(s.k AS INTEGER)) AS ts, y FROM (SELECT item_id, MAX(ts) AS last, arg_max(y, ts) AS y, COUNT(*) AS len FROM user_regular GROUP BY 1) t,
        range(1, 15) s(k) WHERE len < 29""",
    )
)
def naive_fallback(spark, sf):
    grid = regular.regularize(fr.user_daily(spark, sf).select("item_id", "ts", "y"), S, "D")
    return regular.naive_fallback(grid, S, 14, "D")


@query(
    sql(
        "user_daily",
        """SELECT item_id, 'short' AS kind, 'Series ' || item_id || ' has too few rows for a full forecast; a naive forecast was made.' AS message FROM p WHERE len < 29
        UNION ALL SELECT item_id, 'extended', 'Series ' || item_id || ' was extended to frequency D by forward fill.' FROM p WHERE len >= 29 AND len > n""",
        p=_PROFILE,
    )
)
def run_messages(spark, sf):
    return regular.run_messages(fr.user_daily(spark, sf), S, "D", 14)


@query(
    sql(
        "user_daily user_bounds",
        """SELECT u.item_id, CAST(COUNT(*) AS BIGINT) AS dropped FROM user_daily u JOIN user_bounds b USING (item_id) WHERE isodow(u.ts) <> 7 GROUP BY 1""",
    )
)
def off_grid_rows(spark, sf):
    return regular.off_grid_rows(fr.user_daily(spark, sf), S, "W")


# --- features -----------------------------------------------------------------------------------------------

# New Year, Christmas, Women's, Labour, Victory and Russia Day in all years; the others by the year of the law.
_HOLIDAY = """(strftime(ts, '%m-%d') IN ('01-01', '01-02', '01-07', '03-08', '05-01', '05-09', '06-12')
    OR (year(ts) >= 2002 AND strftime(ts, '%m-%d') = '02-23')
    OR (year(ts) > 2004 AND strftime(ts, '%m-%d') BETWEEN '01-03' AND '01-05')
    OR (year(ts) > 2012 AND strftime(ts, '%m-%d') IN ('01-06', '01-08'))
    OR strftime(ts, '%m-%d') = CASE WHEN year(ts) < 2005 THEN '11-07' ELSE '11-04' END
    OR (year(ts) < 2005 AND strftime(ts, '%m-%d') = '05-02')
    OR (year(ts) BETWEEN 1994 AND 2004 AND strftime(ts, '%m-%d') = '12-12'))"""


@query(
    sql(
        "nation_daily",
        f"SELECT item_id, ts, y, CASE WHEN {_HOLIDAY} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS russian_holiday FROM nation_daily",
    )
)
def holiday_flag(spark, sf):
    return features.add_holiday(fr.nation_daily(spark, sf).drop("region"), "ts")


@query(
    sql(
        "nation_daily",
        f"""SELECT n.item_id, n.ts, CASE WHEN {_HOLIDAY} OR t.d IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS russian_holiday
        FROM nation_daily n LEFT JOIN t ON CAST(n.ts AS DATE) = t.d""",
        t="SELECT CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY 1 HAVING COUNT(*) >= (SELECT 2 * COUNT(*) / COUNT(DISTINCT o_orderdate) FROM orders)",
    )
)
def holiday_flag_transferred(spark, sf):
    """Days off taken from a table: here the days with at least twice the usual number of orders."""
    o = fr.table(spark, sf, "orders")
    usual = o.agg((F.count(F.lit(1)) * 2.0 / F.count_distinct("o_orderdate")).alias("usual"))
    busy = o.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(usual)).where(F.col("n") >= F.col("usual"))
    n = fr.nation_daily(spark, sf).select("item_id", "ts")
    return features.add_holiday(n, "ts", calendar=busy.select(F.col("o_orderdate").alias("holiday")))


@query(
    """SELECT event_id, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day,
    CAST(isodow(ts) - 1 AS BIGINT) AS dayofweek, CAST(quarter(ts) AS BIGINT) AS quarter, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute,
    CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend, CAST(CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END AS BIGINT) AS is_month_start,
    CAST(CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 1 ELSE 0 END AS BIGINT) AS is_month_end,
    ROUND(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS sin_month, ROUND(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS cos_month,
    ROUND(sin(2 * pi() * day(ts) / 31), 6) + 0.0 AS sin_day, ROUND(cos(2 * pi() * day(ts) / 31), 6) + 0.0 AS cos_day,
    ROUND(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS sin_dayofweek, ROUND(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS cos_dayofweek FROM events"""
)
def time_features(spark, sf):
    from tidegrid.functions.calendar import TIME_FEATURES

    e = fr.table(spark, sf, "events").select("event_id", "ts")
    return rounded(features.add_time_features(e, "ts", list(TIME_FEATURES)).drop("ts"))


@query(
    sql(
        "user_daily",
        "SELECT item_id, ts, " + ", ".join(f"LAG(y, {k}) OVER w AS y_lag_{k}" for k in (1, 7, 14, 28)) + " FROM user_daily WINDOW w AS (PARTITION BY item_id ORDER BY ts)",
    )
)
def lags(spark, sf):
    return features.add_lags(fr.user_daily(spark, sf).select("item_id", "ts", "y"), S).drop("y")


@query(
    sql(
        "type_daily",
        "SELECT item_id, ts, LAG(y, 1) OVER w AS y_lag_1, LAG(y, 7) OVER w AS y_lag_7 FROM type_daily WINDOW w AS (ORDER BY ts, item_id)",
    )
)
def lags_whole_table(spark, sf):
    return features.add_lags(fr.type_daily(spark, sf), SeriesSpec(id=None, ties=("item_id",)), (1, 7)).drop("y")


_ROLL_FN = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}


@query(
    sql(
        "user_daily",
        "SELECT item_id, ts, "
        + ", ".join(
            f"ROUND({_ROLL_FN[f]}(bought) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) + 0.0 AS y_rolling_{w}_{f}"
            for w in (7, 14, 30)
            for f in _ROLL_FN
        )
        + " FROM user_daily",
    )
)
def rolling(spark, sf):
    return rounded(features.add_rolling(_holes(spark, sf), S).drop("y"))


def _transform_sql(expr: str) -> str:
    return f"SELECT event_id, ROUND({expr}, 6) + 0.0 AS value FROM events"


def _transformed(spark, sf, kind, lam=None):
    e = fr.table(spark, sf, "events").select("event_id", "value")
    return rounded(features.transform_target(e, "value", kind, lam)[0])


@query(_transform_sql("CASE WHEN value > -1 THEN ln(value + 1) END"))
def transform_log(spark, sf):
    return _transformed(spark, sf, "log")


@query(_transform_sql("CASE WHEN value >= 0 THEN sqrt(value) END"))
def transform_sqrt(spark, sf):
    return _transformed(spark, sf, "sqrt")


@query(
    """WITH s AS (SELECT CASE WHEN MIN(value) <= 0 THEN abs(MIN(value)) + 1 ELSE 0 END AS shift FROM events)
    SELECT event_id, ROUND((pow(value + shift, 0.5) - 1) / 0.5::DOUBLE, 6) + 0.0 AS value FROM events, s"""
)
def transform_box_cox(spark, sf):
    return _transformed(spark, sf, "box-cox", 0.5)


@query(
    _transform_sql(
        "CASE WHEN value >= 0 THEN (pow(value + 1, 0.5) - 1) / 0.5::DOUBLE ELSE -(pow(1 - value, 1.5) - 1) / 1.5::DOUBLE END"
    )
)
def transform_yeo_johnson(spark, sf):
    return _transformed(spark, sf, "yeo-johnson", 0.5)


def _closing_in(levels: int) -> str:
    """Steps ``g1`` to ``g<levels>``: the best of 33 lambdas from -2 to 2, then of 33 between the neighbours of the best so far."""
    best = """g{k} AS (SELECT lam FROM (SELECT {at} AS lam, VAR_POP(CASE WHEN {at} = 0 THEN ln(m) ELSE (pow(m, {at}) - 1) / {at} END) AS v
        FROM x, (SELECT UNNEST(range(33)) AS i) AS p{before} GROUP BY 1), t ORDER BY (lam - 1) * s - n / 2 * ln(v) DESC, lam LIMIT 1)"""
    steps = [best.format(k=1, at="(-2 + i / 8.0::DOUBLE)", before="")]
    for k in range(2, levels + 1):
        at = f"(b.lam + (i - 16) * {0.125 / 16 ** (k - 1)!r}::DOUBLE)"
        steps.append(best.format(k=k, at=at, before=f", g{k - 1} AS b"))
    return ", ".join(steps)


@query(
    f"""WITH sh AS (SELECT CASE WHEN MIN(value) <= 0 THEN abs(MIN(value)) + 1 ELSE 0 END AS shift FROM events),
    x AS (SELECT event_id, value, value + shift AS m FROM events, sh), t AS (SELECT COUNT(m) AS n, SUM(ln(m)) AS s FROM x), {_closing_in(6)}
    SELECT event_id, ROUND(CASE WHEN lam = 0 THEN ln(m) ELSE (pow(m, lam) - 1) / lam END, 3) + 0.0 AS value, ROUND(value, 3) + 0.0 AS back, ROUND(lam, 3) + 0.0 AS lambda FROM x, g6"""
)
def transform_fitted(spark, sf):
    """Box-Cox with the fitted lambda, and back again."""
    e = fr.table(spark, sf, "events").select("event_id", "value")
    there, params = features.transform_target(e, "value", "box-cox")
    back = features.inverse_target(there, "value", params).withColumnRenamed("value", "back")
    return rounded(there.join(back, "event_id").withColumn("lambda", F.lit(params.lam)), 3)


def _round_trip(spark, sf, kind, lam=None):
    e = fr.table(spark, sf, "events").select("event_id", "value")
    there, params = features.transform_target(e, "value", kind, lam)
    return rounded(features.inverse_target(there, "value", params))


_PLAIN = "SELECT event_id, ROUND(value, 6) + 0.0 AS value FROM events"


@query(_PLAIN)
def inverse_log(spark, sf):
    return _round_trip(spark, sf, "log")


@query(_PLAIN)
def inverse_sqrt(spark, sf):
    return _round_trip(spark, sf, "sqrt")


@query(_PLAIN)
def inverse_box_cox(spark, sf):
    return _round_trip(spark, sf, "box-cox", 0.5)


@query(_PLAIN)
def inverse_yeo_johnson(spark, sf):
    return _round_trip(spark, sf, "yeo-johnson", 0.5)
