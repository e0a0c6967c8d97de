"""Queries on data quality and statistical diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import with_frames as sql
from catalog.registry import eliminated, query, rounded
from tidegrid.operators import charts, correlation, drift, quality, seasonal, series
from tidegrid.spec import SeriesSpec

S = SeriesSpec()
EVENTS = SeriesSpec("event_type", "ts", "value")

_STEPS = """SELECT item_id, step, COUNT(*) AS n FROM (SELECT item_id, epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY item_id ORDER BY ts)) AS step
    FROM (SELECT DISTINCT item_id, ts FROM {0})) WHERE step IS NOT NULL GROUP BY 1, 2"""
_MODE = "SELECT step AS mode FROM steps GROUP BY step ORDER BY SUM(n) DESC, step LIMIT 1"
_GAPS = """SELECT MAX(mode) / 1000000.0::DOUBLE AS step_seconds, CAST(COALESCE(SUM(CASE WHEN step > mode + 1000000 THEN n END), 0) AS BIGINT) AS gaps,
    CAST(COUNT(DISTINCT CASE WHEN step > mode + 1000000 THEN item_id END) AS BIGINT) AS series FROM steps, usual"""
_BOUNDS = "SELECT quantile_cont({1}, 0.25) AS q1, quantile_cont({1}, 0.75) AS q3 FROM {0}"
_OUT = "({0} < q1 - 1.5 * (q3 - q1) OR {0} > q3 + 1.5 * (q3 - q1))"


@query(
    sql(
        "user_daily",
        """SELECT 'warning' AS severity, code, value, ROUND(detail, 6) + 0.0 AS detail FROM (
        SELECT 'missing target' AS code, CAST(SUM(CASE WHEN bought IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS value, SUM(CASE WHEN bought IS NULL THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*) AS detail FROM user_daily
        UNION ALL SELECT 'outliers', CAST(SUM(CASE WHEN bad THEN 1 ELSE 0 END) AS DOUBLE), SUM(CASE WHEN bad THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*) FROM o
        UNION ALL SELECT 'gaps', CAST(gaps AS DOUBLE), CAST(series AS DOUBLE) FROM g) WHERE value > 0""",
        b=_BOUNDS.format("user_daily", "bought"),
        o=f"SELECT {_OUT.format('bought')} AS bad FROM user_daily, b",
        steps=_STEPS.format("user_daily"),
        usual=_MODE,
        g=_GAPS,
    )
)
def validate(spark, sf):
    return rounded(quality.validate(fr.user_daily(spark, sf), S.replace(target="bought")))


@query("SELECT 'error' AS severity, 'invalid dates: o_orderpriority' AS code, CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS detail FROM orders")
def validate_bad_dates(spark, sf):
    return quality.validate(fr.table(spark, sf, "orders"), SeriesSpec("o_custkey", "o_orderpriority", "o_totalprice"))


@query(
    f"""WITH b AS ({_BOUNDS.format("events", "value")})
    SELECT CAST(COUNT(*) AS BIGINT) AS rows_count, MIN(value) AS target_min, MAX(value) AS target_max, ROUND(AVG(value), 6) + 0.0 AS target_mean,
    ROUND(quantile_cont(value, 0.5), 6) + 0.0 AS target_median, ROUND(stddev_samp(value), 6) + 0.0 AS target_std,
    CAST(SUM(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_dt, CAST(SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_target,
    CAST(COUNT(DISTINCT event_type) AS BIGINT) AS unique_ids, CAST(SUM(CASE WHEN {_OUT.format("value")} THEN 1 ELSE 0 END) AS BIGINT) AS outliers_count FROM events, b"""
)
def profile(spark, sf):
    return rounded(quality.profile(fr.table(spark, sf, "events"), EVENTS))


@query(sql("user_daily", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing FROM user_daily" for c in ("item_id", "ts", "y", "bought", "n", "top")) + ")"))
def missing_counts(spark, sf):
    return quality.missing_counts(fr.user_daily(spark, sf))


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG({c}), 4) + 0.0 AS mean, ROUND(stddev_samp({c}), 4) + 0.0 AS std, ROUND(CAST(MIN({c}) AS DOUBLE), 4) + 0.0 AS min,
    ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) + 0.0 AS p25, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) + 0.0 AS p50, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) + 0.0 AS p75, ROUND(CAST(MAX({c}) AS DOUBLE), 4) + 0.0 AS max FROM lineitem"""
    for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def describe(spark, sf):
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(quality.describe(fr.table(spark, sf, "lineitem").select(*cols)), 4)


@query(
    f"""WITH b AS ({_BOUNDS.format("events", "value")}), o AS (SELECT {_OUT.format("value")} AS bad FROM events, b)
    SELECT CAST(SUM(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS outliers, ROUND(SUM(CASE WHEN bad THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*), 6) + 0.0 AS percent FROM o"""
)
def target_outliers(spark, sf):
    return rounded(quality.target_outliers(fr.table(spark, sf, "events"), "value"))


def _flags(spark, sf, method, per_id):
    e = fr.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return quality.flag_outliers(e, EVENTS, method, per_id).select("event_id", "value", "is_outlier")


@query(
    f"""WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_id, value, {_OUT.format("value")} AS is_outlier FROM events JOIN b USING (event_type)"""
)
def outliers_iqr(spark, sf):
    return _flags(spark, sf, "iqr", True)


@query(f"WITH b AS ({_BOUNDS.format('events', 'value')}) SELECT event_id, value, {_OUT.format('value')} AS is_outlier FROM events, b")
def outliers_iqr_global(spark, sf):
    return _flags(spark, sf, "iqr", False)


@query(
    """WITH b AS (SELECT event_type, AVG(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
    SELECT event_id, value, abs(value - m) / s > 3 AS is_outlier FROM events JOIN b USING (event_type)"""
)
def outliers_zscore(spark, sf):
    return _flags(spark, sf, "zscore", True)


@query("WITH b AS (SELECT AVG(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, value, abs(value - m) / s > 3 AS is_outlier FROM events, b")
def outliers_zscore_global(spark, sf):
    return _flags(spark, sf, "zscore", False)


@query(sql("user_daily", "SELECT * FROM g", steps=_STEPS.format("user_daily"), usual=_MODE, g=_GAPS))
def find_gaps(spark, sf):
    return quality.find_gaps(fr.user_daily(spark, sf), S)


@query(
    sql(
        "",
        """SELECT MAX(mode) / 1000000.0::DOUBLE AS step_seconds, CAST(COALESCE(SUM(CASE WHEN step > mode + 1000000 THEN n END), 0) AS BIGINT) AS gaps,
        CAST(MAX(CASE WHEN step > mode + 1000000 THEN 1 ELSE 0 END) AS BIGINT) AS series FROM steps, usual""",
        steps="""SELECT step, COUNT(*) AS n FROM (SELECT epoch_us(d) - epoch_us(LAG(d) OVER (ORDER BY d)) AS step FROM (SELECT DISTINCT o_orderdate AS d FROM orders)) WHERE step IS NOT NULL GROUP BY 1""",
        usual=_MODE,
    )
)
def find_gaps_single(spark, sf):
    return quality.find_gaps(fr.table(spark, sf, "orders"), SeriesSpec(None, "o_orderdate", "o_totalprice"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS item_id, o_orderdate AS ts, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicate_keys(spark, sf):
    o = fr.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("item_id"), F.col("o_orderdate").alias("ts"))
    return quality.duplicate_keys(o, S)


_CELLS = "SELECT ts, event_id, (CASE WHEN bought IS NULL THEN 1 ELSE 0 END) + (CASE WHEN note IS NULL OR note = '' THEN 1 ELSE 0 END) AS m FROM e"
_NOTED = "SELECT event_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS bought, CASE WHEN event_type = 'error' THEN '' WHEN event_type <> 'view' THEN props END AS note FROM events"


def _noted(spark, sf):
    e = fr.table(spark, sf, "events")
    kind = F.col("event_type")
    note = F.when(kind == "error", "").when(kind != "view", F.col("props"))
    return e.select("event_id", F.col("ts"), F.when(kind == "purchase", F.col("value")).alias("bought"), note.alias("note"))


@query(
    sql("", "SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(m) AS BIGINT) AS missing, ROUND(SUM(m) * 100.0::DOUBLE / (COUNT(*) * 4), 6) + 0.0 AS percent FROM c", e=_NOTED, c=_CELLS)
)
def missing_summary(spark, sf):
    return rounded(quality.missing_summary(_noted(spark, sf)))


@query(
    sql(
        "",
        """SELECT CAST(i.k + 1 AS BIGINT) AS bin, CAST(i.k + 1 AS VARCHAR) AS name, CAST(COALESCE(SUM(m), 0) AS BIGINT) AS missing, CAST(COUNT(m) AS BIGINT) AS total
        FROM range(12) i(k) LEFT JOIN p ON p.b = i.k GROUP BY i.k""",
        e=_NOTED,
        c=_CELLS,
        p="SELECT m, (ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1) // CAST(ceil(COUNT(*) OVER () / 12.0) AS BIGINT) AS b FROM c",
    )
)
def missing_profile(spark, sf):
    return rounded(quality.missing_profile(_noted(spark, sf), S.replace(ties=("event_id",))))


@query(
    sql(
        "",
        """SELECT CAST(i.k + 1 AS BIGINT) AS bin, COALESCE(arg_min(t, (event_time, event_id)) || ' - ' || arg_max(t, (event_time, event_id)), CAST(i.k + 1 AS VARCHAR)) AS name,
        CAST(COALESCE(SUM(m), 0) AS BIGINT) AS missing, CAST(COUNT(m) AS BIGINT) AS total FROM range(12) i(k) LEFT JOIN p ON p.b = i.k GROUP BY i.k""",
        e=_NOTED,
        p="""SELECT ts AS event_time, event_id, strftime(ts, '%Y-%m-%d') AS t, (CASE WHEN bought IS NULL THEN 1 ELSE 0 END) + (CASE WHEN note IS NULL OR note = '' THEN 1 ELSE 0 END) AS m,
            (ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1) // CAST(ceil(COUNT(*) OVER () / 12.0) AS BIGINT) AS b FROM e""",
    )
)
def missing_profile_dated(spark, sf):
    named = _noted(spark, sf).withColumnRenamed("ts", "event_time")
    return rounded(quality.missing_profile(named, SeriesSpec(None, "event_time", "bought", ties=("event_id",))))


# --- season and autocorrelation -----------------------------------------------------------------------------

_PATTERN = 'SELECT \'{0}\' AS kind, {1} AS "key", ROUND(AVG(y), 4) + 0.0 AS mean, ROUND(quantile_cont(y, 0.5), 4) + 0.0 AS median, ROUND(stddev_samp(y), 4) + 0.0 AS std FROM nation_daily GROUP BY 2'
_NAMES = "list_extract(['" + "','".join(seasonal.WEEKDAYS) + "'], CAST(isodow(ts) AS INTEGER))"


@query(
    sql(
        "nation_daily",
        " UNION ALL ".join([_PATTERN.format("month", "CAST(month(ts) AS VARCHAR)"), _PATTERN.format("weekday", _NAMES), _PATTERN.format("quarter", "CAST(quarter(ts) AS VARCHAR)")]),
    )
)
def seasonal_patterns(spark, sf):
    return rounded(seasonal.seasonal_patterns(fr.nation_daily(spark, sf), S), 4)


_CENTRED = "SELECT item_id, y - AVG(y) OVER (PARTITION BY item_id) AS c, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) AS p, COUNT(*) OVER (PARTITION BY item_id) AS n FROM user_daily"
_ACF = """SELECT a.item_id, CAST(k.lag AS BIGINT) AS lag, ROUND(SUM(a.c * b.c) / ANY_VALUE(t.v), 6) + 0.0 AS acf
    FROM c a CROSS JOIN range(31) k(lag) JOIN c b ON a.item_id = b.item_id AND b.p = a.p - k.lag JOIN t ON t.item_id = a.item_id WHERE k.lag < a.n GROUP BY 1, 2"""
_TOTAL = "SELECT item_id, SUM(c * c) AS v FROM c GROUP BY 1"


@query(sql("user_daily", _ACF, c=_CENTRED, t=_TOTAL))
def acf(spark, sf):
    return rounded(seasonal.acf(fr.user_daily(spark, sf), S))


@query(sql("user_daily", f"SELECT * FROM ({_ACF}) WHERE item_id = (SELECT item_id FROM user_daily GROUP BY 1 ORDER BY COUNT(*) DESC, item_id LIMIT 1)", c=_CENTRED, t=_TOTAL))
def acf_longest(spark, sf):
    return rounded(seasonal.acf(fr.user_daily(spark, sf), S, longest_only=True))


#: Durbin-Levinson on the autocovariances of each series, lag by lag.
_LEVINSON = """SELECT item_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS phi, cov[1] AS err, CAST(1 AS DOUBLE) AS pacf FROM co
    UNION ALL SELECT item_id, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), last), err * (1 - last * last), last
    FROM (SELECT r.*, (cov[k + 2] - COALESCE(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * cov[k + 2 - j])), 0)) / err AS last
        FROM rec r JOIN co USING (item_id) WHERE k < lags AND err <> 0)"""


@query(
    sql(
        "user_daily",
        "SELECT item_id, k AS lag, ROUND(pacf, 6) + 0.0 AS pacf FROM rec",
        c=_CENTRED,
        cv="SELECT a.item_id, k.lag, SUM(a.c * b.c) / (ANY_VALUE(a.n) - k.lag) AS v, ANY_VALUE(a.n) AS n FROM c a CROSS JOIN range(31) k(lag) JOIN c b ON a.item_id = b.item_id AND b.p = a.p - k.lag GROUP BY 1, 2",
        co="SELECT item_id, list(v ORDER BY lag) AS cov, greatest(least(30, ANY_VALUE(n) // 2 - 1), 0) AS lags FROM cv GROUP BY 1",
        rec=_LEVINSON,
    )
)
def pacf(spark, sf):
    return rounded(seasonal.pacf(fr.user_daily(spark, sf), S))


@query(
    sql(
        "customer_monthly",
        """SELECT item_id, CAST(step // 86400000000 AS BIGINT) AS step_days, CAST(CASE WHEN step // 86400000000 = 1 THEN 7 WHEN step // 86400000000 = 7 THEN 52 ELSE 12 END AS BIGINT) AS period
        FROM (SELECT item_id, step, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY n DESC, step) AS r FROM steps) WHERE r = 1""",
        steps=_STEPS.format("customer_monthly"),
    )
)
def detect_period(spark, sf):
    return rounded(seasonal.detect_period(fr.customer_monthly(spark, sf), S))


def _decompose_sql(frame: str, p: int, body: str, digits: int = 6) -> str:
    h = p // 2
    edge = f"(SUM(y) OVER w - 0.5 * (LAG(y, {h}) OVER s + LEAD(y, {h}) OVER s)) / {p}" if p % 2 == 0 else f"SUM(y) OVER w / {p}"
    return sql(
        frame,
        body,
        n=f"SELECT item_id, ts, y, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS len FROM {frame}",
        t=f"""SELECT *, CASE WHEN COUNT(y) OVER w = {2 * h + 1} THEN {edge} END AS trend FROM n WHERE len >= {2 * p}
            WINDOW s AS (PARTITION BY item_id ORDER BY ts), w AS (PARTITION BY item_id ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)""",
        ph=f"SELECT item_id, pos % {p} AS phase, AVG(y - trend) AS pm FROM t GROUP BY 1, 2",
        se="SELECT item_id, phase, pm - AVG(pm) OVER (PARTITION BY item_id) AS seasonal FROM ph",
        d=f"SELECT t.item_id, ts, y AS observed, trend, seasonal, y - trend - seasonal AS resid FROM t JOIN se ON t.item_id = se.item_id AND t.pos % {p} = se.phase",
    )


_PARTS = "SELECT item_id, ts, " + ", ".join(f"ROUND({c}, 4) + 0.0 AS {c}" for c in ("observed", "trend", "seasonal", "resid")) + " FROM d"


@query(_decompose_sql("user_daily", 7, _PARTS))
def decompose_weekly(spark, sf):
    return rounded(seasonal.decompose(fr.user_daily(spark, sf), S, 7), 4)


@query(_decompose_sql("priority_monthly", 12, _PARTS))
def decompose_yearly(spark, sf):
    return rounded(seasonal.decompose(fr.priority_monthly(spark, sf), S, 12), 4)


@query(sql("customer_monthly", "SELECT item_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(24 AS BIGINT) AS needed FROM customer_monthly GROUP BY 1 HAVING COUNT(*) < 24"))
def decompose_too_short(spark, sf):
    return rounded(seasonal.too_short(fr.customer_monthly(spark, sf), S, 12))


@query(
    _decompose_sql(
        "user_daily",
        7,
        """SELECT item_id, ROUND(strength, 6) + 0.0 AS strength, CASE WHEN strength > 0.6 THEN 'strong' WHEN strength > 0.3 THEN 'moderate' ELSE 'weak' END AS level
        FROM (SELECT item_id, 1 - var_pop(resid) / NULLIF(var_pop(observed - trend), 0) AS strength FROM d WHERE trend IS NOT NULL GROUP BY 1)""",
    )
)
def seasonal_strength(spark, sf):
    return rounded(seasonal.seasonal_strength(seasonal.decompose(fr.user_daily(spark, sf), S, 7), S))


# --- correlation --------------------------------------------------------------------------------------------

_FEATURES = ("qty", "price", "disc_price", "charge", "tax")
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM line_features" for a in _FEATURES for b in _FEATURES)


@query(sql("line_features", "SELECT f1, f2, ROUND(r, 6) + 0.0 AS r FROM c", c=_CORR))
def correlations(spark, sf):
    return rounded(correlation.correlations(fr.line_features(spark, sf), list(_FEATURES)))


@query(
    sql(
        "line_features",
        "SELECT f1 AS feature, ROUND(r, 6) + 0.0 AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) < 0.1 THEN 'weak' ELSE 'moderate' END AS level FROM c WHERE f2 = 'charge' AND f1 <> 'charge'",
        c=_CORR,
    )
)
def target_correlation(spark, sf):
    return rounded(correlation.target_correlation(fr.line_features(spark, sf), list(_FEATURES), "charge"))


_ORDER = "list_position(['" + "','".join(_FEATURES) + "'], {0})"


@query(
    sql(
        "line_features",
        f"SELECT f1, f2, ROUND(r, 6) + 0.0 AS r, CASE WHEN abs(r) > 0.9 THEN 'high' ELSE 'moderate' END AS severity FROM c WHERE abs(r) > 0.7 AND {_ORDER.format('f1')} < {_ORDER.format('f2')}",
        c=_CORR,
    )
)
def collinear_pairs(spark, sf):
    return rounded(correlation.collinear_pairs(fr.line_features(spark, sf), list(_FEATURES)))


@query(
    sql(
        "line_features",
        """SELECT f AS feature, ROUND(v, 6) + 0.0 AS vif, CASE WHEN v > 10 THEN 'strong' WHEN v > 5 THEN 'warn' ELSE 'ok' END AS level
        FROM (SELECT unnest(['qty', 'price']) AS f, 1 / (1 - corr(qty, price) * corr(qty, price)) AS v FROM line_features)""",
    )
)
def vif_pair(spark, sf):
    return rounded(correlation.vif(fr.line_features(spark, sf), ["qty", "price"]))


@query(
    sql(
        "line_features",
        "SELECT feature, ROUND(v, 2) + 0.0 AS vif, CASE WHEN v > 10 THEN 'strong' WHEN v > 5 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT [" + ", ".join(f"'{f}'" for f in _FEATURES) + f"][i] AS feature, v FROM s{len(_FEATURES)} WHERE i = j)",
        c=_CORR,
        s0=f"SELECT {_ORDER.format('f1')} AS i, {_ORDER.format('f2')} AS j, r AS v FROM c",
        **eliminated(len(_FEATURES)),
    )
)
def vif(spark, sf):
    return rounded(correlation.vif(fr.line_features(spark, sf), list(_FEATURES)), 2)


# --- drift --------------------------------------------------------------------------------------------------

_KS = """SELECT MAX(abs(h / th - n / tn)) AS statistic, MAX(th) AS th, MAX(tn) AS tn FROM (
    SELECT SUM(a) OVER (ORDER BY y) AS h, SUM(b) OVER (ORDER BY y) AS n, SUM(a) OVER () AS th, SUM(b) OVER () AS tn
    FROM (SELECT y, CAST(SUM(a) AS DOUBLE) AS a, CAST(SUM(b) AS DOUBLE) AS b FROM (SELECT y, 1 AS a, 0 AS b FROM hist UNION ALL SELECT y, 0, 1 FROM fresh) GROUP BY 1))"""
_TAIL = "(SELECT SUM(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x)) FROM range(1, 21) r(j))"
_P = f"SELECT *, CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE greatest(least({_TAIL}, 1.0::DOUBLE), 0.0::DOUBLE) END AS p FROM (SELECT *, sqrt(th * tn / (th + tn)) * statistic AS x FROM ks)"


@query(
    sql(
        "hist fresh",
        "SELECT ROUND(statistic, 6) + 0.0 AS statistic, CAST(th AS BIGINT) AS n_hist, CAST(tn AS BIGINT) AS n_new, ROUND(p, 6) + 0.0 AS p_value, p < 0.05 AS significant FROM pv",
        ks=_KS,
        pv=_P,
    )
)
def ks_two_sample(spark, sf):
    return rounded(drift.ks_two_sample(*fr.samples(spark, sf), "y"))


_MOMENTS = """SELECT *, abs(mean_new - mean_hist) / (abs(mean_hist) + 1e-10) * 100 AS mean_change_pct, abs(std_new - std_hist) / (abs(std_hist) + 1e-10) * 100 AS std_change_pct
    FROM (SELECT AVG(y) AS mean_hist, stddev_samp(y) AS std_hist FROM hist), (SELECT AVG(y) AS mean_new, stddev_samp(y) AS std_new FROM fresh)"""


@query(
    sql(
        "hist fresh",
        "SELECT " + ", ".join(f"ROUND({c}, 4) + 0.0 AS {c}" for c in ("mean_hist", "mean_new", "std_hist", "std_new", "mean_change_pct", "std_change_pct"))
        + ", mean_change_pct > 20 OR std_change_pct > 30 AS significant FROM m",
        m=_MOMENTS,
    )
)
def moment_drift(spark, sf):
    return rounded(drift.moment_drift(*fr.samples(spark, sf), "y"), 4)


def _rolling_sql(keys: str, body: str) -> dict[str, str]:
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    pick = f"{keys}, " if keys else ""
    join = f"JOIN base USING ({keys})" if keys else "CROSS JOIN base"
    return {
        "tl": f"SELECT *, ROW_NUMBER() OVER ({part} ORDER BY ts DESC, o_orderkey DESC) AS r FROM hist",
        "base": f"SELECT {pick}AVG(y) AS hist_mean, stddev_samp(y) AS hist_std FROM tl WHERE r <= 30 {group} HAVING COUNT(*) >= 30",
        "rd": f"""SELECT {pick}COUNT(*) AS n_new, ANY_VALUE(hist_mean) AS hist_mean, ANY_VALUE(hist_std) AS hist_std, AVG(abs(y - hist_mean) / (hist_std + 1e-10)) AS mean_z
            FROM fresh {join} {group} HAVING COUNT(*) >= 5""",
    }


_RD = "CAST(n_new AS BIGINT) AS n_new, ROUND(hist_mean, 4) + 0.0 AS hist_mean, ROUND(hist_std, 4) + 0.0 AS hist_std, ROUND(mean_z, 4) + 0.0 AS mean_z, mean_z > 2 AS drift, CASE WHEN mean_z > 2 THEN ROUND(least(1.0::DOUBLE, mean_z / 5), 4) ELSE 0.0::DOUBLE END AS intensity FROM rd"
ORDERED = S.replace(ties=("o_orderkey",))


@query(sql("hist fresh", f"SELECT item_id, {_RD}", **_rolling_sql("item_id", "")))
def rolling_drift(spark, sf):
    return rounded(drift.rolling_drift(*fr.samples(spark, sf), ORDERED), 4)


@query(sql("hist fresh", f"SELECT {_RD}", **_rolling_sql("", "")))
def rolling_drift_single(spark, sf):
    return rounded(drift.rolling_drift(*fr.samples(spark, sf), ORDERED.replace(id=None)), 4)


@query(
    sql(
        "hist fresh",
        """SELECT test, subject, ROUND(score, 6) + 0.0 AS score, detected FROM (
        SELECT 'ks' AS test, 'y' AS subject, CASE WHEN p < 0.05 THEN statistic ELSE 0 END AS score, p < 0.05 AS detected FROM pv
        UNION ALL SELECT 'mean', 'y', CASE WHEN mean_change_pct > 20 THEN least(1, mean_change_pct / 100) ELSE 0 END, mean_change_pct > 20 FROM m
        UNION ALL SELECT 'std', 'y', CASE WHEN std_change_pct > 30 THEN least(1, std_change_pct / 100) ELSE 0 END, std_change_pct > 30 FROM m
        UNION ALL SELECT 'rolling', item_id, CASE WHEN mean_z > 2 THEN least(1, mean_z / 5) ELSE 0 END, mean_z > 2 FROM rd)""",
        ks=_KS,
        pv=_P,
        m=_MOMENTS,
        **_rolling_sql("item_id", ""),
    )
)
def drift_findings(spark, sf):
    return rounded(drift.drift_findings(*fr.samples(spark, sf), ORDERED).drop("reason"))


@query(
    sql(
        "hist fresh",
        """SELECT COALESCE(bool_or(detected), FALSE) AS drift_detected, ROUND(COALESCE(MAX(score), 0), 6) + 0.0 AS drift_score, COUNT(*) FILTER (WHERE detected) AS findings FROM (
        SELECT 'ks' AS test, 'y' AS subject, CASE WHEN p < 0.05 THEN statistic ELSE 0 END AS score, p < 0.05 AS detected FROM pv
        UNION ALL SELECT 'mean', 'y', CASE WHEN mean_change_pct > 20 THEN least(1, mean_change_pct / 100) ELSE 0 END, mean_change_pct > 20 FROM m
        UNION ALL SELECT 'std', 'y', CASE WHEN std_change_pct > 30 THEN least(1, std_change_pct / 100) ELSE 0 END, std_change_pct > 30 FROM m
        UNION ALL SELECT 'rolling', item_id, CASE WHEN mean_z > 2 THEN least(1, mean_z / 5) ELSE 0 END, mean_z > 2 FROM rd)""",
        ks=_KS,
        pv=_P,
        m=_MOMENTS,
        **_rolling_sql("item_id", ""),
    )
)
def drift_report(spark, sf):
    return rounded(drift.drift_report(*fr.samples(spark, sf), ORDERED))


# --- chart data ---------------------------------------------------------------------------------------------

_HIST = """SELECT {0}bin, ROUND(lo + bin * (hi - lo) / 50, 4) + 0.0 AS lower, CAST(COUNT(*) AS BIGINT) AS n FROM (
    SELECT {0}CAST(least(floor((y - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, lo, hi FROM {1}, e) GROUP BY {0}bin, lo, hi"""


@query(sql("order_series", _HIST.format("", "order_series"), e="SELECT MIN(y) AS lo, MAX(y) AS hi FROM order_series"))
def histogram(spark, sf):
    return rounded(charts.histogram(fr.order_series(spark, sf), "y"), 4)


_SOURCED = "SELECT *, CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'historical' ELSE 'new' END AS source FROM order_series"


@query(sql("order_series", _HIST.format("source, ", "s"), s=_SOURCED, e="SELECT MIN(y) AS lo, MAX(y) AS hi FROM order_series"))
def histogram_by_source(spark, sf):
    return rounded(charts.histogram(series.label_samples(*fr.samples(spark, sf)), "y", by="source"), 4)


def _box_sql(frame: str, key: str) -> str:
    return f"""SELECT {key}, ROUND(ANY_VALUE(q1), 4) + 0.0 AS q1, ROUND(ANY_VALUE(median), 4) + 0.0 AS median, ROUND(ANY_VALUE(q3), 4) + 0.0 AS q3, CAST(COUNT(y) AS BIGINT) AS n,
        MIN(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END) AS lower, MAX(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END) AS upper
        FROM {frame} JOIN (SELECT {key}, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM {frame} GROUP BY 1) USING ({key}) GROUP BY 1"""


@query(sql("event_series", _box_sql("event_series", "item_id")))
def box_stats(spark, sf):
    return rounded(charts.box_stats(fr.event_series(spark, sf), "y", "item_id"), 4)


@query(sql("user_daily", _box_sql("user_daily", "item_id")))
def box_stats_by_user(spark, sf):
    """Many groups: one box each."""
    return rounded(charts.box_stats(fr.user_daily(spark, sf), "y", "item_id"), 4)


@query(sql("order_series", _box_sql("s", "source"), s=_SOURCED))
def box_stats_by_source(spark, sf):
    return rounded(charts.box_stats(series.label_samples(*fr.samples(spark, sf)), "y", "source"), 4)


@query(sql("order_series", "SELECT source, CAST(last_day(ts) AS TIMESTAMP) AS month, ROUND(AVG(y), 4) + 0.0 AS mean FROM s GROUP BY 1, 2", s=_SOURCED))
def monthly_trend(spark, sf):
    return rounded(charts.monthly_trend(series.label_samples(*fr.samples(spark, sf)), "ts", "y", "source"), 4)
