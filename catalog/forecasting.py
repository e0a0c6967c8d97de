"""Queries on forecasting, backtesting and model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import with_frames as sql
from catalog.registry import eliminated, query, rounded
from tidegrid.models import baseline, registry, selection, smoothing, tabular
from tidegrid.operators import features, regular, series
from tidegrid.spec import SeriesSpec
from tidegrid.splits import measured

S = SeriesSpec()
MONTHLY = SeriesSpec(freq="M")
H, P = 7, 7


def panel(spark, sf):
    """Value per user and day on a complete daily grid."""
    return regular.regularize(fr.user_daily(spark, sf).select("item_id", "ts", "y"), S, "D")


def demand(spark, sf):
    """Orders per customer and month on a complete monthly grid, 0 where there were none."""
    grid = regular.regularize(fr.customer_monthly(spark, sf), MONTHLY, "M", fill=False)
    return grid.na.fill(0.0, ["y"])


#: Position from the start and the end, length and last date of each user's series.
_N = """SELECT *, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS n, MAX(ts) OVER (PARTITION BY item_id) AS last
    FROM user_regular WHERE y IS NOT NULL WINDOW w AS (PARTITION BY item_id ORDER BY ts)"""
_OUT = "item_id, CAST(k AS BIGINT) AS step, last + to_days(CAST(k AS INTEGER)) AS ts, ROUND({0}, 6) + 0.0 AS yhat"
_ALL = f"SELECT {_OUT.format('v')} FROM f, range(1, {H + 1}) s(k)"
_SEASON = """SELECT {0} FROM (SELECT item_id, last, n, s.k, (n - 1 + s.k) % 7 AS ph FROM (SELECT DISTINCT item_id, last, n FROM m), range(1, 8) s(k)) g
    LEFT JOIN f ON f.item_id = g.item_id AND f.ph = g.ph JOIN d ON d.item_id = g.item_id"""
_SEASON_OUT = "g.item_id, CAST(g.k AS BIGINT) AS step, g.last + to_days(CAST(g.k AS INTEGER)) AS ts, ROUND(COALESCE(f.v, d.v), 6) + 0.0 AS yhat"


def _model(name, spark, sf):
    return rounded(registry.forecast(name, panel(spark, sf), S, H, P))


@query(sql("user_regular", f"SELECT item_id, CAST(k AS BIGINT) AS step, last + to_days(CAST(k AS INTEGER)) AS ts FROM f, range(1, {H + 1}) s(k)", f="SELECT item_id, MAX(ts) AS last FROM user_regular GROUP BY 1"))
def future_grid(spark, sf):
    return rounded(baseline.future_grid(panel(spark, sf), S, H))


@query(sql("cust_zero", "SELECT item_id, CAST(k AS BIGINT) AS step, CAST(last_day(date_trunc('month', last) + to_months(CAST(k AS INTEGER))) AS TIMESTAMP) AS ts FROM f, range(1, 4) s(k)", f="SELECT item_id, MAX(ts) AS last FROM cust_zero GROUP BY 1"))
def future_grid_monthly(spark, sf):
    return rounded(baseline.future_grid(demand(spark, sf), MONTHLY, 3))


@query(sql("user_regular", _ALL, m=_N, f="SELECT item_id, last, y AS v FROM m WHERE pos = n - 1"))
def naive(spark, sf):
    return _model("naive", spark, sf)


_SN = {"m": _N, "f": "SELECT item_id, pos % 7 AS ph, y AS v FROM m WHERE pos >= n - 7", "d": "SELECT item_id, y AS v FROM m WHERE pos = n - 1"}


@query(sql("user_regular", _SEASON.format(_SEASON_OUT), **_SN))
def seasonal_naive(spark, sf):
    return _model("seasonal_naive", spark, sf)


@query(sql("user_regular", _ALL, m=_N, f="SELECT item_id, last, AVG(y) AS v FROM m GROUP BY 1, 2"))
def average(spark, sf):
    return _model("average", spark, sf)


@query(sql("user_regular", _SEASON.format(_SEASON_OUT), m=_N, f="SELECT item_id, pos % 7 AS ph, AVG(y) AS v FROM m GROUP BY 1, 2", d="SELECT item_id, AVG(y) AS v FROM m GROUP BY 1"))
def seasonal_average(spark, sf):
    return _model("seasonal_average", spark, sf)


@query(sql("user_regular", _ALL, m=_N, f="SELECT DISTINCT item_id, last, 0.0::DOUBLE AS v FROM m"))
def zero(spark, sf):
    return _model("zero", spark, sf)


_LINE = "SELECT item_id, last, n, COALESCE(regr_slope(y, pos), 0) AS b, AVG(y) - COALESCE(regr_slope(y, pos), 0) * AVG(pos) AS a FROM m GROUP BY 1, 2, 3"


@query(sql("user_regular", f"SELECT {_OUT.format('a + b * (n - 1 + k)')} FROM f, range(1, {H + 1}) s(k)", m=_N, f=_LINE))
def polytrend(spark, sf):
    return _model("polytrend", spark, sf)


_W = "SELECT *, exp(-(n - 1 - pos) * 1.0::DOUBLE / n) AS w FROM m"


@query(sql("user_regular", _ALL, m=_N, w=_W, f="SELECT item_id, last, SUM(w * y) / SUM(w) AS v FROM w GROUP BY 1, 2"))
def npts(spark, sf):
    return _model("npts", spark, sf)


@query(
    sql(
        "user_regular",
        "SELECT item_id, " + ", ".join(f"MIN(CASE WHEN c / t + 1e-9 >= {q} THEN y END) AS \"{q}\"" for q in selection.LEVELS) + " FROM c GROUP BY 1",
        m=_N,
        w=_W,
        c="SELECT item_id, y, SUM(w) OVER (PARTITION BY item_id ORDER BY y) AS c, SUM(w) OVER (PARTITION BY item_id) AS t FROM w",
    )
)
def npts_quantiles(spark, sf):
    return baseline.npts_quantiles(panel(spark, sf), S, list(selection.LEVELS))


_A = "SELECT unnest(range({1})) AS i, unnest([{0}])::DOUBLE AS a"


def _ses_steps(source: str, keys: str, alphas: tuple) -> dict[str, str]:
    """Recursive smoothing of ``source`` (keys, pos, y) for each alpha; ``fit`` has the best one's level."""
    on = " AND ".join(f"p.{k} = r.{k}" for k in keys.split(", "))
    mine, own = ", ".join(f"p.{k}" for k in keys.split(", ")), ", ".join(f"r.{k}" for k in keys.split(", "))
    return {
        "al": _A.format(", ".join(map(str, alphas)), len(alphas)),
        "rec": f"""SELECT {mine}, al.i, al.a, p.pos, p.y AS l, 0.0::DOUBLE AS sse FROM {source} p, al WHERE p.pos = 0
            UNION ALL SELECT {own}, r.i, r.a, p.pos, r.l + r.a * (p.y - r.l), r.sse + (p.y - r.l) * (p.y - r.l) FROM rec r JOIN {source} p ON {on} AND p.pos = r.pos + 1""",
        "fit": f"""SELECT {keys}, a AS alpha, l AS level, sse, pos + 1 AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY round(sse, 9), i) AS r
            FROM (SELECT *, MAX(pos) OVER (PARTITION BY {keys}) AS mp FROM rec) WHERE pos = mp) WHERE r = 1""",
    }


_SES = _ses_steps("m", "item_id", smoothing.ALPHAS)
_LASTS = "SELECT item_id, MAX(ts) AS last FROM m GROUP BY 1"


@query(sql("user_regular", _ALL, m=_N, **_SES, f="SELECT item_id, last, level AS v FROM fit JOIN (SELECT DISTINCT item_id, last FROM m) USING (item_id)"))
def ses(spark, sf):
    return _model("ses", spark, sf)


_HOLT = {
    "al": "SELECT unnest(range({0})) AS i, unnest([{1}])::DOUBLE AS a, unnest([{2}])::DOUBLE AS b".format(
        len(smoothing.HOLT_GRID), ", ".join(str(a) for a, _ in smoothing.HOLT_GRID), ", ".join(repr(a * b) for a, b in smoothing.HOLT_GRID)
    ),
    "st": "SELECT m.*, COALESCE(LEAD(y) OVER (PARTITION BY item_id ORDER BY pos) - y, 0) AS b0 FROM m",
    "rec": """SELECT p.item_id, al.i, al.a, al.b, p.pos, p.y AS l, p.b0 AS t, 0.0::DOUBLE AS sse FROM st p, al WHERE p.pos = 0
        UNION ALL SELECT r.item_id, r.i, r.a, r.b, p.pos, r.l + r.t + r.a * (p.y - (r.l + r.t)), r.t + r.b * (p.y - (r.l + r.t)), r.sse + (p.y - (r.l + r.t)) * (p.y - (r.l + r.t))
        FROM rec r JOIN m p ON p.item_id = r.item_id AND p.pos = r.pos + 1""",
    "f": """SELECT item_id, last, l, t FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY round(sse, 9), i) AS r FROM
        (SELECT rec.*, m.last FROM rec JOIN m ON m.item_id = rec.item_id AND m.pos = rec.pos AND m.pos = m.n - 1)) WHERE r = 1""",
}


@query(sql("user_regular", f"SELECT {_OUT.format('l + t * k')} FROM f, range(1, {H + 1}) s(k)", m=_N, **_HOLT))
def holt(spark, sf):
    return _model("holt", spark, sf)


_SETS = ", ".join(f"({i}, {a}::DOUBLE, {a * b!r}::DOUBLE, {g}::DOUBLE)" for i, (a, b, g) in enumerate(smoothing.HW_GRID))
_E = "(p.y - r.l - r.t - r.s[1])"
_HW = {
    "al": f"SELECT * FROM (VALUES {_SETS}) v(i, a, b, g)",
    "hd": "SELECT item_id, AVG(CASE WHEN pos < 7 THEN y END) AS f1, AVG(CASE WHEN pos BETWEEN 7 AND 13 THEN y END) AS f2 FROM m WHERE n >= 14 GROUP BY 1",
    "st": """SELECT item_id, f1 + (f2 - f1) / 7 * 3 AS l, (f2 - f1) / 7 AS t, list(y - (f1 + (f2 - f1) / 7 * (pos - 3)) ORDER BY pos) AS s
        FROM m JOIN hd USING (item_id) WHERE pos < 7 GROUP BY item_id, f1, f2""",
    "rec": f"""SELECT st.item_id, al.i, al.a, al.b, al.g, CAST(6 AS BIGINT) AS pos, st.l, st.t, st.s, 0.0::DOUBLE AS sse FROM st, al
        UNION ALL SELECT r.item_id, r.i, r.a, r.b, r.g, p.pos, r.l + r.t + r.a * {_E}, r.t + r.b * {_E}, list_append(r.s[2:7], r.s[1] + r.g * {_E}), r.sse + {_E} * {_E}
        FROM rec r JOIN m p ON p.item_id = r.item_id AND p.pos = r.pos + 1""",
    "hs": "SELECT m.*, COALESCE(LEAD(y) OVER (PARTITION BY item_id ORDER BY pos) - y, 0) AS b0 FROM m WHERE n < 14",
    "rec2": """SELECT p.item_id, al.i, al.a, al.b, p.pos, p.y AS l, p.b0 AS t, 0.0::DOUBLE AS sse FROM hs p, al WHERE p.pos = 0
        UNION ALL SELECT r.item_id, r.i, r.a, r.b, p.pos, r.l + r.t + r.a * (p.y - (r.l + r.t)), r.t + r.b * (p.y - (r.l + r.t)), r.sse + (p.y - (r.l + r.t)) * (p.y - (r.l + r.t))
        FROM rec2 r JOIN m p ON p.item_id = r.item_id AND p.pos = r.pos + 1""",
    "ends": "SELECT item_id, i, pos, l, t, s, sse FROM rec UNION ALL SELECT item_id, i, pos, l, t, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[], sse FROM rec2",
    "f": """SELECT item_id, last, l, t, s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY round(sse, 9), i) AS r FROM
        (SELECT ends.*, m.last FROM ends JOIN m ON m.item_id = ends.item_id AND m.pos = ends.pos AND m.pos = m.n - 1)) WHERE r = 1""",
}


@query(sql("user_regular", f"SELECT {_OUT.format('l + t * k + s[CAST((k - 1) % 7 + 1 AS BIGINT)]')} FROM f, range(1, {H + 1}) s(k)".replace("s(k)", "q(k)"), m=_N, **_HW))
def holt_winters(spark, sf):
    return _model("holt_winters", spark, sf)


@query(
    sql(
        "user_regular",
        f"SELECT {_OUT.format('level + b / 2 * (k - 1 + (1 - pow(1 - alpha, n)) / alpha)')} FROM f, range(1, {H + 1}) s(k)",
        m=_N,
        **_SES,
        ln=_LINE,
        f="SELECT item_id, last, fit.n, level, alpha, b FROM fit JOIN ln USING (item_id)",
    )
)
def theta(spark, sf):
    return _model("theta", spark, sf)


# Intermittent demand: months without an order count as 0.
_ZN = _N.replace("user_regular", "cust_zero")
_DEM = "SELECT item_id, y, pos, ROW_NUMBER() OVER w - 1 AS at0, pos - COALESCE(LAG(pos) OVER w, -1) AS gap FROM m WHERE y <> 0 WINDOW w AS (PARTITION BY item_id ORDER BY pos)"
_MOUT = "item_id, CAST(k AS BIGINT) AS step, CAST(last_day(date_trunc('month', last) + to_months(CAST(k AS INTEGER))) AS TIMESTAMP) AS ts, ROUND(v, 4) + 0.0 AS yhat FROM f, range(1, 4) s(k)"
#: With one fixed alpha the level is a weighted sum: alpha (1-alpha)^age, and (1-alpha)^age for the first value.
_FIXED = "SUM({0} * pow(0.9::DOUBLE, c - 1 - at0) * CASE WHEN at0 = 0 THEN 1 ELSE 0.1::DOUBLE END)"


def _intermittent(name, spark, sf):
    return rounded(registry.forecast(name, demand(spark, sf), MONTHLY, 3), 4)


@query(
    sql(
        "cust_zero",
        f"SELECT {_MOUT}",
        m=_ZN,
        de=_DEM,
        dc="SELECT *, COUNT(*) OVER (PARTITION BY item_id) AS c FROM de",
        f=f"SELECT item_id, last, COALESCE(v, 0) AS v FROM ({_LASTS}) LEFT JOIN (SELECT item_id, {_FIXED.format('y')} / {_FIXED.format('gap')} AS v FROM dc GROUP BY 1) USING (item_id)",
    )
)
def croston(spark, sf):
    return _intermittent("croston", spark, sf)


_KMAX = "SELECT item_id, greatest(CAST(floor(AVG(gap) + 0.5) AS BIGINT), 1) AS kmax FROM de GROUP BY 1"
_BUCKETS = """SELECT item_id, w, ROW_NUMBER() OVER (PARTITION BY item_id, w ORDER BY back DESC) - 1 AS pos, y FROM
    (SELECT m.item_id, w, (n - 1 - pos) // w AS back, SUM(y) AS y, COUNT(*) AS c FROM m JOIN kx USING (item_id), {0} GROUP BY 1, 2, 3) WHERE c = w"""
_AGG_F = f"SELECT item_id, last, COALESCE(v, 0) AS v FROM ({_LASTS}) LEFT JOIN (SELECT item_id, AVG(level / w) AS v FROM fit GROUP BY 1) USING (item_id)"
_BSES = _ses_steps("bk", "item_id, w", smoothing.INTERMITTENT_ALPHAS)


@query(sql("cust_zero", f"SELECT {_MOUT}", m=_ZN, de=_DEM, kx=_KMAX, bk=_BUCKETS.format("LATERAL (SELECT kmax AS w) q"), **_BSES, f=_AGG_F))
def adida(spark, sf):
    return _intermittent("adida", spark, sf)


@query(sql("cust_zero", f"SELECT {_MOUT}", m=_ZN, de=_DEM, kx=_KMAX, bk=_BUCKETS.format("LATERAL (SELECT unnest(range(1, kmax + 1)) AS w) q"), **_BSES, f=_AGG_F))
def imapa(spark, sf):
    return _intermittent("imapa", spark, sf)


_DEC = {
    "nn": "SELECT item_id, ts, y, last, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS n FROM m",
    "tr": """SELECT *, CASE WHEN COUNT(y) OVER w = 7 THEN SUM(y) OVER w / 7 END AS trend FROM nn WHERE n >= 14
        WINDOW w AS (PARTITION BY item_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "ph": "SELECT item_id, pos % 7 AS phase, AVG(y - trend) AS pm FROM tr GROUP BY 1, 2",
    "se": "SELECT item_id, phase, pm - AVG(pm) OVER (PARTITION BY item_id) AS seasonal FROM ph",
    "ad": "SELECT nn.item_id, nn.ts, nn.last, nn.pos, nn.n, nn.y - COALESCE(seasonal, 0) AS y FROM nn LEFT JOIN se ON nn.item_id = se.item_id AND nn.pos % 7 = se.phase",
}
_STLF = {"m": _N} | _DEC | {k: (v.replace("FROM m", "FROM ad").replace("m.*", "ad.*").replace("JOIN m", "JOIN ad").replace("m.", "ad.")) for k, v in _HOLT.items()}


@query(
    sql(
        "user_regular",
        f"""SELECT g.item_id, CAST(g.k AS BIGINT) AS step, g.last + to_days(CAST(g.k AS INTEGER)) AS ts, ROUND(l + t * g.k + COALESCE(seasonal, 0), 6) + 0.0 AS yhat
        FROM (SELECT f.*, n, q.k FROM f JOIN (SELECT DISTINCT item_id, n FROM m) USING (item_id), range(1, {H + 1}) q(k)) g
        LEFT JOIN se ON se.item_id = g.item_id AND se.phase = (g.n - 1 + g.k) % 7""",
        **_STLF,
    )
)
def stlf(spark, sf):
    return _model("stlf", spark, sf)


def _regression(name, spark, sf, strategy="recursive"):
    return rounded(tabular.tabular(panel(spark, sf), S, H, name, strategy=strategy), 4)


_DATE = "CAST(isodow({0}) - 1 AS DOUBLE), CAST(month({0}) AS DOUBLE), CAST(day({0}) AS DOUBLE)"


def _normal_equations(aheads: int, ridge: float = 0.0) -> dict[str, str]:
    """Regression on lags 1, 2, 3, 7 and the date, a model per distance to the forecast: seven standardised features (0 where one never varies), the label as the eighth."""
    rows = "UNION ALL ".join(
        f"SELECT {a} AS a, [LAG(y, {a}) OVER w, LAG(y, {a + 1}) OVER w, LAG(y, {a + 2}) OVER w, LAG(y, {a + 6}) OVER w, {_DATE.format('ts')}, y] AS x FROM m WINDOW w AS (PARTITION BY item_id ORDER BY ts) "
        for a in range(1, aheads + 1)
    )
    return {
        "m": _N,
        "tx": f"SELECT * FROM ({rows}) WHERE x[4] IS NOT NULL",
        "st": "SELECT a, i, AVG(x[i]) AS mean, stddev_pop(x[i]) AS sd FROM tx, range(1, 9) q(i) GROUP BY 1, 2",
        "sl": "SELECT a, list(mean ORDER BY i) AS mean, list(sd ORDER BY i) AS sd FROM st GROUP BY 1",
        "s0": f"""SELECT tx.a, i, j, AVG(CASE WHEN sd[i] = 0 OR sd[j] = 0 THEN 0 ELSE (x[i] - mean[i]) / sd[i] * (x[j] - mean[j]) / sd[j] END)
            + CASE WHEN i = j AND i < 8 THEN {ridge} / ANY_VALUE(sd[8]) + ANY_VALUE(CASE WHEN sd[i] = 0 THEN 1 ELSE 0 END) ELSE 0 END AS v
            FROM tx JOIN sl ON tx.a = sl.a, range(1, 9) q(i), range(1, 9) r(j) GROUP BY 1, 2, 3""",
        **eliminated(7, "a"),
        "co": """SELECT a, list(b ORDER BY i) AS b, ANY_VALUE(m8) - SUM(b * m) AS b0 FROM (SELECT s.a, i, CASE WHEN sd[i] = 0 THEN 0 ELSE v * sd[8] / sd[i] END AS b, mean[i] AS m, mean[8] AS m8
            FROM s7 s JOIN sl ON s.a = sl.a WHERE j = 8 AND i < 8) GROUP BY 1""",
        "nw": "SELECT item_id, last, ANY_VALUE(n) AS n, list(y ORDER BY pos DESC) AS ys FROM m WHERE pos >= n - 7 GROUP BY 1, 2",
    }


_DOT = "b0 + list_dot_product(b, [ys[1], ys[2], ys[3], ys[7], " + _DATE.format("last + to_days(CAST({0} AS INTEGER))") + "])"
#: Each step's forecast becomes the newest value.
_ONWARD = f"""SELECT item_id, last, n, ys, CAST(0 AS BIGINT) AS k, NULL::DOUBLE AS v FROM nw
    UNION ALL SELECT item_id, last, n, list_prepend(v, ys)[1:7], k, v FROM (SELECT item_id, last, n, ys, k + 1 AS k, CASE WHEN n < 7 THEN ys[1] ELSE {_DOT.format('k + 1')} END AS v FROM rec, co WHERE k < {H})"""
_REGRESSED = "SELECT item_id, k AS step, last + to_days(CAST(k AS INTEGER)) AS ts, ROUND(v, 4) + 0.0 AS yhat FROM rec WHERE k > 0"


@query(sql("user_regular", _REGRESSED, **_normal_equations(1), rec=_ONWARD))
def tabular_linear(spark, sf):
    return _regression("linear", spark, sf)


@query(
    sql(
        "user_regular",
        f"SELECT item_id, CAST(a AS BIGINT) AS step, last + to_days(CAST(a AS INTEGER)) AS ts, ROUND(CASE WHEN n < 7 THEN ys[1] ELSE {_DOT.format('a')} END, 4) + 0.0 AS yhat FROM nw, co",
        **_normal_equations(H),
    )
)
def tabular_linear_direct(spark, sf):
    return _regression("linear", spark, sf, "direct")


@query(sql("user_regular", _REGRESSED, **_normal_equations(1, 1.0), rec=_ONWARD))
def tabular_ridge(spark, sf):
    return _regression("ridge", spark, sf)


@query()
def tabular_lasso(spark, sf):
    return _regression("lasso", spark, sf)


@query()
def tabular_elastic_net(spark, sf):
    return _regression("elastic_net", spark, sf)


@query()
def tabular_random_forest(spark, sf):
    return _regression("random_forest", spark, sf)


@query()
def tabular_boosted_trees(spark, sf):
    return _regression("boosted_trees", spark, sf)


# --- scoring and selection ----------------------------------------------------------------------------------

_METRICS = """ROUND(AVG(abs(y - yhat)), {0}) + 0.0 AS "MAE", ROUND(AVG(abs(y - yhat) / NULLIF(abs(y), 0)), {0}) + 0.0 AS "MAPE", ROUND(AVG((y - yhat) * (y - yhat)), {0}) + 0.0 AS "MSE",
    ROUND(sqrt(AVG((y - yhat) * (y - yhat))), {0}) + 0.0 AS "RMSE", ROUND(AVG(2 * abs(y - yhat) / NULLIF(abs(y) + abs(yhat), 0)), {0}) + 0.0 AS "SMAPE",
    ROUND(AVG(abs(y - yhat) / NULLIF(scale_abs, 0)), {0}) + 0.0 AS "MASE", ROUND(sqrt(AVG((y - yhat) * (y - yhat) / NULLIF(scale_sq, 0))), {0}) + 0.0 AS "RMSSE\""""

_HELD = {
    "g": """SELECT *, LAST_VALUE(y0 IGNORE NULLS) OVER w AS y, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS n FROM
        (SELECT q.item_id, q.ts, t.y AS y0 FROM (SELECT item_id, unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 1 DAY)) AS ts FROM type_daily GROUP BY 1) q
        LEFT JOIN type_daily t ON t.item_id = q.item_id AND t.ts = q.ts) WINDOW w AS (PARTITION BY item_id ORDER BY ts)""",
    "ft": """SELECT item_id, ts, y, pos, n, AVG(y) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll, LAG(y, 7) OVER (PARTITION BY item_id ORDER BY ts) AS lag7 FROM g""",
    "sc": "SELECT item_id, AVG(abs(y - lag7)) AS scale_abs, AVG((y - lag7) * (y - lag7)) AS scale_sq FROM ft WHERE pos < n - 7 GROUP BY 1",
    "jo": """SELECT a.item_id, a.ts, a.y, a.lag7 AS yhat, a.roll, scale_abs, scale_sq FROM ft a JOIN sc USING (item_id) WHERE a.pos >= a.n - 7""",
}


@query(sql("type_daily", f"SELECT item_id, ROUND(AVG(roll), 4) + 0.0 AS mean_rolling_7, {_METRICS.format(4)} FROM jo GROUP BY 1", **_HELD))
def forecast_metrics(spark, sf):
    """The whole way: series, daily grid, rolling mean and lag, seasonal-naive forecast of the last week, metrics."""
    grid = regular.regularize(fr.type_daily(spark, sf), S, "D")
    spec = measured(grid, S)
    wide = features.add_lags(features.add_rolling(grid, spec, (7,), ("mean",)), spec, (7,))
    train, held = selection.folds_of(grid, spec, H, 1)
    predicted = registry.forecast("seasonal_naive", train.drop("fold"), spec, H, P).select("item_id", "step", "yhat")
    actual = held.drop("fold").join(wide.select("item_id", "ts", "y_rolling_7_mean"), ["item_id", "ts"])
    joined = actual.join(predicted, ["item_id", "step"]).join(selection.in_sample_error(train, spec, P), "item_id")
    scores = selection.metrics(joined, ["item_id"])
    level = joined.groupBy("item_id").agg(F.avg("y_rolling_7_mean").alias("mean_rolling_7"))
    return rounded(level.join(scores, "item_id"), 4)


#: Three folds of the five type series and the forecasts of four models, in SQL.
_FOLDS = {
    "b": "SELECT item_id, ts, y, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts DESC) AS back FROM type_daily",
    "tr": "SELECT fold, b.*, ROW_NUMBER() OVER (PARTITION BY fold, item_id ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY fold, item_id) AS n FROM b, range(3) q(fold) WHERE back > (fold + 1) * 7",
    "he": "SELECT (back - 1) // 7 AS fold, item_id, y, ((back - 1) // 7 + 1) * 7 - back + 1 AS step FROM b WHERE back <= 21",
    "se": """SELECT fold, item_id, AVG(abs(y - z)) AS scale_abs, AVG((y - z) * (y - z)) AS scale_sq FROM
        (SELECT *, LAG(y, 7) OVER (PARTITION BY fold, item_id ORDER BY ts) AS z FROM tr) GROUP BY 1, 2""",
    "li": "SELECT fold, item_id, n, COALESCE(regr_slope(y, pos), 0) AS b, AVG(y) - COALESCE(regr_slope(y, pos), 0) * AVG(pos) AS a FROM tr GROUP BY 1, 2, 3",
    "fc": """SELECT 'naive' AS model, fold, item_id, step, yhat FROM (SELECT fold, item_id, y AS yhat FROM tr WHERE pos = n - 1), range(1, 8) s(step)
        UNION ALL SELECT 'average', fold, item_id, step, yhat FROM (SELECT fold, item_id, AVG(y) AS yhat FROM tr GROUP BY 1, 2), range(1, 8) s(step)
        UNION ALL SELECT 'seasonal_naive', fold, item_id, pos - (n - 7) + 1, y FROM tr WHERE pos >= n - 7
        UNION ALL SELECT 'polytrend', fold, item_id, step, a + b * (n - 1 + step) FROM li, range(1, 8) s(step)""",
    "bt": "SELECT model, fc.fold, fc.item_id, fc.step, he.y, yhat, scale_abs, scale_sq FROM fc JOIN he ON fc.fold = he.fold AND fc.item_id = he.item_id AND fc.step = he.step JOIN se ON se.fold = fc.fold AND se.item_id = fc.item_id",
    "pf": "SELECT model, fold, item_id, AVG(abs(y - yhat) / NULLIF(scale_abs, 0)) AS e FROM bt GROUP BY 1, 2, 3",
    "ss": "SELECT model, item_id, AVG(e) AS metric FROM pf GROUP BY 1, 2",
}
_FOUR = ["naive", "average", "seasonal_naive", "polytrend"]


def _backtest(spark, sf):
    return selection.backtest_forecasts(fr.type_daily(spark, sf), S, _FOUR, H, 3, P)


@query(sql("type_daily", "SELECT model, CAST(fold AS BIGINT) AS fold, item_id, CAST(step AS BIGINT) AS step, ROUND(yhat, 4) + 0.0 AS yhat, ROUND(y, 4) + 0.0 AS y, ROUND(scale_abs, 4) + 0.0 AS scale_abs, ROUND(scale_sq, 2) + 0.0 AS scale_sq FROM bt", **_FOLDS))
def backtest_forecasts(spark, sf):
    bt = _backtest(spark, sf).withColumn("scale_sq", F.round("scale_sq", 2))
    return rounded(bt, 4)


@query(sql("type_daily", f"SELECT model, item_id, {_METRICS.format(4)} FROM bt GROUP BY 1, 2", **_FOLDS))
def backtest_metrics(spark, sf):
    return rounded(selection.metrics(_backtest(spark, sf), ["model", "item_id"]), 4)


@query(sql("type_daily", "SELECT model, item_id, ROUND(metric, 6) + 0.0 AS metric, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY metric, model) AS BIGINT) AS rank FROM ss", **_FOLDS))
def series_leaderboard(spark, sf):
    scores = selection.series_scores(_backtest(spark, sf), S, "MASE (Mean absolute scaled error)")
    return rounded(selection.series_leaderboard(scores, S))


_BOARD = {"bo": "SELECT model, -AVG(metric) AS score_val, 'global' AS strategy FROM ss GROUP BY 1 UNION ALL SELECT 'per_series', -AVG(metric), 'per_series' FROM (SELECT item_id, MIN(metric) AS metric FROM ss GROUP BY 1)"}


def _board(spark, sf):
    scores = selection.series_scores(_backtest(spark, sf), S, "MASE")
    return selection.combine_leaderboards(selection.leaderboard(scores, "global"), selection.per_series_score(scores, S, "per_series"))


@query(sql("type_daily", "SELECT model, ROUND(score_val, 6) + 0.0 AS score_val, strategy FROM bo", **_FOLDS, **_BOARD))
def leaderboard(spark, sf):
    return rounded(_board(spark, sf))


@query(sql("type_daily", "SELECT model, ROUND(score_val, 6) + 0.0 AS score_val, strategy FROM bo ORDER BY bo.score_val DESC, model LIMIT 1", **_FOLDS, **_BOARD))
def best_model(spark, sf):
    return rounded(selection.best_of(_board(spark, sf)))


@query(
    sql(
        "type_daily",
        """SELECT arg_max(model, score_val) AS best_model, ROUND(MAX(score_val), 6) + 0.0 AS best_score, ROUND(AVG(score_val), 6) + 0.0 AS mean_score,
        CAST(COUNT(*) AS BIGINT) AS models, 12.5::DOUBLE AS seconds FROM bo""",
        **_FOLDS,
        **_BOARD,
    )
)
def leaderboard_summary(spark, sf):
    return rounded(selection.leaderboard_summary(_board(spark, sf), 12.5))


@query(
    sql(
        "type_daily",
        """SELECT item_id, model, CAST(step AS BIGINT) AS step, last + to_days(CAST(step AS INTEGER)) AS ts, ROUND(yhat, 4) + 0.0 AS yhat
        FROM wi JOIN al USING (item_id, model) JOIN (SELECT item_id, MAX(ts) AS last FROM type_daily GROUP BY 1) USING (item_id)""",
        **_FOLDS,
        wi="SELECT item_id, model FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY metric, model) AS r FROM ss) WHERE r = 1",
        w0="SELECT item_id, ts, y, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS n FROM type_daily",
        al="""SELECT item_id, 'naive' AS model, step, y AS yhat FROM w0, range(1, 8) s(step) WHERE pos = n - 1
            UNION ALL SELECT item_id, 'average', step, v FROM (SELECT item_id, AVG(y) AS v FROM w0 GROUP BY 1), range(1, 8) s(step)
            UNION ALL SELECT item_id, 'seasonal_naive', pos - (n - 7) + 1, y FROM w0 WHERE pos >= n - 7
            UNION ALL SELECT item_id, 'polytrend', step, AVG(y) + regr_slope(y, pos) * (n - 1 + step - AVG(pos)) FROM w0, range(1, 8) s(step) GROUP BY item_id, n, step""",
    )
)
def best_model_forecast(spark, sf):
    best = selection.best_models(selection.series_scores(_backtest(spark, sf), S, "MASE"), S)
    return rounded(selection.best_forecasts(fr.type_daily(spark, sf), S, best, _FOUR, H, P), 4)


@query(sql("type_daily", "SELECT model, CAST(step AS BIGINT) AS step, " + ", ".join(f"ROUND(quantile_cont(y - yhat, {q}), 4) + 0.0 AS \"{q}\"" for q in selection.LEVELS) + " FROM bt GROUP BY 1, 2", **_FOLDS))
def residual_quantiles(spark, sf):
    q = selection.residual_quantiles(_backtest(spark, sf))
    return q.select("model", F.col("step").cast("long").alias("step"), *[(F.round(f"`{c}`", 4) + 0.0).alias(str(c)) for c in selection.LEVELS])


def _with_quantiles(spark, sf, mean_only):
    t = fr.type_daily(spark, sf)
    point = registry.forecast("seasonal_naive", t, S, H, P).withColumn("model", F.lit("seasonal_naive"))
    q = selection.quantile_forecast(point, selection.residual_quantiles(_backtest(spark, sf)), mean_only)
    levels = [c for c in q.columns if c[0].isdigit()]
    return q.select("item_id", F.col("step").cast("long").alias("step"), "yhat", *[(F.round(f"`{c}`", 4) + 0.0).alias(c) for c in levels])


def _quantile_sql(levels) -> str:
    cols = ", ".join(f"ROUND(yhat + q{i}, 4) + 0.0 AS \"{q}\"" for i, q in enumerate(levels))
    return sql(
        "type_daily",
        f"SELECT item_id, CAST(step AS BIGINT) AS step, yhat, {cols} FROM pt JOIN rq USING (step)",
        **_FOLDS,
        pt="SELECT item_id, pos - (n - 7) + 1 AS step, y AS yhat FROM (SELECT item_id, y, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS n FROM type_daily) WHERE pos >= n - 7",
        rq="SELECT step, " + ", ".join(f"quantile_cont(y - yhat, {q}) AS q{i}" for i, q in enumerate(levels)) + " FROM bt WHERE model = 'seasonal_naive' GROUP BY 1",
    )


@query(_quantile_sql(selection.LEVELS))
def quantile_forecast(spark, sf):
    return _with_quantiles(spark, sf, False)


@query(_quantile_sql([0.5]))
def quantile_forecast_mean_only(spark, sf):
    return _with_quantiles(spark, sf, True)


#: Greedy rounds over the four models in name order: counts so far, the score to beat, and rounds without enough gain.
_GREEDY = """SELECT CAST(0 AS BIGINT) AS r, [CAST(0 AS BIGINT), 0, 0, 0] AS c, NULL::DOUBLE AS score, NULL::DOUBLE AS single, NULL::DOUBLE AS mark, CAST(0 AS BIGINT) AS idle
    UNION ALL SELECT r + 1, c, score, COALESCE(single, score), CASE WHEN mark IS NULL OR score < mark - 0.001 * single THEN score ELSE mark END,
        CASE WHEN mark IS NULL OR score < mark - 0.001 * single THEN 0 ELSE idle + 1 END
    FROM (SELECT r, single, mark, idle, arg_min(c2, (score, j)) AS c, MIN(score) AS score
        FROM (SELECT r, single, mark, idle, j, list_transform(range(1, 5), lambda i: c[i] + CASE WHEN i = j THEN 1 ELSE 0 END) AS c2,
                (SELECT AVG(LOSS) FROM (SELECT y, scale_abs, scale_sq, y - (c[1] * m[1] + c[2] * m[2] + c[3] * m[3] + c[4] * m[4] + m[j]) / (r + 1) AS e FROM wi)) AS score
            FROM rec, range(1, 5) q(j) WHERE idle < 5) GROUP BY r, single, mark, idle)"""


def _greedy(loss: str) -> dict[str, str]:
    return {
        **_FOLDS,
        "wi": "SELECT fold, item_id, step, y, scale_abs, scale_sq, list(yhat ORDER BY model) AS m FROM bt GROUP BY 1, 2, 3, 4, 5, 6",
        "rec": _GREEDY.replace("LOSS", loss),
        "ew": f"SELECT unnest({sorted(_FOUR)}) AS model, unnest(c) / list_sum(c) AS weight FROM (SELECT arg_min(c, (score, r)) AS c FROM rec WHERE r > 0)",
    }


_WEIGHTS = "SELECT model, ROUND(weight, 6) + 0.0 AS weight FROM ew WHERE weight > 0"


@query(sql("type_daily", _WEIGHTS, **_greedy("abs(e)")))
def ensemble_weights(spark, sf):
    return rounded(selection.ensemble_weights(_backtest(spark, sf), S, "MAE"))


@query(sql("type_daily", _WEIGHTS, **_greedy("e * e / NULLIF(scale_sq, 0)")))
def ensemble_weights_squared(spark, sf):
    """The same by RMSSE, whose rounds need only the products of the models' errors."""
    return rounded(selection.ensemble_weights(_backtest(spark, sf), S, "RMSSE"))


#: The four models' forecasts after the whole series.
_AHEAD = {
    "af": "SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY item_id) AS n, MAX(ts) OVER (PARTITION BY item_id) AS last FROM type_daily",
    "al": "SELECT item_id, n, COALESCE(regr_slope(y, pos), 0) AS b, AVG(y) - COALESCE(regr_slope(y, pos), 0) * AVG(pos) AS a FROM af GROUP BY 1, 2",
    "ac": """SELECT 'naive' AS model, item_id, step, yhat FROM (SELECT item_id, y AS yhat FROM af WHERE pos = n - 1), range(1, 8) s(step)
        UNION ALL SELECT 'average', item_id, step, yhat FROM (SELECT item_id, AVG(y) AS yhat FROM af GROUP BY 1), range(1, 8) s(step)
        UNION ALL SELECT 'seasonal_naive', item_id, pos - (n - 7) + 1, y FROM af WHERE pos >= n - 7
        UNION ALL SELECT 'polytrend', item_id, step, a + b * (n - 1 + step) FROM al, range(1, 8) s(step)""",
    "en": "SELECT item_id, MAX(ts) AS last FROM type_daily GROUP BY 1",
}


@query(
    sql(
        "type_daily",
        """SELECT item_id, CAST(step AS BIGINT) AS step, last + to_days(CAST(step AS INTEGER)) AS ts, ROUND(SUM(yhat * weight) / SUM(weight), 4) + 0.0 AS yhat
        FROM ac JOIN ew USING (model) JOIN en USING (item_id) WHERE weight > 0 GROUP BY 1, 2, 3""",
        **_greedy("abs(e)"),
        **_AHEAD,
    )
)
def ensemble_forecast(spark, sf):
    weights = selection.ensemble_weights(_backtest(spark, sf), S, "MAE")
    return rounded(selection.ensemble_forecast(fr.type_daily(spark, sf), S, weights, H, P), 4)


_NAIVE_NEXT = "SELECT item_id, last + to_days(CAST(k AS INTEGER)) AS ts, y FROM (SELECT item_id, MAX(ts) AS last, arg_max(y, ts) AS y FROM type_daily GROUP BY 1), range(1, 8) s(k)"


@query(sql("type_daily", "SELECT item_id, ts, y, 'fact' AS kind FROM type_daily UNION ALL SELECT item_id, ts, y, 'forecast' FROM nx", nx=_NAIVE_NEXT))
def overlay(spark, sf):
    t = fr.type_daily(spark, sf)
    ahead = registry.forecast("naive", t, S, H).select("item_id", "ts", F.col("yhat").alias("y"))
    return series.overlay(t, ahead, S)


@query(
    sql(
        "user_regular",
        """SELECT item_id, ts, y, NULL AS model FROM nv UNION ALL SELECT item_id, last + to_days(CAST(s.k AS INTEGER)), v, 'average'
        FROM (SELECT item_id, MAX(ts) AS last, AVG(y) AS v FROM c WHERE len >= 29 GROUP BY 1), range(1, 15) s(k)""".replace("v, 'average'", "ROUND(v, 6) + 0.0, 'average'"),
        c="SELECT *, COUNT(*) OVER (PARTITION BY item_id) AS len FROM user_regular",
        nv="SELECT item_id, last + to_days(CAST(s.k AS INTEGER)) AS ts, ROUND(y, 6) + 0.0 AS y FROM (SELECT item_id, MAX(ts) AS last, arg_max(y, ts) AS y FROM c WHERE len < 29 GROUP BY 1), range(1, 15) s(k)",
    )
)
def union_forecasts(spark, sf):
    """Model forecasts of the long series together with the naive fallback of the short ones."""
    grid = panel(spark, sf)
    long, _ = regular.split_short(grid, S, 14)
    by_model = registry.forecast("average", long, S, 14).select("item_id", "ts", F.col("yhat").alias("y"), F.lit("average").alias("model"))
    return rounded(series.union_forecasts(by_model, regular.naive_fallback(grid, S, 14, "D")))
