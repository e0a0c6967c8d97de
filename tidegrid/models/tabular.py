"""Regression on lags, calendar, holidays, static columns and columns known ahead, one model for all series (MLlib).

Static columns (``spec.statics``) are hashed into ``STATIC_BUCKETS`` features, or more as their distinct values grow: numbers keep
their value, anything else is one feature per value. So a column may have any number of values, and none is gathered on the driver; values may share a feature.

Columns known ahead (``spec.known``: prices, promotions, a user's calendar as 0 and 1) are read at the date that is forecast, from the rows
without a target; a missing value counts as 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import FeatureHasher, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.calendar import TIME_FEATURES, is_fixed_holiday
from tidegrid.functions.grid import step_ahead
from tidegrid.models.baseline import LAST, covariates_in, known_rows, newest_rows, over_steps, statics_in
from tidegrid.session import checkpointed
from tidegrid.spec import SeriesSpec
from tidegrid.splits import join_stats, over_series

#: Normal equations of dependent features are solved step by step, on sums alone: go on until nothing moves.
_EXACT = {"tol": 1e-12, "maxIter": 1000}
# The regressors by menu name.
REGRESSORS = {
    "linear": lambda: LinearRegression(**_EXACT),
    "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0, **_EXACT),
    "lasso": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0, **_EXACT),
    "elastic_net": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.5, **_EXACT),
    "random_forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=123),
    "boosted_trees": lambda: GBTRegressor(maxIter=20, maxDepth=5, seed=123),
}
LAGS = (1, 2, 3, 7)
CALENDAR = ("dayofweek", "month", "day")
#: The least number of hashed features, and features to each distinct value.
STATIC_BUCKETS, ROOM = 64, 8


def _calendar(ts: Column, spec: SeriesSpec) -> list[Column]:
    parts = [TIME_FEATURES[n](ts).cast("double").alias(f"c_{n}") for n in CALENDAR]
    return [*parts, F.coalesce(is_fixed_holiday(ts), F.lit(False)).cast("double").alias("c_holiday")] if spec.holidays else parts


@dataclass(frozen=True)
class Features:
    """Turns rows with lags ``l1, ...``, calendar parts ``c_...`` and static columns ``__s_...`` into feature vectors."""

    lags: tuple[int, ...]
    calendar: tuple[str, ...]
    statics: tuple[str, ...]
    known: tuple[str, ...] = ()
    buckets: int = STATIC_BUCKETS

    @staticmethod
    def of(df: DataFrame, spec: SeriesSpec, lags: tuple[int, ...]) -> Features:
        return Features(lags, (*CALENDAR, "holiday") if spec.holidays else CALENDAR, tuple(statics_in(df, spec)), tuple(covariates_in(df, spec)))

    def sized(self, df: DataFrame) -> Features:
        """With as many hashed features as the static columns' values in ``df`` ask for: a power of two, ``ROOM`` to a value or more."""
        if not self.statics:
            return self
        kinds = {f.name: f.dataType for f in df.schema.fields}
        texts = [F.approx_count_distinct(F.col(f"`{c}`")) for c in self.statics if not isinstance(kinds[c], T.NumericType)]
        values = len(self.statics) - len(texts) + (sum(df.agg(*texts).first()) if texts else 0)
        return replace(self, buckets=max(STATIC_BUCKETS, 1 << (ROOM * values - 1).bit_length()))

    @property
    def carried(self) -> list[str]:
        return [f"__s_{i}" for i in range(len(self.statics))]

    @property
    def covariates(self) -> list[str]:
        return [f"__x_{i}" for i in range(len(self.known))]

    @property
    def kept(self) -> list[str]:
        """What a series carries from step to step."""
        return [*self.carried, *(["__ahead"] if self.known else [])]

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with the static columns as numbers or texts under the names that the features use."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        casts = {s: "double" if isinstance(kinds[c], T.NumericType) else "string" for s, c in zip(self.carried, self.statics, strict=True)}
        numbers = {x: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for x, c in zip(self.covariates, self.known, strict=True)}
        return df.withColumns({s: F.col(f"`{c}`").cast(casts[s]) for s, c in zip(self.carried, self.statics, strict=True)} | numbers)

    def at_step(self, step: int) -> list[Column]:
        """The columns known ahead, at a step of a series."""
        return [F.coalesce(F.col("__ahead")[step - 1][x], F.lit(0.0)).alias(x) for x in self.covariates]

    def with_ahead(self, state: DataFrame, df: DataFrame, spec: SeriesSpec, h: int) -> DataFrame:
        """``state`` with ``__ahead``, an element per step; ``df`` has the future in rows without a target."""
        if not self.known:
            return state
        values = F.struct(*self.covariates)
        future = self.prepared(df).where(F.col(spec.target).isNull()).groupBy(*spec.keys, F.col(spec.ts).alias("__on")).agg(F.max(values).alias("__v"))
        steps = state.select(*spec.keys, LAST, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
        steps = steps.withColumn("__on", step_ahead(F.col(LAST), F.col("step"), spec.freq))
        found = join_stats(steps, future, [*spec.keys, "__on"])
        arrays = found.groupBy(*spec.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "__v"))), lambda s: s["__v"]).alias("__ahead"))
        return join_stats(state, arrays, spec.keys)

    def transform(self, rows: DataFrame) -> DataFrame:
        inputs = [f"l{k}" for k in self.lags] + [f"c_{n}" for n in self.calendar] + self.covariates
        if self.statics:
            rows = FeatureHasher(inputCols=self.carried, outputCol="__statics", numFeatures=self.buckets).transform(rows)
            inputs.append("__statics")
        return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip").transform(rows)


def training_rows(df: DataFrame, spec: SeriesSpec, lags: tuple[int, ...] = LAGS, ahead: int = 1) -> DataFrame:
    """Rows ``(keys, features..., label)``: the target, its values ``ahead - 1 + k`` rows back, its date, its series' statics."""
    return _rows_ahead(_history(df, spec, lags, [ahead]), lags, ahead)


def _history(df: DataFrame, spec: SeriesSpec, lags: tuple[int, ...], aheads) -> DataFrame:
    """As ``training_rows`` for all of ``aheads`` at once: the values as many rows back as any of them needs, under ``__back<rows>``."""
    kind = Features.of(df, spec, lags)
    rows = known_rows(kind.prepared(df), spec, [*kind.carried, *kind.covariates])
    back = {f"__back{k}": _lag(spec.target, k) for k in sorted({k + a - 1 for k in lags for a in aheads})}
    rows = over_series(rows, spec, back, before=max(lags) + max(aheads) - 1)
    return rows.select(*spec.keys, *back, *kind.carried, *kind.covariates, *_calendar(F.col(spec.ts), spec), F.col(spec.target).alias("label"))


def _rows_ahead(history: DataFrame, lags: tuple[int, ...], ahead: int) -> DataFrame:
    others = [F.col(f"`{c}`") for c in history.columns if not c.startswith("__back")]
    back = [F.col(f"__back{k + ahead - 1}").alias(f"l{k}") for k in lags]
    return history.select(*others, *back).na.drop(subset=[f"l{k}" for k in lags])


def _lag(y: str, k: int):
    return lambda w: F.lag(y, k).over(w)


def _recent(df: DataFrame, spec: SeriesSpec, lags: tuple[int, ...]) -> DataFrame:
    """Per series its newest values, newest first (as many as the largest lag), its last date and its statics."""
    kind = Features.of(df, spec, lags)
    tail = newest_rows(kind.prepared(df), spec, max(lags), kind.carried)
    statics = [F.max_by(c, F.struct(*spec.order)).alias(c) for c in kind.carried]
    values = F.transform(F.array_sort(F.collect_list(F.struct("__r", spec.target))), lambda s: s[spec.target])
    return tail.groupBy(*spec.keys).agg(F.max(spec.ts).alias(LAST), values.alias("__y"), *statics)


def tabular(
    df: DataFrame, spec: SeriesSpec, h: int, regressor: str = "linear", lags: tuple[int, ...] = LAGS, strategy: str = "recursive"
) -> DataFrame:
    """Forecast every series with one regression trained on all of them.

    ``recursive``: one model; each step's forecast becomes a lag of the next. ``direct``: one model per step
    that only uses known values. Series with fewer rows than the largest lag repeat their last value. The forecasting
    side works on one row per series.

    Each value of ``spec.by`` (a fold, a sample) is a table of its own with a model of its own: a fold's model never
    sees rows that this fold holds out.
    """
    if strategy not in ("recursive", "direct"):
        raise ValueError(f"unknown strategy {strategy!r}; expected 'recursive' or 'direct'")
    one = _recursive if strategy == "recursive" else _direct
    if not spec.by:
        return one(df, spec, h, regressor, lags)
    out = None
    for value in df.select(*spec.by).distinct().orderBy(*spec.by).collect():
        own = df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(spec.by, value, strict=True)]))
        part = one(own, spec, h, regressor, lags)
        out = part if out is None else out.unionByName(part)
    return one(df, spec, h, regressor, lags) if out is None else out


def _fit(regressor: str, kind: Features, rows: DataFrame, kept: bool = False):
    """A fitted model, or None where no row has all lags. The rows are kept for the passes of the fit; a linear model's two
    passes read rows ``kept`` already as they are.

    Features that never vary say nothing and make the normal equations singular; the linear models do without them."""
    rows = kind.transform(rows).select("features", "label")
    if not (kept and isinstance(REGRESSORS[regressor](), LinearRegression)):
        rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        seen = rows.agg(Summarizer.metrics("count", "variance").summary(F.col("features")).alias("s")).select("s.*").first()
        if not seen["count"]:
            return None
        varying = [i for i, v in enumerate(seen["variance"].toArray()) if v > 0]
        model = REGRESSORS[regressor]()
        if not isinstance(model, LinearRegression) or not varying:
            return model.fit(rows)
        some = VectorSlicer(inputCol="features", outputCol="varying", indices=varying)
        return PipelineModel([some, model.setFeaturesCol("varying").fit(some.transform(rows))])
    finally:
        rows.unpersist()


def _split(df: DataFrame, spec: SeriesSpec, h: int, lags: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(state of the series long enough, naive forecast of the others)."""
    state = checkpointed(_recent(df, spec, lags))
    enough = F.size("__y") >= max(lags)
    return state.where(enough), over_steps(state.where(~enough), spec, h, F.col("__y")[0])


def _recursive(df: DataFrame, spec: SeriesSpec, h: int, regressor: str, lags: tuple[int, ...]) -> DataFrame:
    kind = Features.of(df, spec, lags).sized(df)
    state, short = _split(df, spec, h, lags)
    model = _fit(regressor, kind, training_rows(df, spec, lags))
    if model is None:
        return short.unionByName(over_steps(state, spec, h, F.col("__y")[0]))
    state = checkpointed(kind.with_ahead(state, df, spec, h).withColumn("__out", F.array().cast("array<double>")))
    for step in range(1, h + 1):
        at = step_ahead(F.col(LAST), F.lit(step), spec.freq)
        wide = state.select("*", *[F.col("__y")[k - 1].alias(f"l{k}") for k in lags], *_calendar(at, spec), *kind.at_step(step))
        scored = model.transform(kind.transform(wide))
        newest = F.slice(F.concat(F.array("prediction"), "__y"), 1, max(lags))
        state = scored.select(*spec.keys, LAST, *kind.kept, newest.alias("__y"), F.concat("__out", F.array("prediction")).alias("__out"))
        if step % 5 == 0:
            state = checkpointed(state)
    steps = state.select(*spec.keys, LAST, F.posexplode("__out").alias("__i", "yhat")).withColumn("step", F.col("__i") + 1)
    return short.unionByName(steps.select(*spec.keys, "step", step_ahead(F.col(LAST), F.col("step"), spec.freq).alias(spec.ts), "yhat"))


def _direct(df: DataFrame, spec: SeriesSpec, h: int, regressor: str, lags: tuple[int, ...]) -> DataFrame:
    kind = Features.of(df, spec, lags).sized(df)
    state, out = _split(df, spec, h, lags)
    state = kind.with_ahead(state, df, spec, h)
    if kind.known:
        state = checkpointed(state)
    # The models of all steps are trained on one reading of the series.
    history = _history(df, spec, lags, range(1, h + 1)).drop(*spec.keys).persist(StorageLevel.DISK_ONLY)
    try:
        models = [_fit(regressor, kind, _rows_ahead(history, lags, step), kept=True) for step in range(1, h + 1)]
    finally:
        history.unpersist()
    for step, model in enumerate(models, 1):
        at = step_ahead(F.col(LAST), F.lit(step), spec.freq)
        wide = state.select("*", *[F.col("__y")[k - 1].alias(f"l{k}") for k in lags], *_calendar(at, spec), *kind.at_step(step), at.alias("__at"))
        scored = model.transform(kind.transform(wide)) if model else wide.withColumn("prediction", F.col("__y")[0])
        out = out.unionByName(scored.select(*spec.keys, F.lit(step).alias("step"), F.col("__at").alias(spec.ts), F.col("prediction").alias("yhat")))
    return out
