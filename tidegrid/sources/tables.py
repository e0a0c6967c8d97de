"""Catalog tables: creating them from a schema, checking compatibility, upserting, saving forecasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.numeric import finite_or_null
from tidegrid.sources.dates import auto_convert_dates
from tidegrid.spec import SeriesSpec
from tidegrid.splits import with_positions

KEY_PROPERTY = "tidegrid.primaryKey"
PATH_PROPERTY = "tidegrid.path"
BUCKETS_PROPERTY = "tidegrid.buckets"
#: The last column of a table in buckets: the bucket of a row's key.
BUCKET = "key_bucket"
#: Names of the quantile columns a saved forecast leaves out.
QUANTILE_COLUMNS = tuple(str(round(i / 10, 1)) for i in range(1, 10))
MAX_LIMIT = 10**10


def storage_type(t: T.DataType) -> T.DataType:
    """The type a column is stored as: numbers DOUBLE, dates TIMESTAMP, booleans BOOLEAN, the rest text."""
    if isinstance(t, T.NumericType):
        return T.DoubleType()
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return T.TimestampNTZType()
    if isinstance(t, T.BooleanType):
        return t
    return T.StringType()


def storage_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, storage_type(f.dataType)) for f in schema.fields])


def as_stored(df: DataFrame) -> DataFrame:
    """``df`` in storage types; NaN and infinities become NULL."""
    clean = finite_or_null(df)
    return clean.select(*[F.col(f"`{f.name}`").cast(storage_type(f.dataType)).alias(f.name) for f in clean.schema.fields])


def check_keys(columns: list[str], primary_keys: list[str] | None) -> list[str]:
    if primary_keys is not None and not isinstance(primary_keys, list):
        raise TypeError("primary_keys must be a list")
    for k in primary_keys or []:
        if k not in columns:
            raise ValueError(f"primary key column {k!r} is not a column")
    return primary_keys or []


def create_table(df: DataFrame, table: str, path: str, primary_keys: list[str] | None = None, buckets: int = 0) -> None:
    """Create an empty table with the columns of ``df`` in storage types. Error if it exists.

    Data lives in a folder per version below ``path``; replacing the content means pointing the table at a new
    version, so readers never see half of it.

    With ``buckets`` above 0 rows lie in so many partitions by the hash of their primary key (column ``key_bucket``, which
    ``stored_rows`` leaves out), and an upsert replaces only the partitions that it has keys for, without keeping their
    old files. Choose it so that a bucket has some hundred megabytes."""
    spark = df.sparkSession
    keys = check_keys(df.columns, primary_keys)
    if spark.catalog.tableExists(table):
        raise ValueError(f"table {table!r} already exists")
    if buckets and not keys:
        raise ValueError("buckets need a primary key")
    if buckets and BUCKET in {c.lower() for c in df.columns}:
        raise ValueError(f"a table in buckets has a column {BUCKET} of its own")
    schema = storage_schema(df.schema)
    if buckets:
        schema = schema.add(BUCKET, T.IntegerType())
    location = f"{path.rstrip('/')}/v0"
    empty = spark.createDataFrame([], schema).write.mode("overwrite")
    (empty.partitionBy(BUCKET) if buckets else empty).parquet(location)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet {f'PARTITIONED BY ({BUCKET})' if buckets else ''} LOCATION '{location}' "
        f"TBLPROPERTIES ('{KEY_PROPERTY}' = '{','.join(keys)}', '{PATH_PROPERTY}' = '{path.rstrip('/')}', '{BUCKETS_PROPERTY}' = '{buckets}')"
    )


def _property(spark: SparkSession, table: str, name: str) -> str:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == name).collect()
    return rows[0]["value"] if rows else ""


def primary_key(spark: SparkSession, table: str) -> list[str]:
    return [k for k in _property(spark, table, KEY_PROPERTY).split(",") if k]


def stored_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table, without the column of its buckets."""
    return spark.table(table).drop(BUCKET) if _buckets(spark, table) else spark.table(table)


def _buckets(spark: SparkSession, table: str) -> int:
    return int(_property(spark, table, BUCKETS_PROPERTY) or 0)


def _in_bucket(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def last_row(row: Column, order: str | None) -> Column:
    """Of the rows of a key the last by ``order``; without an order a second row is an error."""
    if order:
        return F.max_by(row, F.col(order))
    repeated = F.raise_error(F.lit("source rows repeat a key; say by which column the last one is found"))
    return F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.any_value(row))


def respelled(source: DataFrame, target: DataFrame, order: str | None = None) -> tuple[DataFrame, str | None]:
    """``source`` with its columns spelled as in ``target``, and the order column's new name."""
    spelling = {c.lower(): c for c in target.columns}
    unknown = [c for c in source.columns if c.lower() not in spelling and c != order]
    if unknown:
        raise ValueError(f"the table lacks columns of the source: {', '.join(unknown)}")
    if len({c.lower() for c in source.columns}) < len(source.columns):
        raise ValueError("the source has columns that differ by case only")
    names = {c: spelling.get(c.lower(), c) for c in source.columns}
    return source.withColumnsRenamed(names), names.get(order, order)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``target`` after inserting ``source`` row by row, updating on a conflict of ``keys``.

    Of source rows with the same key the last by ``order`` counts (it is not stored unless the target has such
    a column); without an order, repeated keys are an error. Columns match whatever their case, and take the
    target's spelling. Columns the source lacks keep their value, and are NULL in new rows; columns the target lacks are
    an error. Without keys the source is appended. Keys must be columns of the source.
    """
    have = {c.lower() for c in source.columns}
    missing = [k for k in keys if k.lower() not in have]
    if missing:
        raise ValueError(f"source lacks key columns: {', '.join(missing)}")
    source, order = respelled(source, target, order)
    spelling = {c.lower(): c for c in target.columns}
    keys = [spelling[k.lower()] for k in keys]
    if not keys:
        return target.unionByName(source, allowMissingColumns=True)
    cols = [c for c in source.columns if c in target.columns]
    updates = [c for c in cols if c not in keys]
    row = F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in updates]) if updates else F.struct(F.lit(1).alias("one"))
    # An aggregate, not a window: repeated keys collapse before the shuffle.
    latest = last_row(row, order)
    new = source.groupBy(*[F.col(k).cast(target.schema[k].dataType).alias(f"__k_{k}") for k in keys]).agg(latest.alias("__new"))
    new = new.withColumn("__has", F.lit(True))
    cond = [target[k] == new[f"__k_{k}"] for k in keys]
    joined = target.join(new, cond, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(target[c], new[f"__k_{c}"]).alias(c))
        elif c in updates:
            out.append(F.when(F.col("__has"), F.col(f"__new.{c}")).otherwise(target[c]).alias(c))
        else:
            out.append(target[c])
    return joined.select(*out)


def upsert_table(source: DataFrame, table: str, order: str | None = None, update_on_key: bool = True) -> None:
    """Upsert into a catalog table made by ``create_table``, on its primary key; append if it has none."""
    spark = source.sparkSession
    keys = primary_key(spark, table) if update_on_key else []
    rows = as_stored(source)
    if not keys:
        rows, _ = respelled(rows, spark.table(table), order)
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.table(table).schema.fields]).write.insertInto(table)
        return
    buckets = _buckets(spark, table)
    if buckets:
        _upsert_buckets(rows, table, keys, order, buckets)
        return
    merged = upsert(spark.table(table), rows, keys, order)
    location = f"{_property(spark, table, PATH_PROPERTY)}/v{uuid.uuid4().hex}"
    merged.write.parquet(location)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
    spark.catalog.refreshTable(table)


def _upsert_buckets(rows: DataFrame, table: str, keys: list[str], order: str | None, buckets: int) -> None:
    """Replace the buckets that ``rows`` have keys of. Spark stages them and puts them in place when the job is committed."""
    spark = rows.sparkSession
    target = spark.table(table)
    missing = [k for k in keys if k.lower() not in {c.lower() for c in rows.columns}]
    if missing:
        raise ValueError(f"source lacks key columns: {', '.join(missing)}")
    rows, order = respelled(rows, target.drop(BUCKET), order)
    typed = rows.select(*[F.col(f"`{k}`").cast(target.schema[k].dataType).alias(k) for k in keys])
    hit = [r[0] for r in _in_bucket(typed, keys, buckets).select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    old = target.where(F.col(BUCKET).isin(hit)).drop(BUCKET)
    merged = _in_bucket(upsert(old, rows, keys, order), keys, buckets).select(*target.columns).repartition(BUCKET)
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        merged.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)
    spark.catalog.refreshTable(table)


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "text"


def schema_matches(df: DataFrame, table: DataFrame) -> bool:
    """Whether rows of ``df`` fit into ``table``: its columns are among the table's (whatever their case) and
    of the same kind; whole numbers also fit into fractional columns."""
    have = {f.name.lower(): _kind(f.dataType) for f in table.schema.fields}
    for f in df.schema.fields:
        want, got = have.get(f.name.lower()), _kind(f.dataType)
        if want is None or (want != got and not (got == "int" and want == "float")):
            return False
    return True


def forecast_rows(df: DataFrame) -> DataFrame:
    """A forecast as it is saved: without quantile columns, with date texts converted."""
    return auto_convert_dates(df.drop(*QUANTILE_COLUMNS))


def save_forecast(df: DataFrame, table: str, create_new: bool, path: str | None = None, primary_keys: list[str] | None = None, buckets: int = 0) -> None:
    """Create the table and fill it, or check that the forecast fits and upsert it."""
    rows = forecast_rows(df)
    if rows.isEmpty():
        raise ValueError("the forecast is empty")
    spark = df.sparkSession
    if create_new:
        if not path:
            raise ValueError("a new table needs a path")
        create_table(rows, table, path, primary_keys, buckets)
    elif not spark.catalog.tableExists(table) or not schema_matches(rows, stored_rows(spark, table)):
        raise ValueError(f"the forecast does not fit table {table!r}: check names and types of the columns")
    upsert_table(rows, table)


def table_rows(df: DataFrame, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows (any, without ``order``); None means all. The limit must be in 1..10^10."""
    if limit is None:
        return df
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if limit < 2**31:
        return (df.orderBy(*order) if order else df).limit(limit)
    if df.count() <= limit:
        return df
    if not order:
        raise ValueError("a limit of 2^31 or more needs an order")
    at = with_positions(df, SeriesSpec(id=None, ts=order[0], ties=tuple(order[1:])), "__at")
    return at.where(F.col("__at") < limit).drop("__at")
