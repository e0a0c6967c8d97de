"""Tables of a database behind JDBC. Connection details are Spark options; nothing is kept here."""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.numeric import nan_to_null
from tidegrid.sources.tables import as_stored, check_keys, last_row, storage_schema

# SQL types of stored columns.
SQL_TYPES = {"double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "string": "TEXT"}


@dataclass(frozen=True)
class Jdbc:
    """URL, driver and credentials (``properties``) of a database."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)

    def options(self, **more: str) -> dict[str, str]:
        return {"url": self.url, **self.properties, **{k: v for k, v in more.items() if v is not None}}


def quoted(schema: str | None, table: str) -> str:
    """A quoted, qualified table name."""
    names = [n for n in (schema, table) if n]
    if any('"' in n for n in names):
        raise ValueError("names must not contain quotes")
    return ".".join(f'"{n}"' for n in names)


def literal(value) -> str:
    """A value of a key column in standard SQL."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def cuts_sql(name: str, keys: list[str], rows: int) -> str:
    """The keys of every ``rows``-th row in the order of the keys: where to cut the table into equal ranges."""
    columns = ", ".join(quoted(None, k) for k in keys)
    return f"SELECT {columns} FROM (SELECT {columns}, ROW_NUMBER() OVER (ORDER BY {columns}) AS place FROM {name}) q WHERE MOD(place, {rows}) = 0 ORDER BY {columns}"


def _from_on(keys: list[str], cut: tuple) -> str:
    """Whether a row's keys lie at or after ``cut``, compared column by column."""
    first, value = quoted(None, keys[0]), literal(cut[0])
    if len(keys) == 1:
        return f"{first} >= {value}"
    return f"({first} > {value} OR ({first} = {value} AND {_from_on(keys[1:], cut[1:])}))"


def range_predicates(keys: list[str], cuts: list[tuple]) -> list[str]:
    """Conditions that meet every row with non-NULL keys exactly once: before the first cut, between cuts, from the last one on."""
    starts = [_from_on(keys, c) for c in cuts]
    if not starts:
        return ["1 = 1"]
    between = [f"{a} AND NOT ({z})" for a, z in zip(starts, starts[1:])]
    return [f"NOT ({starts[0]})", *between, starts[-1]]


def primary_key(spark: SparkSession, jdbc: Jdbc, schema: str | None, table: str) -> list[str]:
    """The columns of the primary key as the driver reports them; none if there is no key."""
    with _connection(spark, jdbc) as connection:
        found = connection.getMetaData().getPrimaryKeys(None, schema, table)
        columns = []
        while found.next():
            columns.append((found.getShort("KEY_SEQ"), found.getString("COLUMN_NAME")))
    return [c for _, c in sorted(columns)]


def read_table(
    spark: SparkSession, jdbc: Jdbc, schema: str | None, table: str, partition_column: str | None = None, partitions: int = 32, rows_per_read: int = 1_000_000
) -> DataFrame:
    """A whole table. Up to ``rows_per_read`` rows are read at once; a larger one is cut along its primary key, which
    may be of any type and several columns, into ranges of so many rows, one task each. ``partition_column`` (a number,
    date or timestamp) asks for even ranges of its values instead. A larger table with neither is an error, since one task
    would have to read it all."""
    name = quoted(schema, table)
    reader = spark.read.format("jdbc").option("preferTimestampNTZ", True)

    def asked(statement: str):
        return reader.options(**jdbc.options(query=statement)).load()

    try:
        if partition_column is not None:
            column = quoted(None, partition_column)
            ends = asked(f"SELECT MIN({column}) AS a, MAX({column}) AS z FROM {name}").first()
            bounds = {} if ends[0] is None else {"partitionColumn": column, "lowerBound": str(ends[0]), "upperBound": str(ends[1]), "numPartitions": str(partitions)}
            df = reader.options(**jdbc.options(dbtable=name, **bounds)).load()
        elif asked(f"SELECT COUNT(*) AS n FROM {name}").first()[0] <= rows_per_read:
            df = reader.options(**jdbc.options(dbtable=name)).load()
        else:
            keys = primary_key(spark, jdbc, schema, table)
            if not keys:
                raise ValueError(f"more than {rows_per_read} rows and no primary key: name a partition_column")
            cuts = [tuple(r) for r in asked(cuts_sql(name, keys, rows_per_read)).collect()]  # one row per task
            df = spark.read.option("preferTimestampNTZ", True).jdbc(jdbc.url, name, predicates=range_predicates(keys, cuts), properties=jdbc.properties)
    except Exception as e:
        raise ValueError(f"table {table!r} cannot be read from schema {schema!r}: {e}") from e
    decimals = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return nan_to_null(df.withColumns(decimals))


def create_table_sql(df: DataFrame, schema: str | None, table: str, primary_keys: list[str] | None = None) -> str:
    keys = check_keys(df.columns, primary_keys)
    columns = [f"{quoted(None, f.name)} {SQL_TYPES[f.dataType.simpleString()]}" for f in storage_schema(df.schema).fields]
    if keys:
        columns.append(f"PRIMARY KEY ({', '.join(quoted(None, k) for k in keys)})")
    return f"CREATE TABLE {quoted(schema, table)} ({', '.join(columns)})"


def upsert_sql(columns: list[str], schema: str | None, table: str, staging: str, keys: list[str]) -> list[str]:
    """Statements that move a staging table of distinct keys into the target, in standard SQL."""
    t, s = quoted(schema, table), quoted(schema, staging)
    names = ", ".join(quoted(None, c) for c in columns)
    if not keys:
        return [f"INSERT INTO {t} ({names}) SELECT {names} FROM {s}"]
    same = " AND ".join(f"s.{quoted(None, k)} = {t}.{quoted(None, k)}" for k in keys)
    rest = [c for c in columns if c not in keys]
    out = []
    if rest:
        sets = ", ".join(f"{quoted(None, c)} = (SELECT s.{quoted(None, c)} FROM {s} s WHERE {same})" for c in rest)
        out.append(f"UPDATE {t} SET {sets} WHERE EXISTS (SELECT 1 FROM {s} s WHERE {same})")
    out.append(f"INSERT INTO {t} ({names}) SELECT {names} FROM {s} s WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {same})")
    return out


@contextmanager
def _connection(spark: SparkSession, jdbc: Jdbc):
    """A connection through the JVM's driver."""
    jvm = spark._jvm
    props = jvm.java.util.Properties()
    for k, v in jdbc.properties.items():
        props.setProperty(k, v)
    if "driver" in jdbc.properties:
        jvm.java.lang.Class.forName(jdbc.properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(jdbc.url, props)
    try:
        yield connection
    finally:
        connection.close()


def _execute(spark: SparkSession, jdbc: Jdbc, statements: list[str]) -> None:
    """Run statements in one transaction of the database."""
    with _connection(spark, jdbc) as connection:
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for s in statements:
                statement.execute(s)
            connection.commit()
        except Exception:
            connection.rollback()
            raise


def create_table(df: DataFrame, jdbc: Jdbc, schema: str | None, table: str, primary_keys: list[str] | None = None) -> None:
    """An empty table with the columns of ``df``; the database refuses if it exists."""
    _execute(df.sparkSession, jdbc, [create_table_sql(df, schema, table, primary_keys)])


def upsert_table(
    df: DataFrame, jdbc: Jdbc, schema: str | None, table: str, keys: list[str], order: str | None = None, batch: int = 10_000
) -> None:
    """Write ``df`` to a staging table in parallel batches, then let the database merge it on ``keys``."""
    check_keys(df.columns, keys)
    staging = f"{table}__staging_{uuid.uuid4().hex}"  # two writers never meet
    columns = [c for c in df.columns if c != order]
    row = F.struct(*columns)
    rows = df.groupBy(*keys).agg(last_row(row, order).alias("r")).select("r.*") if keys else df.select(*columns)
    stored = as_stored(rows)
    writer = stored.write.format("jdbc").options(**jdbc.options(dbtable=quoted(schema, staging), batchsize=str(batch)))
    writer.mode("errorifexists").save()  # the dialect of the database picks the column types
    _execute(df.sparkSession, jdbc, [*upsert_sql(columns, schema, table, staging, keys), f"DROP TABLE {quoted(schema, staging)}"])
