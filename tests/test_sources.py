"""Files, catalog tables, upserts, and the SQL sent to databases."""

from __future__ import annotations

import datetime as dt
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegrid.sources import files, jdbc, tables

SAMPLE = "id int, value double, flag boolean, date_col date, dt_col timestamp_ntz, str_col string"


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(
        [(i, i * 1.5, i % 2 == 0, dt.date(2024, 1, i), dt.datetime(2024, 1, i, 5), f"s{i}") for i in (1, 2, 3)], SAMPLE
    )


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex}"


@pytest.mark.parametrize("sep", files.SEPARATORS)
def test_csv_separator_is_found(spark, sample, tmp_path, sep):
    path = str(tmp_path / "f")
    files.write_csv(sample, path, sep=sep)
    back = files.read_csv(spark, path)
    assert back.columns == sample.columns
    assert sorted(r["value"] for r in back.collect()) == [1.5, 3.0, 4.5]
    assert files.detect_separator(spark, path) == sep


def test_csv_starts_with_a_byte_order_mark(sample, tmp_path):
    files.write_csv(sample.coalesce(1), str(tmp_path / "f"))
    (part,) = (tmp_path / "f").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,")


def test_one_column_falls_back_to_comma(spark, tmp_path):
    (tmp_path / "f.csv").write_text("only\n1\n2\n")
    assert files.read_csv(spark, str(tmp_path / "f.csv")).columns == ["only"]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.detect_separator(spark, str(tmp_path / "empty.csv"))


def test_create_and_upsert(spark, sample, name, tmp_path):
    tables.create_table(sample, name, str(tmp_path), ["id"])
    assert dict(spark.table(name).dtypes) == {
        "id": "double", "value": "double", "flag": "boolean", "date_col": "timestamp_ntz", "dt_col": "timestamp_ntz", "str_col": "string",
    }
    assert tables.primary_key(spark, name) == ["id"]
    for _ in range(2):  # twice makes no difference
        tables.upsert_table(sample, name)
        assert spark.table(name).count() == 3
    tables.upsert_table(spark.createDataFrame([(3, 9.0), (4, float("nan"))], "id int, value double"), name)
    got = {r["id"]: (r["value"], r["str_col"]) for r in spark.table(name).collect()}
    assert got == {1.0: (1.5, "s1"), 2.0: (3.0, "s2"), 3.0: (9.0, "s3"), 4.0: (None, None)}


def test_create_table_errors(spark, sample, name, tmp_path):
    with pytest.raises(TypeError):
        tables.create_table(sample, name, str(tmp_path), "id")
    with pytest.raises(ValueError, match="not a column"):
        tables.create_table(sample, name, str(tmp_path), ["absent"])
    tables.create_table(sample, name, str(tmp_path))
    with pytest.raises(ValueError, match="already exists"):
        tables.create_table(sample, name, str(tmp_path))


def test_without_a_key_rows_are_appended(spark, sample, name, tmp_path):
    tables.create_table(sample, name, str(tmp_path))
    tables.upsert_table(sample, name)
    tables.upsert_table(sample, name)
    assert spark.table(name).count() == 6


def test_dates_in_three_encodings_land_on_the_same_day(spark, name, tmp_path):
    first = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "id int, date_col timestamp_ntz")
    second = spark.createDataFrame([(3, dt.date(2024, 1, 3)), (4, dt.date(2024, 1, 4))], "id int, date_col date")
    third = spark.createDataFrame([(5, "2024-01-05"), (6, "2024-01-06")], "id int, date_col string")
    tables.create_table(first, name, str(tmp_path), ["id"])
    for df in (first, second, tables.forecast_rows(third)):
        tables.upsert_table(df, name)
    assert rows(spark.table(name), "id") == [(float(i), dt.datetime(2024, 1, i)) for i in range(1, 7)]


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    source = spark.createDataFrame([(2, 20.0, 1), (2, None, 2), (3, 30.0, 3)], "k int, v double, seq int")
    assert rows(tables.upsert(target, source, ["k"], "seq"), "k") == [(1, "a", 1.0), (2, "b", None), (3, None, 30.0)]
    only_keys = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(tables.upsert(target, only_keys, ["k"]), "k") == [(1, "a", 1.0), (2, "b", 2.0), (3, None, None)]
    with pytest.raises(ValueError, match="lacks key"):
        tables.upsert(target, source, ["s"])


def test_schema_check(spark, sample):
    assert tables.schema_matches(sample, sample)
    assert not tables.schema_matches(spark.createDataFrame([(1,)], "other int"), sample)
    fits = spark.createDataFrame([(1, 2)], "ID long, VALUE int")
    assert tables.schema_matches(fits, sample)
    assert not tables.schema_matches(spark.createDataFrame([(1.5,)], "id double"), sample)


def test_save_forecast_checks_the_table(spark, name, tmp_path):
    f = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0, 0.5)], "item_id string, ts string, y double, `0.1` double")
    tables.save_forecast(f, name, True, str(tmp_path), ["item_id", "ts"])
    assert rows(spark.table(name)) == [("a", dt.datetime(2024, 1, 1), 1.0)]
    with pytest.raises(ValueError, match="does not fit"):
        tables.save_forecast(f.withColumnRenamed("y", "z"), name, False)
    with pytest.raises(ValueError, match="empty"):
        tables.save_forecast(f.limit(0), name, False)


def test_table_rows_limits(spark):
    df = spark.range(10)
    assert tables.table_rows(df, 3, ["id"]).count() == 3
    assert tables.table_rows(df).count() == 10
    assert tables.table_rows(df, 10**10).count() == 10
    for bad in (0, 10**10 + 1):
        with pytest.raises(ValueError, match="limit"):
            tables.table_rows(df, bad)


# No database is started for tests: the statements are checked as text.


def test_create_table_statement(sample):
    assert jdbc.create_table_sql(sample, "public", "t", ["id"]) == (
        'CREATE TABLE "public"."t" ("id" DOUBLE PRECISION, "value" DOUBLE PRECISION, "flag" BOOLEAN, '
        '"date_col" TIMESTAMP, "dt_col" TIMESTAMP, "str_col" TEXT, PRIMARY KEY ("id"))'
    )
    with pytest.raises(ValueError, match="quotes"):
        jdbc.quoted("a", 'b"; DROP')


def test_upsert_statements_in_a_database():
    import duckdb

    con = duckdb.connect()
    con.execute('CREATE TABLE t (k INT PRIMARY KEY, v DOUBLE, s TEXT); CREATE TABLE stg (k INT, v DOUBLE)')
    con.execute("INSERT INTO t VALUES (1, 1, 'a'), (2, 2, 'b'); INSERT INTO stg VALUES (2, NULL), (3, 30)")
    for statement in jdbc.upsert_sql(["k", "v"], None, "t", "stg", ["k"]):
        con.execute(statement)
    assert con.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, 1.0, "a"), (2, None, "b"), (3, 30.0, None)]
    assert jdbc.upsert_sql(["k"], "s", "t", "stg", [])[0].startswith('INSERT INTO "s"."t"')


def test_columns_match_whatever_their_case(spark):
    target = spark.createDataFrame([("a", 1, 1.0)], "item_id string, ts int, Y double")
    source = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], "ITEM_ID string, ts int, y double")
    assert rows(tables.upsert(target, source, ["Item_Id", "ts"]), "item_id") == [("a", 1, 2.0), ("b", 1, 3.0)]
    with pytest.raises(ValueError, match="lacks columns"):
        tables.upsert(target, source.withColumn("more", source["y"]), ["item_id", "ts"])
    with pytest.raises(Exception, match="repeat a key"):
        tables.upsert(target, source.union(source), ["item_id", "ts"]).collect()


def test_upsert_replaces_only_the_buckets_it_hits(spark, tmp_path):
    def made(lo, hi, shift):
        return spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("item"), (F.col("id") % 5).alias("n"), (F.col("id") * 0.5 + shift).alias("v"))

    name = "bucketed_upsert"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.create_table(made(0, 1, 0), name, str(tmp_path / "t"), ["item", "n"], buckets=40)
    tables.upsert_table(made(0, 4000, 0), name)
    files = {str(f): f.parent.name for f in (tmp_path / "t").rglob("*.parquet")}
    assert len(set(files.values())) == 40
    more = made(100, 110, 1000).union(made(9000, 9003, 0))
    want = sorted(tuple(r) for r in tables.upsert(tables.stored_rows(spark, name), tables.as_stored(more), ["item", "n"]).collect())
    tables.upsert_table(more, name)
    after = {str(f): f.parent.name for f in (tmp_path / "t").rglob("*.parquet")}
    changed = {bucket for f, bucket in {**files, **after}.items() if f not in files or f not in after}
    assert 0 < len(changed) <= 13 and len(set(after) & set(files)) == 40 - len(changed)
    assert sorted(tuple(r) for r in tables.stored_rows(spark, name).collect()) == want
    assert len(want) == 4003
    with pytest.raises(ValueError, match="lacks key columns"):
        tables.upsert_table(more.drop("n"), name)
    tables.upsert_table(more.limit(0), name)
    tables.upsert_table(more.select(F.col("item").alias("ITEM"), "n", F.lit(None).cast("double").alias("V"), F.lit(1).alias("o")), name, order="o")
    assert spark.table(name).where("v IS NULL").count() == 13
    assert spark.table(name).count() == 4003
    with pytest.raises(ValueError, match="primary key"):
        tables.create_table(more, "bucketed_none", str(tmp_path / "u"), buckets=4)
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize(
    "lines, sep",
    [
        (['date,"price; EUR"', '2024-01-01,"1; 2"'], ","),
        (["a;b,c;d", "1;2,5;3", "4;5,5;6"], ";"),
        (["note, more;x", "1;2", "3;4"], ";"),
        (["a\tb", "1,5\t2,5"], "\t"),
        (["a^b", "1^2"], "^"),
        (["date and time", "2024-01-01"], ","),
        (["one", "1"], ","),
    ],
)
def test_the_separator_agrees_with_most_lines(lines, sep):
    assert files.separator_of(lines) == sep


def test_a_quoted_header_reads_as_two_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('date,"price; EUR"\n2024-01-01,5\n')
    assert files.read_csv(spark, str(path)).columns == ["date", "price; EUR"]


def test_ranges_along_any_key_meet_every_row_once():
    con = duckdb.connect()
    con.execute("""CREATE TABLE "t" AS SELECT CASE WHEN i % 3 = 0 THEN 'it''s' ELSE 'k' || (i % 40) END AS "a b",
        TIMESTAMP '2024-01-01' + to_seconds(i) AS at, i AS n FROM range(1000) r(i)""")
    for keys in (["n"], ["a b", "at"], ["at"]):
        cuts = con.execute(jdbc.cuts_sql(jdbc.quoted(None, "t"), keys, 90)).fetchall()
        parts = [con.execute(f'SELECT list(n) FROM "t" WHERE {p}').fetchone()[0] for p in jdbc.range_predicates(keys, cuts)]
        assert sorted(n for p in parts for n in p) == list(range(1000))
        assert len(parts) == 12 and max(map(len, parts)) <= 91
    assert jdbc.range_predicates(["n"], []) == ["1 = 1"]
