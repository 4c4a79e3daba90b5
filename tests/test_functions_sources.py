"""Scalar helpers, JDBC catalog SQL texts and estate fault isolation."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.functions import names as N
from lakescope.functions import render as RD
from lakescope.functions import types as TY
from lakescope.operators import estate as ES
from lakescope.operators import refs as E
from lakescope.sources import catalog as C
from lakescope.sources import jdbc as J
from tests import shop
from tests.conftest import rows


def test_name_helpers(spark):
    df = spark.createDataFrame([("a]b", "[dbo].[T]", "dbo.T", "x.y.z")], "q string, b string, two string, three string")
    r = df.select(N.quote_ident("q").alias("q"), N.strip_brackets("b").alias("b"), N.last_part("two").alias("l"),
                  N.qualify("two", F.lit("Db")).alias("q2"), N.qualify("three", F.lit("Db")).alias("q3"),
                  N.dot_count("three").alias("d")).first()
    assert (r.q, r.b, r.l, r.q2, r.q3, r.d) == ("[a]]b]", "dbo.T", "T", "Db.dbo.T", "x.y.z", 2)


def test_type_helpers(spark):
    df = spark.createDataFrame([("int", "bigint", "nvarchar", -1, None, None), ("decimal(18,2)", "money", "decimal", None, 18, 2),
                                ("uniqueidentifier", "nvarchar", "nvarchar", 50, None, None)],
                               "a string, b string, dt string, ml int, p int, s int")
    got = [tuple(r) for r in df.select(TY.type_match("a", "b"), TY.type_display("dt", "ml", "p", "s")).collect()]
    assert got == [("compatible", "nvarchar(MAX)"), ("compatible", "decimal(18,2)"), ("mismatch", "nvarchar(50)")]


def test_value_rendering(spark):
    df = spark.createDataFrame([(1.5, 12345678.125, dt.datetime(2024, 2, 3, 4, 5, 6, 7), "é" * 600, 7)],
                               "a double, b double, c timestamp_ntz, d string, e int")
    r = df.select(*[RD.value_text(F.col(c), df.schema[c].dataType).alias(c) for c in "abcde"]).first()
    assert (r.a, r.b, r.c, len(r.d), r.e) == ("1.500000", "12345678.125000", "2024-02-03 04:05:06.000007", 600, "7")
    assert RD.profile_class(T.BooleanType()) == "distinct" and RD.profile_class(T.BinaryType()) == "nulls"


def test_synonym_base_object_parsing(spark):
    df = spark.createDataFrame([("a",), ("s.a",), ("[db].[s].[a]",), ("srv.db.s.a",)], "b string")
    got = [tuple(r) for r in df.select(*E.parse_base_object(F.col("b"))).collect()]
    assert got == [(None, "dbo", "a"), (None, "s", "a"), ("db", "s", "a"), ("db", "s", "a")]


def test_jdbc_catalog_sql_texts():
    for sql in [J.COLUMNS_SQL, J.PRIMARY_KEYS_SQL, J.FOREIGN_KEYS_SQL, J.VIEWS_SQL, J.ROUTINES_SQL]:
        assert "NOT IN ('information_schema', 'pg_catalog', 'pg_toast', 'sys')" in sql
    assert "p.ordinal_position = f.position_in_unique_constraint" in J.FOREIGN_KEYS_SQL
    assert J.QUERY_TIMEOUT == 300


def test_estate_fault_isolation(spark):
    def good_loader():
        return {"columns": C.frame(spark, "columns", shop.COLUMNS[:3])}

    def bad_loader():
        raise ConnectionError("server unreachable")

    merged, failed = ES.read_estate(spark, {"Shop": good_loader, "Broken": bad_loader})
    assert merged["columns"].count() == 3
    assert rows(failed, "database_name") == [("Broken",)]
    assert "server unreachable" in failed.first().error
