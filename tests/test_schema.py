import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from ledgerflow.schema import Column, InferenceError, SchemaError, apply_inferred, declared_type, enforce, infer_schema
from ledgerflow.tools.declare import RenderError, render


@pytest.mark.parametrize("sql,want", [
    ("select cast(null as int) v", "string"), ("select true v", "boolean"), ("select 1 v", "bigint"), ("select 1.5d v", "double"), ("select 1.25bd v", "decimal(38,2)"), ("select date '2024-01-01' v", "date"),
    ("select timestamp_ntz '2024-01-01' v", "timestamp_ntz"), ("select timestamp '2024-01-01' v", "timestamp"), ("select 'x' v", "string"), ("select X'00' v", "binary"), ("select double('nan') v", "string"),
])
def test_families(spark, sql, want):
    df = spark.sql(sql)
    schema = infer_schema(df)
    assert schema["v"].dataType.simpleString() == want
    assert apply_inferred(df, schema).schema["v"].dataType.simpleString() == want


def test_mixes_of_frames(spark):
    kind = lambda *q: infer_schema(*[spark.sql(f"select {x} as v") for x in q])["v"].dataType.simpleString()
    assert kind("1", "2.5d") == "double" and kind("1", "2.5bd") == "decimal(38,1)" and kind("date '2024-01-01'", "timestamp_ntz '2024-01-01'") == "timestamp_ntz"
    assert kind("1", "'x'") == "string" and kind("true", "1") == "string"
    with pytest.raises(InferenceError):
        kind("timestamp '2024-01-01'", "date '2024-01-01'")
    with pytest.raises(InferenceError):
        infer_schema(spark.sql("select array(1) as v"))


def test_nan_becomes_null(spark):
    df = spark.sql("select explode(array(1.5d, double('nan'))) as v")
    assert [r.v for r in apply_inferred(df, infer_schema(df)).collect()] == [1.5, None]


@pytest.mark.parametrize("kind,value,type_", [
    ("SMALLINT", 40000, "int"), ("NUMERIC(4, 2)", Decimal("1.239"), "decimal(10,3)"), ("NUMERIC(4, 2)", Decimal("123.45"), "decimal(10,2)"), ("VARCHAR(2)", "abc", "string"), ("TEXT", "a\0b", "string"),
    ("NUMERIC(4, 2)", 1.5, "double"), ("DATE", dt.datetime(2024, 1, 1), "timestamp_ntz"), ("BOOLEAN", 1, "int"), ("BIGINT", 1.0, "double"), ("DOUBLE", float("inf"), "double"),
])
def test_refused(spark, kind, value, type_):
    with pytest.raises(SchemaError):
        enforce(spark.createDataFrame([(value,)], f"v {type_}"), (Column("v", kind),))


def test_accepted_in_declared_order(spark):
    df = spark.createDataFrame([("ab", Decimal("1.20"), 5, float("nan"))], "s string, d decimal(10,2), i bigint, f double")
    out = enforce(df, (Column("i", "SMALLINT", False), Column("d", "NUMERIC(5, 1)"), Column("s", "VARCHAR(2)"), Column("f", "DOUBLE PRECISION")))
    assert out.columns == ["i", "d", "s", "f"] and tuple(out.first()) == (5, Decimal("1.2"), "ab", None)
    assert out.schema["i"].dataType == T.ShortType()
    with pytest.raises(SchemaError, match="is null"):
        enforce(spark.sql("select cast(null as int) v"), (Column("v", "INTEGER", False),))
    with pytest.raises(SchemaError, match="declared columns"):
        enforce(df, (Column("s", "TEXT"),))


@pytest.mark.parametrize("bad", ["NUMERIC(50, 2)", "NUMERIC(2, 3)", "FLOAT(60)", "VARCHAR(0)", "CHAR(3)", "ENUM", "INTERVAL", "TEXT(4)"])
def test_types_that_cannot_be_declared(bad):
    with pytest.raises(SchemaError):
        declared_type(bad)


def test_render(spark):
    schema = spark.sql("select 1 as a, cast(1.5 as decimal(6,2)) as b, timestamp '2024-01-01' as t").schema
    text = render(schema, ("t",))
    assert 'Column("a", "INTEGER", nullable=False)' in text and 'Column("b", "NUMERIC(6, 2)"' in text and '"t"' not in text
    with pytest.raises(RenderError):
        render(spark.sql("select array(1) as v").schema)
