import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerflow import functions as X


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_minutes(spark):
    texts = ["2 часа 15 минут", "90 секунд", "1 ЧАС", "5 дней", "", None, "10минут 30секунд", "59 секунд"]
    assert values(spark, texts, X.duration_minutes(F.col("v"))) == [135, 1, 60, 0, 0, 0, 10, 0]


def test_strip_takes_all_white_space(spark):
    assert values(spark, ["  a b\t\n", "　", None], X.strip_all(F.col("v"))) == ["a b", "", None]


def test_error_texts(spark):
    assert values(spark, ["#n/a", " #ДЕЛ / 0! ", "ok", "", None, "#REF"], X.clean_errors(F.col("v"))) == [None, None, "ok", "", None, "#REF"]


def test_dates(spark):
    texts = ["01.02.2024", "2024-02-03", "Август 2023 г.", "5 мая 2022", "3/4/2021", " ", None]
    want = [dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 3), dt.datetime(2023, 8, 1), dt.datetime(2022, 5, 5), dt.datetime(2021, 4, 3), None, None]
    assert values(spark, texts, X.parse_date(F.col("v"))) == want
    with pytest.raises(Exception, match="cannot read a date"):
        values(spark, ["nonsense"], X.parse_date(F.col("v")))
    assert values(spark, ["nonsense", "31.02.2024"], X.parse_date(F.col("v"), strict=False)) == [None, None]


def test_hierarchy_labels(spark):
    assert values(spark, ["Отдел до 01.02", "Отдел (до мая)", "  ", "допуск", None], X.hierarchy_label(F.col("v"))) == ["Отдел", "Отдел", None, "допуск", None]


def test_levels_and_ones(spark):
    assert values(spark, ["2", " 3.9 ", "x", "", None], X.outline_level(F.col("v"))) == [2, 3, 0, 0, 0]
    assert values(spark, ["1", "1.0", None], X.is_one(F.col("v"), is_text=True)) == [True, False, False]


def test_lenient_int_goes_through_double(spark):
    assert values(spark, ["3.0", "3.5", "9007199254740993", "x", None], X.lenient(F.col("v"), "int")) == [3, None, 9007199254740993, None, None]


def test_truthy(spark):
    assert values(spark, [0, 2, None], X.truthy_or(F.col("v"), F.lit(9)), "int") == [9, 2, 9]
    assert values(spark, ["", "a", None], F.coalesce(X.truthy(F.col("v"), "text"), F.lit(False))) == [False, True, False]
