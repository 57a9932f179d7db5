import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow import operators as O
from ledgerflow.operators.headers import HeaderError
from ledgerflow.operators.projections import CastError, ContractError


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def walk(levels, labels, deepest):
    """Row by row, what outline_leaves must give."""
    now, out = [None] * deepest, []
    for i, (n, label) in enumerate(zip(levels, labels)):
        now = now[: n - 1] + [label] + [None] * (deepest - n)
        if (levels[i + 1] if i + 1 < len(levels) else 0) > n:
            continue
        have = [x for x in now if x is not None]
        if have:
            out.append((*have[:-1], *[None] * (deepest - len(have)), have[-1], i))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_outline_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    levels = [1]
    for _ in range(60):
        levels.append(rng.randint(1, min(4, levels[-1] + 2)))
    labels = [rng.choice([None, f"l{i}"]) for i in range(len(levels))]
    df = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(zip(levels, labels))], "pos int, level int, label string")
    assert rows(O.outline_leaves(df, "level", "label", "pos")) == sorted(walk(levels, labels, max(levels)), key=repr)


def test_outline_edges(spark):
    flat = spark.createDataFrame([(0, 0, "a"), (1, 0, "b")], "pos int, level int, label string")
    assert rows(O.outline_leaves(flat, "level", "label", "pos")) == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="invalid outline level"):
        rows(O.outline_leaves(spark.createDataFrame([(0, 1, "a"), (1, 0, "b")], "pos int, level int, label string"), "level", "label", "pos"))


@pytest.mark.parametrize("seed", range(3))
def test_collapse_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), i, *[rng.choice([None, rng.randint(0, 9)]) for _ in range(3)]) for i in range(40)]
    got = rows(O.collapse_extremes(spark.createDataFrame(data, "k string, p int, x int, y int, z int"), ["k"], ["x", "y", "z"], "p"))
    want = []
    for k in {r[0] for r in data}:
        g = [r for r in data if r[0] == k]
        n = lambda r: sum(v is not None for v in r[2:])
        lo, hi = min(g, key=lambda r: (n(r), r[1])), min(g, key=lambda r: (-n(r), r[1]))
        want.append((k, *[min((v for v in p if v is not None), default=None) for p in zip(lo[2:], hi[2:])]))
    assert got == sorted(want, key=repr)


def test_lookup_tells_null_values_from_missing_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    dim = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", None, 2)], "k string, v string, p int")
    assert rows(O.lookup(df, "k", dim, "k", "v", "o", F.lit("none"), position="p")) == sorted([("a", "1"), ("b", None), ("c", "none"), (None, "none")], key=repr)


def test_scope_with_null_keys(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    scope = spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (None, "r")], "k int, v string")
    assert rows(O.in_scope(df, scope, ["k"])) == [(1, "x", "p"), (1, "x", "q")]
    assert len(rows(O.in_scope(df, scope, ["k"], null_keys=True))) == 3


def test_months(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2024, 3, 1)), (None, dt.date(2024, 1, 1))], "a date, b date")
    got = [(r.month, r.status) for r in O.month_spans(df, "a", "b").collect()]
    assert got == [(dt.date(2024, 1, 1), "open"), (dt.date(2024, 2, 1), "open"), (dt.date(2024, 3, 1), "closed")]
    with pytest.raises(Exception, match="ends before"):
        O.month_spans(df.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("b is not null"), "a", "b").collect()


def test_backfill_and_repair(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 5), None, dt.datetime(2024, 2, 7)), (dt.date(2024, 3, 9), None, None)], "m date, a timestamp_ntz, b timestamp_ntz")
    assert [r.a for r in O.backfill_row(O.first_stage(df, ["a", "b"], "m"), ["a", "b"]).collect()] == [dt.datetime(2024, 2, 7), dt.datetime(2024, 3, 1, 14, 10)]


def test_headers(spark):
    raw = spark.createDataFrame([(1, ["report", None]), (3, [" Name\r\n x ", "", "Id"]), (5, ["a", "b", "1"]), (6, ["c"])], "row_idx int, cells array<string>")
    got = O.promote_header(raw, "Id")
    assert got.columns == ["row_idx", "Name\nx", "Id"] and rows(got) == [(5, "a", "1"), (6, "c", None)]
    with pytest.raises(HeaderError):
        O.promote_header(raw, "nowhere")
    assert O.named_columns(["a", None, "a"], "number") == [(0, "a"), (2, "a.2")] and O.named_columns(["a", "a"], "first") == [(0, "a")]
    with pytest.raises(HeaderError):
        O.named_columns(["a", "a"])
    with pytest.raises(HeaderError):
        O.required_columns(["a", "b"], ["c"])
    assert O.has_marker(raw, "Id") and not O.has_marker(raw, "Id", column=0) and not O.has_marker(raw, "Id", within=2)
    assert rows(O.skip_rows(raw, 3))[0][0] == 5 and O.skip_until(raw, F.get("cells", F.lit(0)) == "a").count() == 2


def test_contract_and_projection_errors(spark):
    df = spark.createDataFrame([(1, 2)], "`А б` int, c int")
    assert O.project(df, O.Contract({"А б": "lev.1"}, {"n": F.lit(0)})).columns == ["lev.1", "n"]
    for bad in ({"c": "Upper"}, {"c": "x", "А б": "x"}, {"c": "x\n"}):
        with pytest.raises(ContractError):
            O.Contract(bad)
    with pytest.raises(ContractError):
        O.project(df, O.Contract({"zz": "x"}))
    with pytest.raises(ContractError):
        O.drop_columns(df, "zz")
    assert O.drop_columns(df, "zz", strict=False).columns == df.columns


def test_strict_cast_reports_samples(spark):
    df = spark.createDataFrame([(" 1 ",), ("",), ("2.0",), (None,)], "v string")
    assert rows(O.strict_cast(df, {"v": "int"})) == sorted([(1,), (None,), (2,), (None,)], key=repr)
    with pytest.raises(CastError, match=r"2 values.*'1.5', 'x'"):
        O.strict_cast(spark.createDataFrame([("x",), ("1.5",), ("3",)], "v string"), {"v": "int"})
    assert O.types_by_name(["Дата входа", "Сумма, руб", "Имя"], {"date": ["дата"], "float": ["Сумма"]}) == {"Дата входа": "date", "Сумма, руб": "float"}


def test_unions_refuse_mixed_zones(spark):
    a = spark.sql("select timestamp_ntz '2024-01-01' as t")
    with pytest.raises(ContractError):
        O.union_same([a, spark.sql("select timestamp '2024-01-01' as t")])
    assert O.union_aligned([a, spark.sql("select 1 as x")]).columns == ["t", "x"]


def test_unpivot_and_sums(spark):
    df = spark.createDataFrame([("a", 0, None), ("b", 2, 3)], "k string, x int, y int")
    assert rows(O.to_rows(df, ["k"], ["x", "y"])) == [("a", "x", 0), ("b", "x", 2), ("b", "y", 3)]
    assert rows(O.to_rows(df, ["k"], ["x", "y"], keep="nonzero")) == [("b", "x", 2), ("b", "y", 3)]
    assert rows(O.sum_or_zero(df.filter("k = 'a'"), ["k"], {"s": "y"})) == [("a", 0)]
    assert O.drop_empty_columns(df.filter("k = 'a'")).columns == ["k", "x"]
