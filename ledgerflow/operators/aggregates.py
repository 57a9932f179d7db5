"""Aggregations. Null keys make groups of their own, as groupBy does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sum_by(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """measures: new name -> column."""
    return df.groupBy(*map(quoted, keys)).agg(*[F.sum(quoted(c)).alias(n) for n, c in measures.items()])


def sum_or_zero(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """As sum_by(), with 0 for groups whose values are all null."""
    return df.groupBy(*map(quoted, keys)).agg(*[F.coalesce(F.sum(quoted(c)), F.lit(0)).alias(n) for n, c in measures.items()])


def any_of(df: DataFrame, keys: list[str], condition: Column, name: str) -> DataFrame:
    return df.groupBy(*map(quoted, keys)).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias(name))


def bounds(df: DataFrame, column: str, low: str = "low", high: str = "high") -> DataFrame:
    return df.agg(F.min(quoted(column)).alias(low), F.max(quoted(column)).alias(high))


def bounds_across(ranges: list[tuple[DataFrame, str]], low: str = "low", high: str = "high") -> DataFrame:
    """The least and the greatest value of all (table, column) pairs; tables without values don't count."""
    each = [bounds(df, column, low, high) for df, column in ranges]
    return reduce(DataFrame.unionAll, each).agg(F.min(quoted(low)).alias(low), F.max(quoted(high)).alias(high))


def null_count(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in columns])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def collapse_extremes(df: DataFrame, keys: list[str], stages: list[str], position: str) -> DataFrame:
    """One row for each group: every stage has the smaller of what the group's sparsest and densest rows have (the rows with
    the fewest and the most non-null stages; the first by position of several). Both rows come from one aggregate over structs,
    combined before the shuffle (Spark sorts by key for it, as structs aren't updated in place); no group is joined to itself."""
    filled = sum((quoted(c).isNotNull().cast("int") for c in stages), F.lit(0))
    row = [quoted(position).alias("_p"), *[quoted(c).alias(c) for c in stages]]
    sparse = F.min(F.struct(filled.alias("_n"), *row)).alias("_sparse")
    dense = F.min(F.struct((-filled).alias("_n"), *row)).alias("_dense")
    both = df.groupBy(*map(quoted, keys)).agg(sparse, dense)
    least = [F.least(F.col("_sparse").getField(c), F.col("_dense").getField(c)).alias(c) for c in stages]
    return both.select(*map(quoted, keys), *least)


def family(column: str, kind: str) -> Column:
    """The family of a value's type: what its column is, but null for null, and numeric for other than whole floats."""
    names = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "numeric", "double": "numeric", "date": "date", "timestamp_ntz": "datetime_naive", "timestamp": "datetime_aware", "string": "text", "binary": "bytes"}
    name = "numeric" if kind.startswith("decimal") else names.get(kind, "other")
    c = quoted(column)
    missing = c.isNull() | F.isnan(c) if kind in ("float", "double") else c.isNull()
    return F.when(~missing, F.lit(name))


def family_sets(df: DataFrame) -> DataFrame:
    """For each column the sorted set of its values' families, in one aggregate over the whole table."""
    return df.agg(*[F.array_sort(F.collect_set(family(c, k))).alias(c) for c, k in df.dtypes])
