"""Joins against scopes and lookup tables.

Which side is broadcast is left to Spark, which knows sizes; nothing here forces it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.aggregates import quoted


def in_scope(df: DataFrame, scope: DataFrame, keys: list[str], null_keys: bool = False) -> DataFrame:
    """df joined to the distinct rows of scope on keys: a row for each of a key's scope rows. Columns of scope that df has
    too get the suffix _scope. null_keys: null keys meet."""
    extra = [c for c in scope.columns if c not in keys]
    right = scope.distinct().select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[quoted(c).alias(f"{c}_scope" if c in df.columns else c) for c in extra])
    on = [quoted(c).eqNullSafe(F.col(f"_k{i}")) if null_keys else quoted(c) == F.col(f"_k{i}") for i, c in enumerate(keys)]
    return df.join(right, reduce(Column.__and__, on)).drop(*[f"_k{i}" for i in range(len(keys))])


def first_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of each key's rows the first by position: a minimum, combined before the shuffle, so a hot key sends a row per task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min(F.struct(quoted(position).alias("_p"), *[quoted(c).alias(c) for c in rest])).alias("_r")
    picked = df.groupBy(*map(quoted, keys)).agg(row)
    return picked.select(*[quoted(c) if c in keys else F.col("_r").getField(c).alias(c) for c in df.columns])


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, table_value: str, name: str, default: Column | None = None, position: str | None = None) -> DataFrame:
    """df with table's value for key as name; default where no key matches. A key that is there with a null value gives null.
    position: the first of a key's rows counts; else the key must be unique in table."""
    right = table if position is None else first_wins(table, [table_key], position)
    right = right.select(quoted(table_key).alias("_lk"), quoted(table_value).alias("_lv"), F.lit(True).alias("_lm"))
    value = F.when(F.col("_lm"), F.col("_lv")).otherwise(F.lit(None) if default is None else default)
    return df.join(right, quoted(key).eqNullSafe(F.col("_lk")), "left").withColumn(name, value).drop("_lk", "_lv", "_lm")


def chained_lookup(df: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]], name: str, default: Column | None = None) -> DataFrame:
    """The first table that has the key gives the value; tables: (table, key column, value column)."""
    out = F.lit(None) if default is None else default
    for i, (table, k, v) in reversed([*enumerate(tables)]):
        right = table.select(quoted(k).alias(f"_k{i}"), quoted(v).alias(f"_v{i}"), F.lit(True).alias(f"_m{i}"))
        df = df.join(right, quoted(key).eqNullSafe(F.col(f"_k{i}")), "left")
        out = F.when(F.col(f"_m{i}"), F.col(f"_v{i}")).otherwise(out)
    drop = [f"_{x}{i}" for i in range(len(tables)) for x in "kvm"]
    return df.withColumn(name, out).drop(*drop)


def missing_keys(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys known doesn't have."""
    return df.join(known.select(*map(quoted, keys)).distinct(), keys, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes in place of those with the same keys, and the new ones."""
    return missing_keys(current, changes, keys).unionByName(changes.select(*map(quoted, current.columns)))
