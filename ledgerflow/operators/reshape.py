"""Reshaping: unpivot, back-fill, month and calendar expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.aggregates import quoted


def to_rows(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value", keep: str = "filled", cast: str | None = None) -> DataFrame:
    """A row for each value column. keep: all, filled (not null) or nonzero (neither null nor 0)."""
    if cast:
        df = df.select(*map(quoted, ids), *[quoted(c).cast(cast).alias(c) for c in values])
    out = df.unpivot([quoted(c) for c in ids], [quoted(c) for c in values], name, value)
    if keep == "filled":
        return out.filter(quoted(value).isNotNull())
    if keep == "nonzero":
        return out.filter(quoted(value) != 0)
    if keep != "all":
        raise ValueError(f"keep {keep!r}")
    return out


def backfill_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """A null takes the next column's value that isn't."""
    filled = {c: F.coalesce(*map(quoted, columns[i:])) for i, c in enumerate(columns)}
    return df.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])


def first_stage(df: DataFrame, columns: list[str], month: str, hours: int = 14, minutes: int = 10) -> DataFrame:
    """Where all stages are null, the first one becomes the month's start plus a time of day."""
    none = F.coalesce(*[quoted(c).cast("timestamp_ntz") for c in columns]).isNull()
    at = F.trunc(quoted(month), "MM").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes), F.lit(0))
    first = F.when(none, at).otherwise(quoted(columns[0]).cast("timestamp_ntz"))
    return df.select(*[first.alias(c) if c == columns[0] else quoted(c) for c in df.columns])


def row_least(*columns: str) -> Column:
    """The least of a row's values that aren't null."""
    return F.least(*map(quoted, columns))


def non_null_count(*columns: str) -> Column:
    return sum((quoted(c).isNotNull().cast("int") for c in columns), F.lit(0))


def month_spans(df: DataFrame, start: str, end: str, month: str = "month", status: str = "status", last: str = "closed", other: str = "open") -> DataFrame:
    """A row for each month that [start, end] touches; the last has its own status. An end before its start raises."""
    a, b = F.trunc(quoted(start), "MM"), F.trunc(quoted(end), "MM")
    months = F.when(a.isNull() | b.isNull(), F.array().cast("array<date>")).otherwise(F.sequence(a, F.when(b >= a, b).otherwise(F.raise_error(F.lit("a span ends before it starts")).cast("date")), F.expr("interval 1 month")))
    out = df.withColumn(month, F.explode(months))
    return out.withColumn(status, F.when(quoted(month) == b, F.lit(last)).otherwise(F.lit(other)))


def calendar(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """The days of all years from the least low to the greatest high, with their parts."""
    b = ranges.agg(F.min(quoted(low)).alias("a"), F.max(quoted(high)).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    day = F.explode(F.sequence(F.make_date(F.year("a"), F.lit(1), F.lit(1)), F.make_date(F.year("b"), F.lit(12), F.lit(31)), F.expr("interval 1 day")))
    d = F.col("date")
    return b.select(day.alias("date")).select(
        "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.day(d).alias("day"), (F.weekday(d) + 1).alias("weekday"), F.trunc(d, "MM").alias("month_start"),
    )


def split_parts(c: Column, names: list[str], separator: str = " / ", missing: str | None = None) -> list[Column]:
    """The text's first parts as columns of these names; parts that it lacks are null, or missing."""
    parts = F.split(c, "\\Q" + separator + "\\E", -1)
    part = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), r"(?U)^\s+|\s+$", "")
    return [(F.coalesce(F.nullif(part(i), F.lit("")), F.lit(missing)) if missing is not None else part(i)).alias(n) for i, n in enumerate(names)]
