"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column, kind: str = "number") -> Column:
    """Neither null nor zero, an empty text or false. kind: number, text or bool."""
    none = {"number": 0, "text": "", "bool": False}[kind]
    return c.isNotNull() & (c != F.lit(none))


def truthy_or(c: Column, other: Column) -> Column:
    """c, or other where c is null or zero."""
    return F.when(truthy(c), c).otherwise(other)


def sla_flag(c: Column, limit) -> Column:
    """1 within the limit, else 0; null stays null."""
    return (c <= F.lit(limit)).cast("int")


def work_minutes(days: Column, minutes: Column, hours_a_day: int = 8) -> Column:
    return days * (hours_a_day * 60) + F.coalesce(minutes, F.lit(0))


def is_one(c: Column, is_text: bool = False) -> Column:
    """Equal to 1 as a number, or the text "1" (but not "1.0"); false for null."""
    return F.coalesce(c == F.lit("1") if is_text else c.try_cast("double") == 1, F.lit(False))


def outline_level(c: Column) -> Column:
    """A whole level of what a sheet has: texts and fractions are truncated, what can't be read is 0."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "").try_cast("double").try_cast("int"), F.lit(0))


LENIENT = {"str": "string", "float": "double", "int": "bigint", "date": "date", "datetime": "timestamp_ntz", "any": None}


def lenient(c: Column, kind: str) -> Column:
    """A cast that gives null for what it can't read. Whole numbers may come as texts such as "3.0"."""
    to = LENIENT[kind]
    if to is None:
        return c
    if kind == "int":
        d = c.try_cast("double")
        return F.coalesce(c.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint")))
    if kind == "date":
        return F.to_date(c.try_cast("timestamp_ntz"))
    return c.try_cast(to)


def missing_to_null(c: Column, is_float: bool) -> Column:
    return F.when(F.isnan(c), None).otherwise(c) if is_float else c


def in_range(c: Column, low, high) -> Column:
    return c.between(low, high)


def whole_scale(c: Column, scale: int) -> Column:
    """Whether a decimal has no digits beyond scale (nothing is rounded away)."""
    return F.round(c, scale) == c
