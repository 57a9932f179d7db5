"""Date and time functions. What can't be read is null; parse_date is the strict one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Russian month names, nominative and genitive.
MONTHS = {
    "январь": 1, "января": 1, "февраль": 2, "февраля": 2, "март": 3, "марта": 3, "апрель": 4, "апреля": 4,
    "май": 5, "мая": 5, "июнь": 6, "июня": 6, "июль": 7, "июля": 7, "август": 8, "августа": 8,
    "сентябрь": 9, "сентября": 9, "октябрь": 10, "октября": 10, "ноябрь": 11, "ноября": 11, "декабрь": 12, "декабря": 12,
}

_TIME = r"(?:[ T](\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?))?$"
DAY_FIRST = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})" + _TIME
YEAR_FIRST = r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})" + _TIME
#: Two digits are a year from 1969 to 2068.
SHORT_YEARS = ((r"^((?:[0-5]\d|6[0-8])-\d{1,2}-)", "20$1"), (r"^((?:69|[7-9]\d)-\d{1,2}-)", "19$1"))


def as_date(c: Column) -> Column:
    return F.to_date(c.try_cast("timestamp_ntz"))


def month_start(c: Column) -> Column:
    return F.trunc(as_date(c), "MM")


def date_year(c: Column) -> Column:
    return F.year(as_date(c))


def parse_timestamp(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of the first 19 characters, else null."""
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def month_of_text(c: Column, fmt: str = "dd.MM.yyyy") -> Column:
    return F.trunc(F.to_date(c, fmt), "MM")


def parse_date(c: Column, strict: bool = True) -> Column:
    """A time (timestamp_ntz) from a day-first or year-first date, with or without a time of day, or from "<month> <year>" and
    "<day> <month> <year>" with Russian month names; blank is null. What else there is raises, or is null if not strict."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    # a pattern that doesn't match leaves the text as it is, so one pass both tests and rewrites
    iso = F.regexp_replace(F.regexp_replace(s, DAY_FIRST, "$3-$2-$1 $4"), YEAR_FIRST, "$1-$2-$3 $4")
    for pattern, to in SHORT_YEARS:
        iso = F.regexp_replace(iso, pattern, to)
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def in_words(parts: Column) -> Column:
        day = F.coalesce(F.nullif(F.get(parts, F.lit(2)), F.lit("")), F.lit("1"))
        return F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.try_element_at(names, F.get(parts, F.lit(1))).cast("string"), F.lit("-"), day)

    norm = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), r"(?<![а-яё])г\.?(?![а-яё])", ""), r"\s+", " "), r"^[ .]+|[ .]+$", "")
    worded = _let(F.split(F.regexp_replace(norm, r"^(?:(\d{1,2}) )?([а-яё]+) (\d{4})$", "$3 $2 $1"), " "), in_words)
    text = F.when(F.rlike(iso, F.lit(r"^\d{4}-")), F.trim(iso)).otherwise(worded)
    found = text.try_cast("timestamp_ntz")
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("cannot read a date from "), s)).cast("timestamp_ntz"))
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("timestamp_ntz")).otherwise(found)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def elapsed_days(start: Column, end: Column) -> Column:
    """Days with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)


def day_difference(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def plus_time(c: Column, hours: int = 0, minutes: int = 0) -> Column:
    return c.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes), F.lit(0))
