"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of spreadsheet errors, English and Russian.
ERROR_LITERALS = (
    "#N/A", "#N/A!", "#DIV/0", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?",
    "#NUM!", "#NULL!", "#GETTING_DATA", "#SPILL!", "#CALC!", "#FIELD!",
    "#BLOCKED!", "#UNKNOWN!",
    "#Н/Д", "#Н/Д!", "#ДЕЛ/0", "#ДЕЛ/0!", "#ЗНАЧ!", "#ССЫЛКА!", "#ИМЯ?",
    "#ЧИСЛО!", "#ПУСТО!",
)

# Minutes of each spelling of a unit of time.
UNIT_MINUTES = {
    "секунд": 1 / 60, "секунда": 1 / 60, "секунды": 1 / 60,
    "минут": 1, "минута": 1, "минуты": 1,
    "час": 60, "часов": 60, "часа": 60,
}

NO_GROUP = "-- нет --"


def strip_all(c: Column) -> Column:
    """Without white space of any script at both ends (trim() knows the space alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_all(c), F.lit(""))


def clean_errors(c: Column) -> Column:
    """Null for a spreadsheet's error text, whatever its case and spaces."""
    return F.when(F.upper(F.replace(strip_all(c), F.lit(" "), F.lit(""))).isin(*ERROR_LITERALS), None).otherwise(c)


def group_label(c: Column, default: str = NO_GROUP) -> Column:
    return F.coalesce(strip_all(c.cast("string")), F.lit(default))


def hierarchy_label(c: Column) -> Column:
    """A label up to its remark on the period (" до ..." or "(до ..."), null if nothing is left."""
    return blank_to_null(F.regexp_replace(strip_all(c.cast("string")), r"(?s)(\s+до\s+|\s*\(до).*$", ""))


def duration_minutes(c: Column) -> Column:
    """Whole minutes: of a text such as "2 часа 15 минут", or a number (or bool), which is cut to a whole one. Null is 0, unknown
    units count nothing."""
    text = F.lower(c.cast("string"))
    units = F.create_map(*[F.lit(x) for pair in ((k, float(v)) for k, v in UNIT_MINUTES.items()) for x in pair])
    pattern = r"(\d+)\s*([а-яА-Я]+)"  # fixed value: a number and its unit
    parts = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)),
        lambda n, u: n.cast("double") * F.coalesce(F.try_element_at(units, u), F.lit(0.0)),
    )
    in_words = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).cast("int")
    number = F.when(~F.rlike(F.typeof(c), F.lit("^(string|char|varchar|void)")), c.cast("string").try_cast("double").try_cast("int"))
    number = F.coalesce(number, F.when(F.typeof(c) == "boolean", (c.cast("string") == "true").cast("int")))
    return F.coalesce(number, in_words, F.lit(0))


def first_date_text(c: Column) -> Column:
    """The first date-like part (d.m.y with dots, slashes or dashes), else null."""
    return F.nullif(F.regexp_extract(c, r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", 0), F.lit(""))


def text_like(c: Column, part: str, at_start: bool = False) -> Column:
    """Whether the text has part (or begins with it); false for null."""
    return F.coalesce(F.startswith(c, F.lit(part)) if at_start else F.contains(c, F.lit(part)), F.lit(False))


def literal_map(c: Column, values: dict, default=None) -> Column:
    """values[c]; default for keys it doesn't have. A key that is there with None gives null."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def replace_values(c: Column, values: dict) -> Column:
    """values[c] where it is a key; else c."""
    out = c
    for k, v in values.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def signature(*columns: Column) -> Column:
    """MD5 of the columns as canonical JSON (an array in the order given)."""
    return F.md5(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}))
