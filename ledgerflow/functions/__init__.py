"""Scalar functions as column expressions; none of them is a Python UDF."""

from ledgerflow.functions.dates import as_date, date_year, day_difference, elapsed_days, month_of_text, month_start, parse_date, parse_timestamp, plus_time
from ledgerflow.functions.numbers import outline_level, in_range, is_one, lenient, missing_to_null, sla_flag, truthy, truthy_or, whole_scale, work_minutes
from ledgerflow.functions.text import ERROR_LITERALS, blank_to_null, clean_errors, duration_minutes, first_date_text, group_label, hierarchy_label, literal_map, replace_values, signature, strip_all, text_like

__all__ = [
    "ERROR_LITERALS", "as_date", "blank_to_null", "clean_errors", "date_year", "day_difference", "duration_minutes", "elapsed_days", "first_date_text", "group_label", "hierarchy_label",
    "in_range", "is_one", "lenient", "literal_map", "missing_to_null", "month_of_text", "month_start", "outline_level", "parse_date", "parse_timestamp", "plus_time", "replace_values", "signature",
    "sla_flag", "strip_all", "text_like", "truthy", "truthy_or", "whole_scale", "work_minutes",
]
