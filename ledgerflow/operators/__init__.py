"""Dataflow operators: functions from DataFrames to DataFrames, all of them plain plans."""

from ledgerflow.operators.aggregates import any_of, bounds, bounds_across, collapse_extremes, family_sets, null_count, row_count, sum_by, sum_or_zero
from ledgerflow.operators.headers import columns_for, drop_empty_columns, has_marker, named_columns, normal_label, promote_header, required_columns, skip_rows, skip_until
from ledgerflow.operators.hierarchy import outline_leaves
from ledgerflow.operators.joins import first_wins, chained_lookup, in_scope, lookup, missing_keys, upsert
from ledgerflow.operators.projections import Contract, apply_types, assign, drop_columns, keep_columns, project, rename, strict_cast, types_by_name
from ledgerflow.operators.reshape import backfill_row, calendar, first_stage, month_spans, non_null_count, row_least, split_parts, to_rows
from ledgerflow.operators.sets import levels_first, union_aligned, union_same

__all__ = [
    "Contract", "any_of", "apply_types", "assign", "backfill_row", "bounds", "bounds_across", "calendar", "chained_lookup", "collapse_extremes", "columns_for", "drop_columns", "drop_empty_columns", "family_sets", "first_stage",
    "first_wins", "has_marker", "in_scope", "keep_columns", "levels_first", "lookup", "missing_keys", "month_spans", "named_columns", "non_null_count", "normal_label", "null_count", "outline_leaves", "project", "promote_header", "rename",
    "required_columns", "row_count", "row_least", "skip_rows", "skip_until", "split_parts", "strict_cast", "sum_by", "sum_or_zero", "to_rows", "types_by_name", "union_aligned", "union_same", "upsert",
]
