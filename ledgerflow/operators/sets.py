"""Unions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame

from ledgerflow.operators.aggregates import quoted
from ledgerflow.operators.projections import ContractError


def union_same(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns, whatever their order; dates with and without a zone don't mix."""
    head = frames[0]
    for df in frames[1:]:
        if sorted(df.columns) != sorted(head.columns):
            raise ContractError(f"columns differ: {df.columns} and {head.columns}")
        a, b = dict(head.dtypes), dict(df.dtypes)
        if mixed := [c for c in a if {a[c], b[c]} == {"timestamp", "timestamp_ntz"}]:
            raise ContractError(f"times with and without a zone: {', '.join(mixed)}")
    return reduce(DataFrame.unionByName, frames)


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def levels_first(df: DataFrame, prefix: str = "lev.", rest: list[str] | None = None) -> DataFrame:
    """The columns lev.1, lev.2, ... in order of their numbers, then the others (or those in rest)."""
    levels = [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)]
    others = [c for c in df.columns if c not in levels] if rest is None else rest
    return df.select(*[quoted(c) for c in (*sorted(levels, key=lambda c: int(c[len(prefix) :])), *others)])
