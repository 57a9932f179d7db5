"""Operators on raw sheets: DataFrames of row_idx (int) and cells (array of strings).

Finding a header needs one small action; a header is a single row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.aggregates import quoted


class HeaderError(ValueError):
    pass


def normal_label(value: str | None) -> str | None:
    """A header's label with one kind of line end, no white space around it, and single spaces; None for a blank."""
    if value is None or value == "":
        return None
    lines = re.split(r"\r\n|\r|\n", value)
    joined = "\n".join([lines[0].rstrip(), *[x.strip() for x in lines[1:-1]], lines[-1].lstrip()] if len(lines) > 1 else lines)
    return re.sub(r"[\t ]+", " ", re.sub(r"\n+", "\n", joined)).strip()


def has_marker(raw: DataFrame, marker: str, column: int | None = None, within: int | None = None, least_columns: int = 1) -> bool:
    """Whether a sheet has the marker (in one column and the first rows, if told) and enough columns."""
    cell = F.exists("cells", lambda x: x == marker) if column is None else F.get("cells", F.lit(column)) == marker
    rows = raw if within is None else raw.filter(F.col("row_idx") <= within)
    width = F.size("cells") >= least_columns
    found = rows.agg(F.bool_or(F.coalesce(cell, F.lit(False))).alias("a"), F.bool_or(width).alias("b")).first()
    return bool(found.a) and bool(found.b)


def named_columns(header: list[str | None], policy: str = "error") -> list[tuple[int, str]]:
    """(place, name) of the columns with a label. Repeated labels: an error, the first, or numbered ("name.2")."""
    out, seen = [], {}
    for i, label in enumerate(map(normal_label, header)):
        if label is None:
            continue
        seen[label] = seen.get(label, 0) + 1
        if seen[label] == 1:
            out.append((i, label))
        elif policy == "error":
            raise HeaderError(f"the header has {label!r} more than once")
        elif policy == "number":
            out.append((i, f"{label}.{seen[label]}"))
        elif policy != "first":
            raise ValueError(f"policy {policy!r}")
    return out


def required_columns(header: list[str | None], required: list[str], policy: str = "error") -> list[tuple[int, str]]:
    """(place, name) of the required columns, in the order asked for; others may repeat or lack a label."""
    labels, wanted = [*map(normal_label, header)], [*map(normal_label, required)]
    if twice := sorted({x for x in wanted if wanted.count(x) > 1}, key=str):
        raise HeaderError(f"columns that are required more than once: {twice}")
    at = {name: [i for i, x in enumerate(labels) if x == w] for name, w in zip(required, wanted)}
    problems = [f"the header lacks {name!r}" for name, places in at.items() if not places]
    problems += [f"the header has {name!r} more than once" for name, places in at.items() if len(places) > 1 and policy == "error"]
    if problems:
        raise HeaderError("; ".join(problems))
    return [(places[0], name) for name, places in at.items()]


def columns_for(raw: DataFrame, places: list[tuple[int, str]]) -> DataFrame:
    return raw.select("row_idx", *[F.get("cells", F.lit(i)).alias(n) for i, n in places])


def header_row(raw: DataFrame, marker: str) -> tuple[int, list[str | None]]:
    """The first row that has the marker among its cells."""
    at = raw.filter(F.exists("cells", lambda x: x == marker)).agg(F.min(F.struct("row_idx", "cells")).alias("r")).first().r
    if at is None:
        raise HeaderError(f"no row has {marker!r}")
    return at.row_idx, list(at["cells"])


def promote_header(raw: DataFrame, marker: str, required: list[str] | None = None, policy: str = "error") -> DataFrame:
    """The rows below the marker's row, with its labels as names."""
    at, cells = header_row(raw, marker)
    places = required_columns(cells, required, policy) if required else named_columns(cells, policy)
    return columns_for(raw.filter(F.col("row_idx") > at), places)


def skip_rows(raw: DataFrame, n: int) -> DataFrame:
    first = raw.agg(F.min("row_idx")).first()[0]
    return raw if first is None else raw.filter(F.col("row_idx") >= first + n)


def skip_until(raw: DataFrame, condition: Column) -> DataFrame:
    """From the first row on that fits."""
    at = raw.filter(condition).agg(F.min("row_idx")).first()[0]
    return raw.limit(0) if at is None else raw.filter(F.col("row_idx") >= at)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate over all columns tells which."""
    counts = df.agg(*[F.count(quoted(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if counts[i]])
