"""Projections, contracts and casts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import blank_to_null, lenient
from ledgerflow.operators.aggregates import quoted

COLUMN_NAME = re.compile(r"[a-z_][a-z0-9_]*(?:\.[a-z0-9_]+)*")
TABLE_NAME = re.compile(r"[a-z_][a-z0-9_]*")
MOST_BYTES = 63


class ContractError(ValueError):
    pass


def check_name(name: str, pattern: re.Pattern = COLUMN_NAME) -> str:
    if not pattern.fullmatch(name) or len(name.encode()) > MOST_BYTES:
        raise ContractError(f"{name!r} isn't a name that can be published")
    return name


@dataclass(frozen=True)
class Contract:
    """What an output has: target names of source columns, in order, and constants after them."""

    columns: dict[str, str]
    constants: dict[str, Column] | None = None

    def __post_init__(self):
        targets = [*self.columns.values(), *(self.constants or {})]
        for t in targets:
            check_name(t)
        if twice := sorted({t for t in targets if targets.count(t) > 1}):
            raise ContractError(f"targets more than once: {', '.join(twice)}")


def project(df: DataFrame, contract: Contract) -> DataFrame:
    if missing := [c for c in contract.columns if c not in df.columns]:
        raise ContractError(f"columns the table lacks: {', '.join(missing)}")
    return df.select(*[quoted(s).alias(t) for s, t in contract.columns.items()], *[c.alias(t) for t, c in (contract.constants or {}).items()])


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise ContractError(f"columns the table lacks: {', '.join(missing)}")
    return df.select(*map(quoted, names))


def drop_columns(df: DataFrame, *names: str, strict: bool = True) -> DataFrame:
    if strict and (missing := [c for c in names if c not in df.columns]):
        raise ContractError(f"columns the table lacks: {', '.join(missing)}")
    return df.select(*[quoted(c) for c in df.columns if c not in names])


def rename(df: DataFrame, names: dict[str | int, str]) -> DataFrame:
    """By old name or by place."""
    by = {df.columns[k] if isinstance(k, int) else k: v for k, v in names.items()}
    return df.select(*[quoted(c).alias(by.get(c, c)) for c in df.columns])


def assign(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.withColumns(values)


def _whole(d: Column) -> Column:
    return F.abs(d - F.round(d)) < 1e-9


def _strict(c: Column, kind: str) -> tuple[Column, Column]:
    """The value, and whether the text can't be read as one."""
    text = blank_to_null(c.cast("string"))
    d = text.try_cast("double")
    if kind == "int":
        return F.round(d).try_cast("bigint"), text.isNotNull() & (d.isNull() | ~_whole(d))
    if kind == "float":
        return d, text.isNotNull() & d.isNull()
    if kind == "date":
        v = F.to_date(text.try_cast("timestamp_ntz"))
        return v, text.isNotNull() & v.isNull()
    raise ValueError(f"strict kind {kind!r}")


class CastError(ValueError):
    pass


def strict_cast(df: DataFrame, kinds: dict[str, str], where: str = "table") -> DataFrame:
    """Columns cast to int, float or date; blanks are null. One aggregate counts what can't be read, and only then are up
    to ten such values fetched for the error."""
    casts = {c: _strict(quoted(c), k) for c, k in kinds.items()}
    counts = df.agg(*[F.count_if(bad).alias(str(i)) for i, (_, bad) in enumerate(casts.values())]).first()
    for i, (c, (_, bad)) in enumerate(casts.items()):
        if counts[i]:
            sample = [r[0] for r in df.filter(bad).select(quoted(c).cast("string")).distinct().limit(10).collect()]
            raise CastError(f"{where}: column {c!r} has {counts[i]} values that aren't {kinds[c]}: {sorted(map(str, sample))}")
    return df.select(*[casts[c][0].alias(c) if c in casts else quoted(c) for c in df.columns])


def types_by_name(columns: list[str], patterns: dict[str, list[str]]) -> dict[str, str]:
    """The kind of each column whose name has one of a kind's parts, whatever the case; the first kind that fits."""
    out = {}
    for c in columns:
        for kind, parts in patterns.items():
            if any(p.lower() in c.lower() for p in parts):
                out[c] = kind
                break
    return out


def apply_types(df: DataFrame, columns: dict[str, str | dict], default: str = "any", drop_other: bool = False) -> DataFrame:
    """columns: name -> kind, or {"type": kind, "nullable": bool}. Casts leniently; nulls in columns that may have none raise."""
    spec = {c: {"type": v, "nullable": True} if isinstance(v, str) else {"nullable": True, **v} for c, v in columns.items()}
    if missing := [c for c in spec if c not in df.columns]:
        raise ContractError(f"columns the table lacks: {', '.join(missing)}")
    names = [c for c in df.columns if c in spec or not drop_other]
    out = df.select(*[lenient(quoted(c), spec.get(c, {"type": default})["type"]).alias(c) for c in names])
    solid = [c for c in spec if not spec[c]["nullable"]]
    if solid:
        counts = out.agg(*[F.count_if(quoted(c).isNull()).alias(str(i)) for i, c in enumerate(solid)]).first()
        if bad := {c: counts[i] for i, c in enumerate(solid) if counts[i]}:
            raise CastError(f"nulls in columns that may have none: {bad}")
    return out
