"""Declared schemas. A value that doesn't fit is an error, never rounded, cut or shifted.

All checks of all columns are one aggregate of compiled expressions; rows are looked at
only to name the first bad one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.functions import missing_to_null
from ledgerflow.operators.aggregates import quoted
from ledgerflow.operators.projections import check_name


class SchemaError(ValueError):
    pass


# Names under which types are declared.
ALIASES = {
    "SMALLINT": "smallint", "INT2": "smallint", "INTEGER": "int", "INT": "int", "INT4": "int", "BIGINT": "bigint", "INT8": "bigint",
    "NUMERIC": "decimal", "DECIMAL": "decimal", "FLOAT": "double", "REAL": "float", "FLOAT4": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "FLOAT8": "double",
    "TEXT": "string", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "BYTEA": "binary",
}

_FORM = re.compile(r"\s*([A-Za-z][A-Za-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*")
RANGES = {"smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


@dataclass(frozen=True)
class Kind:
    base: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None

    @property
    def spark(self) -> T.DataType:
        simple = {"smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}
        if self.base == "decimal":
            return T.DecimalType(self.precision or 38, self.scale if self.precision else 18)
        return simple.get(self.base, T.StringType())


def declared_type(text: str) -> Kind:
    """The kind that a declaration such as "NUMERIC(12, 2)" names."""
    m = _FORM.fullmatch(text)
    base = ALIASES.get(re.sub(r"\s+", " ", m[1]).upper()) if m else None
    if base is None:
        raise SchemaError(f"type {text!r} isn't supported")
    a, b = (int(x) if x else None for x in m.groups()[1:])
    if base == "decimal":
        if a is not None and not 1 <= a <= 38:
            raise SchemaError(f"{text!r}: Spark's decimals have 1 to 38 digits")
        if b is not None and b > a:
            raise SchemaError(f"{text!r}: more digits after the point than in all")
        return Kind(base, a, (b or 0) if a else None)
    if m[1].upper() == "FLOAT" and a is not None:
        if not 1 <= a <= 53 or b is not None:
            raise SchemaError(f"{text!r}: a float has 1 to 53 bits")
        return Kind("float" if a <= 24 else "double")
    if base == "string" and a is not None:
        if a < 1 or b is not None or m[1].upper() != "VARCHAR":
            raise SchemaError(f"{text!r}: only VARCHAR has a length, of 1 at least")
        return Kind(base, length=a)
    if a is not None:
        raise SchemaError(f"{text!r} takes no length")
    return Kind(base)


@dataclass(frozen=True)
class Column:
    """A declared output column."""

    name: str
    type: str
    nullable: bool = True

    def __post_init__(self):
        check_name(self.name)
        declared_type(self.type)

    @property
    def kind(self) -> Kind:
        return declared_type(self.type)


def struct_of(columns: tuple[Column, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.kind.spark, c.nullable) for c in columns])


#: Types of values that a kind takes.
TAKES = {
    "smallint": ("tinyint", "smallint", "int", "bigint"), "int": ("tinyint", "smallint", "int", "bigint"), "bigint": ("tinyint", "smallint", "int", "bigint"), "decimal": ("tinyint", "smallint", "int", "bigint", "decimal"),
    "float": ("float", "double"), "double": ("float", "double"), "string": ("string",), "boolean": ("boolean",), "date": ("date",), "timestamp_ntz": ("timestamp_ntz",), "timestamp": ("timestamp",), "binary": ("binary",),
}


def _checks(c: Column, value: C) -> list[tuple[str, C]]:
    k, out = c.kind, []
    if not c.nullable:
        out.append(("is null", value.isNull()))
    if k.base in RANGES:
        low, high = RANGES[k.base]
        out.append(("is out of range", ~value.between(low, high)))
    if k.base == "decimal":
        wide = value.cast(T.DecimalType(38, 18)) if k.precision is None else value
        if k.precision is None:
            out.append(("has too many digits", value.isNotNull() & value.try_cast(T.DecimalType(38, 18)).isNull()))
        else:
            out.append(("has too many digits after the point", F.round(wide, k.scale) != wide))
            out.append(("has too many digits", value.isNotNull() & value.try_cast(T.DecimalType(k.precision, k.scale)).isNull()))
    if k.base in ("float", "double"):
        out.append(("isn't finite", F.abs(value) == float("inf")))
    if k.base == "string":
        out.append(("has a NUL character", F.contains(value, F.lit("\0"))))
        if k.length:
            out.append((f"is longer than {k.length}", F.length(value) > k.length))
    return out


def enforce(df: DataFrame, columns: tuple[Column, ...]) -> DataFrame:
    """df's rows in the declared order and types, or SchemaError with the column, the reason and how many rows have it."""
    names = [c.name for c in columns]
    if len(set(names)) != len(names):
        raise SchemaError("columns of one name are declared")
    if set(df.columns) != set(names) or len(df.columns) != len(names):
        raise SchemaError(f"not the declared columns: {sorted(set(names) ^ set(df.columns)) or 'some repeat'}")
    kinds = dict(df.dtypes)
    values, checks = {}, []
    for c in columns:
        kind = kinds[c.name].partition("(")[0]
        if kind != "void" and kind not in TAKES[c.kind.base]:
            raise SchemaError(f"column {c.name!r}: {kinds[c.name]} isn't {c.type}")
        values[c.name] = missing_to_null(quoted(c.name), kind in ("float", "double"))
        checks += [(c.name, why, bad) for why, bad in _checks(c, values[c.name])] if kind != "void" else [] if c.nullable else [(c.name, "is null", F.lit(True))]
    if checks:
        counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(str(i)) for i, (_, _, bad) in enumerate(checks)]).first()
        for i, (name, why, _) in enumerate(checks):
            if counts[i]:
                raise SchemaError(f"column {name!r}: the value {why} in {counts[i]} rows")
    return df.select(*[values[c.name].cast(c.kind.spark).alias(c.name) for c in columns])
