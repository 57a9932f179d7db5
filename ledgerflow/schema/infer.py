"""Schemas from the families of values: one aggregate over the whole table, no sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerflow.functions import missing_to_null
from ledgerflow.operators.aggregates import family_sets, quoted


class InferenceError(ValueError):
    pass


def resolve(families: set[str], has_float: bool = True, scale: int = 0) -> T.DataType:
    """The type that holds all values of these families. Nothing seen is text; mixes other than of numbers, and of dates
    with times without a zone, are text; times with a zone mix with no other."""
    if not families:
        return T.StringType()
    if "datetime_aware" in families and families & {"datetime_naive", "date"}:
        raise InferenceError("times with a zone and without one, or dates, in one column")
    one = {"bool": T.BooleanType(), "int": T.LongType(), "date": T.DateType(), "datetime_naive": T.TimestampNTZType(), "datetime_aware": T.TimestampType(), "text": T.StringType(), "bytes": T.BinaryType()}
    if len(families) == 1 and (only := next(iter(families))) in one:
        return one[only]
    if families <= {"int", "numeric"}:
        return T.DoubleType() if has_float else T.DecimalType(38, scale)
    if families <= {"date", "datetime_naive"}:
        return T.TimestampNTZType()
    return T.StringType()


def infer_schema(*frames: DataFrame) -> T.StructType:
    """The schema for all values of frames with the same columns; values of a column may differ in type between frames."""
    sets: dict[str, set[str]] = {c: set() for c in frames[0].columns}
    floats: dict[str, bool] = dict.fromkeys(sets, False)
    scales: dict[str, int] = dict.fromkeys(sets, 0)
    for df in frames:
        if set(df.columns) != set(sets):
            raise InferenceError(f"columns differ: {df.columns} and {list(sets)}")
        row = family_sets(df).first()
        for f in df.schema:
            if not isinstance(f.dataType, T.AtomicType | T.NullType):
                raise InferenceError(f"column {f.name!r}: {f.dataType.simpleString()} can't be published")
            sets[f.name] |= set(row[f.name])
            floats[f.name] |= isinstance(f.dataType, (T.FloatType, T.DoubleType)) and bool(row[f.name])
            if isinstance(f.dataType, T.DecimalType) and row[f.name]:
                scales[f.name] = max(scales[f.name], f.dataType.scale)
    out = []
    for c, found in sets.items():
        try:
            out.append(T.StructField(c, resolve(found, floats[c], scales[c])))
        except InferenceError as e:
            raise InferenceError(f"column {c!r}: {e}") from None
    return T.StructType(out)


def apply_inferred(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the schema's types. NaN is null; a text of a bool is true or false."""
    kinds = dict(df.dtypes)
    return df.select(*[missing_to_null(quoted(f.name), kinds[f.name] in ("float", "double")).cast(f.dataType).alias(f.name) for f in schema])
