"""Tab-separated text as bulk loaders take it: \\N for null, backslash escapes, t and f, \\x for bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators.aggregates import quoted


def _field(name: str, kind: T.DataType) -> Column:
    c = quoted(name)
    if isinstance(kind, T.BooleanType):
        text = F.when(c, F.lit("t")).otherwise(F.lit("f"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("\\\\x"), F.lower(F.hex(c)))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.when(F.isnan(c), F.lit("NaN")).otherwise(c.cast("string"))
    else:
        # the backslash first: it begins what the others become
        marks = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
        text = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, c.cast("string"))
    return F.when(c.isNull(), F.lit("\\N")).otherwise(text)


def copy_text(df: DataFrame) -> DataFrame:
    """A row of one column, value, for each row."""
    return df.select(F.concat_ws("\t", *[_field(f.name, f.dataType) for f in df.schema]).alias("value"))


def write_copy_text(df: DataFrame, path: str) -> None:
    copy_text(df).write.text(path)
