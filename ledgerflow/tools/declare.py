"""Prints the declaration of a live table's schema.

python -m ledgerflow.tools.declare --table schema.name [--exclude column ...] [--style python|ddl] [--output file]
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T


class RenderError(ValueError):
    pass


# How types are declared.
NAMES = {
    "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION", "string": "TEXT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "binary": "BYTEA",
}


def render_type(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        if t.scale < 0:
            raise RenderError("a negative scale has no declaration")
        return f"NUMERIC({t.precision}, {t.scale})"
    if isinstance(t, T.VarcharType):
        return f"VARCHAR({t.length})"
    name = NAMES.get(t.simpleString())
    if name is None:
        raise RenderError(f"{t.simpleString()} has no declaration")
    return name


def _declared(f: T.StructField) -> T.DataType:
    """The type as declared: a catalog's char and varchar columns are strings, whose length stands in their metadata."""
    text = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
    if text.startswith("char("):
        raise RenderError(f"{text} has no declaration")
    return T.VarcharType(int(text[8:-1])) if text.startswith("varchar(") else f.dataType


def render(schema: T.StructType, exclude: tuple[str, ...] = (), style: str = "python") -> str:
    if missing := [c for c in exclude if c not in schema.names]:
        raise RenderError(f"the table lacks {', '.join(missing)}")
    fields = [f for f in schema if f.name not in exclude]
    if not fields:
        raise RenderError("no column is left")
    lines, errors = [], []
    for f in fields:
        try:
            kind = render_type(_declared(f))
            lines.append(f'    Column("{f.name}", "{kind}"{"" if f.nullable else ", nullable=False"}),' if style == "python" else f"    {f.name} {kind}{'' if f.nullable else ' NOT NULL'},")
        except RenderError as e:
            errors.append(f"{f.name}: {e}")
    if errors:
        raise RenderError("; ".join(errors))
    return "schema = (\n" + "\n".join(lines) + "\n)\n" if style == "python" else "(\n" + "\n".join(lines).rstrip(",") + "\n)\n"


def setup_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--table", required=True)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--style", choices=("python", "ddl"), default="python")
    p.add_argument("--output")
    a = p.parse_args(args)
    try:
        text = render(SparkSession.builder.getOrCreate().table(a.table).schema, tuple(a.exclude), a.style)
    except RenderError as e:
        print(e, file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
