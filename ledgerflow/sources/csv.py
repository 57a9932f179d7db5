"""Strict CSV as DataFrames of strings.

Spark's own reader can't tell short from long rows, takes blank fields for nulls and
renames repeated headers, so files go through a data source of ours: a task for each
file, records as they stream from Python's csv module. A plain file of strict width goes
to Spark's reader (fast_csv), which splits it.

Errors name the file, the record and what is wrong, never the data.
"""

from __future__ import annotations

import codecs
import contextlib
import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerflow.sources.files import FileAccess, FoundFile, LocalFiles, file_set, fixed_file, latest_file, received, sent

WIDTHS = ("strict", "pad", "truncate", "pad_or_truncate")


class CsvError(ValueError):
    pass


@dataclass(frozen=True)
class CsvOptions:
    """How files are read; what doesn't fit together is an error here, not in a task."""

    encoding: str = "utf-8-sig"
    errors: str = "strict"
    delimiter: str = ";"
    quotechar: str | None = '"'
    escapechar: str | None = None
    doublequote: bool = True
    skipinitialspace: bool = False
    quoting: int = csv.QUOTE_MINIMAL
    strict: bool = True
    header: bool = True
    columns: tuple[str, ...] | None = None
    row_width: str = "strict"

    def __post_init__(self):
        codecs.lookup(self.encoding)
        codecs.lookup_error(self.errors)
        if self.row_width not in WIDTHS:
            raise CsvError(f"row_width {self.row_width!r}")
        for name in ("delimiter", "quotechar", "escapechar"):
            v = getattr(self, name)
            if v is not None and len(v) != 1 or v is None and name == "delimiter":
                raise CsvError(f"{name} must be one character")
        if self.columns is not None:
            object.__setattr__(self, "columns", tuple(self.columns))
            check_header(self.columns, "columns")
        try:
            csv.reader([], **self.dialect())
        except (TypeError, csv.Error) as e:
            raise CsvError(str(e)) from None

    def dialect(self) -> dict:
        return {k: getattr(self, k) for k in ("delimiter", "quotechar", "escapechar", "doublequote", "skipinitialspace", "quoting", "strict")}


def check_header(names, where: str) -> tuple[str, ...]:
    if any(not isinstance(n, str) or n == "" for n in names):
        raise CsvError(f"{where}: a column without a name")
    if len(set(names)) != len(names):
        raise CsvError(f"{where}: columns of one name")
    if not names:
        raise CsvError(f"{where}: no column")
    return tuple(names)


def records(stream: io.TextIOBase, o: CsvOptions, where: str) -> Iterator[tuple[int, list[str]]]:
    """(number, fields) of the records that have fields; a record of empty fields, or of a blank, is one of them."""
    reader = csv.reader(stream, **o.dialect())
    n = 0
    try:
        for n, fields in enumerate(reader, 1):
            if fields:
                yield n, fields
    except csv.Error as e:
        raise CsvError(f"{where}: record {n + 1}: {e}") from None
    except UnicodeDecodeError as e:
        raise CsvError(f"{where}: after record {n}: not {o.encoding} ({e.reason})") from None


def fitted(fields: list[str], width: int, o: CsvOptions, where: str, n: int) -> list[str]:
    if len(fields) < width:
        if o.row_width not in ("pad", "pad_or_truncate"):
            raise CsvError(f"{where}: record {n} has {len(fields)} fields, not {width}")
        return fields + [""] * (width - len(fields))
    if len(fields) > width:
        if o.columns is None and o.row_width not in ("truncate", "pad_or_truncate"):
            raise CsvError(f"{where}: record {n} has {len(fields)} fields, not {width}")
        return fields[:width]
    return fields


def header_of(stream: io.TextIOBase, o: CsvOptions, where: str) -> tuple[str, ...] | None:
    """The names that a file gives its columns; None for a file without records."""
    first = next(records(stream, o, where), None)
    if o.columns is not None:
        return o.columns if first else None
    if first is None:
        return None
    return check_header(first[1], where) if o.header else tuple(f"Column{i}" for i in range(1, len(first[1]) + 1))


class _File(InputPartition):
    def __init__(self, ordinal: int, path: str, label: str):
        self.ordinal, self.path, self.label = ordinal, path, label


@contextlib.contextmanager
def _text(access: FileAccess, path: str, o: CsvOptions) -> Iterator[io.TextIOBase]:
    with access.open(path) as raw, io.TextIOWrapper(raw, encoding=o.encoding, errors=o.errors, newline="") as stream:
        yield stream


class _Reader(DataSourceReader):
    def __init__(self, files, options: CsvOptions, width: int, access: str | None):
        self.files, self.o, self.width, self.access = files, options, width, access

    def partitions(self):
        return [_File(i, path, label) for i, (path, label) in enumerate(self.files)]

    def read(self, part):
        with _text(received(self.access), part.path, self.o) as stream:
            rows = records(stream, self.o, part.label)
            if self.o.header:
                next(rows, None)
            for n, fields in rows:
                yield (part.ordinal, n, fitted(fields, self.width, self.o, part.label, n))


class StrictCsv(DataSource):
    """spark.read.format("strict_csv"): file (int), record (int), fields (array of strings)."""

    @classmethod
    def name(cls):
        return "strict_csv"

    def schema(self):
        return "file int, record int, fields array<string>"

    def reader(self, schema):
        import json

        o = json.loads(self.options["spec"])
        return _Reader([tuple(f) for f in o["files"]], CsvOptions(**o["options"]), o["width"], o["access"])


def _load(spark: SparkSession, files: list[FoundFile], o: CsvOptions, names: tuple[str, ...], position: bool, access: FileAccess | None = None) -> DataFrame:
    import json

    from pyspark.sql import functions as F

    spark.dataSource.register(StrictCsv)
    if not files:
        place = "_file int, _record int, " if position else ""
        return spark.createDataFrame([], place + ", ".join("`" + n.replace("`", "``") + "` string" for n in names))
    spec = {"files": [(f.path, f.relative_path) for f in files], "options": {k: getattr(o, k) for k in o.__dataclass_fields__}, "width": len(names), "access": sent(access)}
    rows = spark.read.format("strict_csv").option("spec", json.dumps(spec)).load()
    place = [F.col("file").alias("_file"), F.col("record").alias("_record")] if position else []
    return rows.select(*place, *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _names(f: FoundFile, o: CsvOptions, access: FileAccess | None = None) -> tuple[str, ...] | None:
    with _text(access or LocalFiles(), f.path, o) as stream:
        return header_of(stream, o, f.relative_path)


def read_csv(spark: SparkSession, f: FoundFile | str, options: CsvOptions = CsvOptions(), position: bool = False, access: FileAccess | None = None) -> DataFrame:
    """One file. position adds _file and _record, which keep the physical order."""
    f = fixed_file(f, access) if isinstance(f, str) else f
    names = _names(f, options, access)
    if names is None:
        raise CsvError(f"{f.relative_path}: no record")
    return _load(spark, [f], options, names, position, access)


def read_latest_csv(spark: SparkSession, folder: str, pattern: str = "*.csv", options: CsvOptions = CsvOptions(), position: bool = False, **how) -> DataFrame:
    return read_csv(spark, latest_file(folder, pattern, **how), options, position, how.get("access"))


def read_csv_set(spark: SparkSession, folder: str, pattern: str = "*.csv", options: CsvOptions = CsvOptions(), on_empty: str = "raise", position: bool = False, **how) -> DataFrame:
    """All files of a set as one table, _file following their order; a file without records is passed over, and all others
    must have the first one's header."""
    access = how.get("access")
    files = file_set(folder, pattern, on_empty, **how)
    if not files:
        if options.columns is None:
            raise CsvError("an empty set has no header; name its columns")
        return _load(spark, [], options, options.columns, position)
    usable = [(f, n) for f in files if (n := _names(f, options, access)) is not None]
    if not usable:
        raise CsvError(f"no file in {folder} has a record")
    first, names = usable[0]
    for f, n in usable[1:]:
        if n != names:
            raise CsvError(f"{f.relative_path}: another header than {first.relative_path}")
    return _load(spark, [f for f, _ in usable], options, names, position, access)


def fast_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """Spark's reader, which splits files, for UTF-8 files of strict width. Blank fields are empty texts, as elsewhere."""
    if options.row_width != "strict" or options.encoding.replace("-", "").lower() not in ("utf8", "utf8sig") or options.columns is not None or not options.header:
        raise CsvError("only UTF-8 files with a header and strict width")
    names = _names(fixed_file(path), replace(options))
    if names is None:
        raise CsvError(f"{path}: no record")
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = spark.read.schema(schema).option("header", True).option("sep", options.delimiter).option("quote", options.quotechar or "").option("escape", options.escapechar or '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)
    return rows.fillna("")
