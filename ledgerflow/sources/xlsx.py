"""Excel workbooks (.xlsx) with nothing but zipfile and an XML parser.

Sheets come as DataFrames of row_idx (from 1), cells (array of strings), outline level,
indent and style of a column, by a data source of ours: a task for each sheet, rows as
they stream from the XML. A sheet has 1,048,576 rows at most. Values are texts: numbers
as written, true and false, dates (by number format) in ISO form, errors as shown.
"""

from __future__ import annotations

import datetime as dt
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerflow.operators.headers import columns_for, named_columns
from ledgerflow.operators.joins import first_wins
from ledgerflow.sources.csv import CsvOptions, read_csv
from ledgerflow.sources.files import FileAccess, Fingerprint, FoundFile, LocalFiles, file_set, fixed_file, received, sent, set_fingerprint

_DATE = re.compile(r"(?i)[ymdhs]")
_SKIP = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')
BUILT_IN_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def column_letters(spec: int | str) -> str:
    """"A" for 0; letters are taken as they are."""
    if isinstance(spec, str):
        if not re.fullmatch("[A-Za-z]{1,3}", spec):
            raise ValueError(f"column {spec!r}")
        return spec.upper()
    if isinstance(spec, bool) or not isinstance(spec, int) or spec < 0:
        raise ValueError(f"column {spec!r}")
    out, n = "", spec + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def cell_range(text: str) -> tuple[int, int, int, int]:
    """First row, first column, last row, last column (rows from 1, columns from 0) of "A1:C9"."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?", text.upper())
    if not m:
        raise ValueError(f"range {text!r}")
    a, b = column_number(m[1]), column_number(m[3] or m[1])
    return int(m[2]), a, int(m[4] or m[2]), b


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parsed(z: zipfile.ZipFile, name: str) -> ET.Element:
    with z.open(name) as f:
        return ET.parse(f).getroot()


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else posixpath.normpath(f"{folder}/{r.get('Target')}") for r in _parsed(z, rels)}


@dataclass
class Parts:
    """What a workbook is made of."""

    sheets: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)
    epoch_1904: bool = False


def parts_of(path: str, access: FileAccess | None = None) -> Parts:
    out = Parts()
    with (access or LocalFiles()).open(path) as f, zipfile.ZipFile(f) as z:
        book, rels = _parsed(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        for e in book.iter():
            if _local(e.tag) == "sheet":
                rid = next(v for k, v in e.attrib.items() if _local(k) == "id")
                out.sheets[e.get("name")] = rels[rid]
            elif _local(e.tag) == "workbookPr":
                out.epoch_1904 = e.get("date1904") in ("1", "true")
        for sheet, part in out.sheets.items():
            for target in _relations(z, part).values():
                if "/tables/" in target:
                    t = _parsed(z, target)
                    out.tables[t.get("displayName") or t.get("name")] = {"sheet": sheet, "range": t.get("ref")}
    return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ET.iterparse(f):
            if _local(e.tag) == "si":
                out.append(_plain(e))
                e.clear()
    return out


def _plain(e: ET.Element) -> str:
    """The text of runs, without phonetic hints."""
    out = []
    for c in e:
        if _local(c.tag) == "t":
            out.append(c.text or "")
        elif _local(c.tag) == "r":
            out += [t.text or "" for t in c if _local(t.tag) == "t"]
    return "".join(out)


def _styles(z: zipfile.ZipFile) -> tuple[list[bool], list[int]]:
    """Of each cell style, whether it shows a date, and its indent."""
    if "xl/styles.xml" not in z.namelist():
        return [], []
    root = _parsed(z, "xl/styles.xml")
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _local(e.tag) == "numFmt"}
    dates, indents = [], []
    for xfs in root:
        if _local(xfs.tag) == "cellXfs":
            for xf in xfs:
                n = int(xf.get("numFmtId", 0))
                dates.append(n in BUILT_IN_DATES or n in own and bool(_DATE.search(_SKIP.sub("", own[n]))) and "General" not in own[n])
                indents.append(next((int(a.get("indent", 0)) for a in xf if _local(a.tag) == "alignment"), 0))
    return dates, indents


def _date_text(number: str, epoch_1904: bool) -> str:
    n = float(number)
    start = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30) if n >= 60 else dt.datetime(1899, 12, 31)
    at = start + dt.timedelta(seconds=round(n * 86400, 3))
    return at.isoformat(sep=" ", timespec="seconds")


def sheet_rows(path: str, part: str, epoch_1904: bool = False, access: FileAccess | None = None) -> Iterator[tuple[int, list, int, list[int], list[int]]]:
    """(row number, cells, outline level, indents, styles) of the rows that the sheet's XML has."""
    with (access or LocalFiles()).open(path) as raw, zipfile.ZipFile(raw) as z:
        shared, (dates, indents) = _shared(z), _styles(z)
        last = 0
        with z.open(part) as f:
            for _, row in ET.iterparse(f):
                if _local(row.tag) != "row":
                    continue
                last = int(row.get("r") or last + 1)
                cells: list[str | None] = []
                own_indents: list[int] = []
                styles: list[int] = []
                for c in row:
                    ref = c.get("r")
                    at = column_number(re.match("[A-Z]+", ref)[0]) if ref else len(cells)
                    while len(cells) <= at:
                        cells.append(None)
                        own_indents.append(0)
                        styles.append(0)
                    s = int(c.get("s", 0))
                    styles[at], own_indents[at] = s, indents[s] if s < len(indents) else 0
                    kind = c.get("t", "n")
                    value = next((x.text for x in c if _local(x.tag) == "v"), None)
                    if kind == "inlineStr":
                        value = next((_plain(x) for x in c if _local(x.tag) == "is"), None)
                    elif value is None:
                        continue
                    elif kind == "s":
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "n" and s < len(dates) and dates[s]:
                        value = _date_text(value, epoch_1904)
                    cells[at] = value
                yield last, cells, int(row.get("outlineLevel", 0)), own_indents, styles
                row.clear()


class _Sheet(InputPartition):
    def __init__(self, ordinal, path, part, epoch):
        self.ordinal, self.path, self.part, self.epoch = ordinal, path, part, epoch


class _SheetReader(DataSourceReader):
    def __init__(self, sheets, access):
        self.sheets, self.access = sheets, access

    def partitions(self):
        return [_Sheet(i, *s) for i, s in enumerate(self.sheets)]

    def read(self, p):
        for n, cells, level, indents, styles in sheet_rows(p.path, p.part, p.epoch, received(self.access)):
            yield (p.ordinal, n, cells, level, indents, styles)


class XlsxSheets(DataSource):
    """spark.read.format("xlsx_sheets")"""

    @classmethod
    def name(cls):
        return "xlsx_sheets"

    def schema(self):
        return "sheet int, row_idx int, cells array<string>, outline int, indents array<int>, styles array<int>"

    def reader(self, schema):
        o = json.loads(self.options["spec"])
        return _SheetReader([tuple(s) for s in o["sheets"]], o["access"])


def _sheets(spark: SparkSession, sheets: list[tuple[str, str, bool]], access: FileAccess | None) -> DataFrame:
    spark.dataSource.register(XlsxSheets)
    return spark.read.format("xlsx_sheets").option("spec", json.dumps({"sheets": sheets, "access": sent(access)})).load()


class Workbook:
    """One workbook. What it is made of is read on the driver when first asked for, and kept until close(); sheets are read by
    tasks, and nothing stays open in between."""

    def __init__(self, spark: SparkSession, f: FoundFile | str, access: FileAccess | None = None):
        self.spark, self.access = spark, access
        self.file = fixed_file(f, access) if isinstance(f, str) else f
        self._closed = False

    def close(self) -> None:
        """What was read of it is dropped, and it can't be read any more; again does nothing."""
        self._closed = True
        self.__dict__.pop("_known", None)

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def _known(self) -> Parts:
        return parts_of(self.file.path, self.access)

    @property
    def _parts(self) -> Parts:
        if self._closed:
            raise ValueError(f"{self.file.relative_path} is closed")
        return self._known

    @property
    def sheets(self) -> list[str]:
        return list(self._parts.sheets)

    @property
    def tables(self) -> dict[str, dict]:
        return self._parts.tables

    def sheet_name(self, sheet: str | int) -> str:
        if isinstance(sheet, bool) or not isinstance(sheet, (str, int)):
            raise TypeError(f"sheet {sheet!r}")
        if isinstance(sheet, int):
            return self.sheets[sheet]
        if sheet not in self._parts.sheets:
            raise KeyError(f"no sheet {sheet!r}; there are {self.sheets}")
        return sheet

    def _load(self, sheet: str | int) -> DataFrame:
        return _sheets(self.spark, [(self.file.path, self._parts.sheets[self.sheet_name(sheet)], self._parts.epoch_1904)], self.access)

    def raw_rows(self, sheet: str | int) -> DataFrame:
        """row_idx and cells, no header."""
        return self._load(sheet).select("row_idx", "cells")

    def row_metadata(self, sheet: str | int, mode: str = "outline", column: int | str = 0) -> DataFrame:
        """row_idx and value: the row's outline level, or a column's indent or style. Rows that the sheet lacks have no row
        here; a left join on row_idx aligns both."""
        rows, at = self._load(sheet), column_number(column_letters(column))
        value = {"outline": F.col("outline"), "indent": F.coalesce(F.get("indents", F.lit(at)), F.lit(0)), "style": F.get("styles", F.lit(at))}
        if mode not in value:
            raise ValueError(f"mode {mode!r}")
        return rows.select("row_idx", value[mode].alias("value"))

    def rows_with_metadata(self, sheet: str | int, mode: str = "outline", column: int | str = 0) -> DataFrame:
        """All rows from 1 to the last one, with the metadata as a column of the mode's name. Rows that the sheet's file lacks
        have no cells, and level, indent and style 0."""
        rows = self._load(sheet).select("row_idx", "cells").join(self.row_metadata(sheet, mode, column), "row_idx")
        last = rows.agg(F.max("row_idx").alias("n")).filter("n is not null")
        every = last.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("row_idx"))
        none = F.array().cast("array<string>")
        return every.join(rows, "row_idx", "left").select("row_idx", F.coalesce("cells", none).alias("cells"), F.coalesce("value", F.lit(0)).alias(mode))

    def get_range(self, sheet: str | int, ref: str) -> DataFrame:
        """A range below its first row, which names the columns; row_idx stays."""
        r1, c1, r2, c2 = cell_range(ref)
        rows = self.raw_rows(sheet).filter(F.col("row_idx").between(r1, r2))
        rows = rows.withColumn("cells", F.transform(F.sequence(F.lit(c1), F.lit(c2)), lambda i: F.get("cells", i)))
        return self._below_header(rows, r1)

    def get_table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are {list(self.tables)}")
        t = self.tables[name]
        return self.get_range(t["sheet"], t["range"])

    def get_sheet(self, sheet: str | int) -> DataFrame:
        """A sheet below its first row, which names the columns."""
        rows = self.raw_rows(sheet)
        first = rows.agg(F.min("row_idx")).first()[0]
        if first is None:
            raise ValueError(f"sheet {sheet!r} has no row")
        return self._below_header(rows, first)

    @staticmethod
    def _below_header(rows: DataFrame, at: int) -> DataFrame:
        head = rows.filter(F.col("row_idx") == at).select("cells").first()
        if head is None:
            raise ValueError("the header's row is empty")
        return columns_for(rows.filter(F.col("row_idx") > at), named_columns(head[0]))

    def get_map(self, name: str, key: int = 0, value: int = 1) -> DataFrame:
        """Two columns of a table as key and value; a key's first row counts."""
        t = self.get_table(name)
        k, v = [c for c in t.columns if c != "row_idx"][key], [c for c in t.columns if c != "row_idx"][value]
        rows = t.select("row_idx", F.col(f"`{k}`").alias("key"), F.col(f"`{v}`").alias("value"))
        return first_wins(rows, ["key"], "row_idx").select("key", "value")


class FileSet:
    """The files of one selection: what is read, and what the fingerprint tells of, are the same files."""

    def __init__(self, spark: SparkSession, folder: str, pattern: str = "*", on_empty: str = "raise", access: FileAccess | None = None, **how):
        self.spark, self.access, self.folder, self.pattern, self.recursive = spark, access, folder, pattern, how.get("recursive", False)
        self.files = tuple(file_set(folder, pattern, on_empty, access=access, **how))

    def _own(self, f: FoundFile) -> FoundFile:
        if f not in self.files:
            raise ValueError(f"{f.relative_path} isn't a file of this set")
        return f

    def open(self, f: FoundFile):
        return (self.access or LocalFiles()).open(self._own(f).path)

    def csv(self, f: FoundFile, options: CsvOptions = CsvOptions(), position: bool = False) -> DataFrame:
        return read_csv(self.spark, self._own(f), options, position, self.access)

    def workbook(self, f: FoundFile) -> Workbook:
        return Workbook(self.spark, self._own(f), self.access)

    def row_metadata(self, f: FoundFile, sheet: str | int = 0, mode: str = "outline", column: int | str = 0) -> DataFrame:
        return self.workbook(f).row_metadata(sheet, mode, column)

    def sheets(self, sheet: str | int = 0) -> DataFrame:
        return read_workbooks(self.spark, list(self.files), sheet, self.access)

    def fingerprint(self) -> Fingerprint:
        return set_fingerprint(list(self.files), self.folder, self.pattern, self.recursive)


def read_workbooks(spark: SparkSession, files: list[FoundFile], sheet: str | int = 0, access: FileAccess | None = None) -> DataFrame:
    """One sheet of each workbook, as file (by order), row_idx, cells and outline."""
    spec = []
    for f in files:
        w = Workbook(spark, f, access)
        spec.append((f.path, w._parts.sheets[w.sheet_name(sheet)], w._parts.epoch_1904))
    rows = _sheets(spark, spec, access)
    return rows.select(F.col("sheet").alias("file"), "row_idx", "cells", "outline")
