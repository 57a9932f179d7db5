import io

import pytest

from ledgerflow.sinks import write_xlsx
from ledgerflow.sources import files as fs
from ledgerflow.sources.csv import read_csv, read_csv_set
from ledgerflow.sources.xlsx import FileSet, Workbook


def memory(content):
    """A file system in memory, as a class of this function, so that tasks get it by value."""

    class Memory:
        def __init__(self, content):
            self.content = content

        def _found(self, path, system=False):
            return fs.FoundFile(path, path.partition("/")[2], len(self.content[path]), 1, system=path.endswith(".sys"))

        def walk(self, folder, recursive):
            return [self._found(p) for p in self.content if p.startswith(folder + "/")]

        def one(self, path):
            if path not in self.content:
                raise FileNotFoundError(path)
            return self._found(path)

        def open(self, path):
            return io.BytesIO(self.content[path])

    return Memory(content)


def test_readers_read_through_an_access(spark, tmp_path):
    write_xlsx(spark.sql("select 1 as a, 'x' as b"), str(tmp_path / "w.xlsx"))
    access = memory({"m/1.csv": b"a;b\n1;2\n", "m/2.csv": b"a;b\n3;4\n", "m/w.xlsx": (tmp_path / "w.xlsx").read_bytes(), "m/x.sys": b""})
    assert [tuple(r) for r in read_csv(spark, "m/1.csv", access=access).collect()] == [("1", "2")]
    assert sorted(tuple(r) for r in read_csv_set(spark, "m", access=access).collect()) == [("1", "2"), ("3", "4")]
    assert [(r.a, r.b) for r in Workbook(spark, "m/w.xlsx", access).get_sheet(0).collect()] == [("1", "x")]
    assert [f.path for f in fs.select_files("m", "*.sys", system=True, access=access)] == ["m/x.sys"]
    with pytest.raises(fs.NoMatchingFilesError):
        fs.select_files("m", "*.sys", access=access)
    s = FileSet(spark, "m", "*.csv", access=access)
    assert [f.path for f in s.files] == ["m/1.csv", "m/2.csv"] and s.fingerprint().files == 2
    with s.open(s.files[0]) as f:
        assert f.read() == b"a;b\n1;2\n"
    with pytest.raises(ValueError, match="isn't a file of this set"):
        s.csv(access.one("m/w.xlsx"))
    books = FileSet(spark, "m", "*.xlsx", access=access)
    assert books.sheets().count() == 2 and books.row_metadata(books.files[0]).count() == 2


def test_closed_workbook_and_file_as_folder(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    write_xlsx(spark.sql("select 1 as a"), path)
    with Workbook(spark, path) as w:
        assert w.sheets == ["Sheet1"]
    with pytest.raises(ValueError, match="closed"):
        w.get_sheet(0)
    with pytest.raises(ValueError, match="is a file"):
        fs.select_files(path)


def test_gaps_are_filled(spark, tmp_path):
    import zipfile

    path = str(tmp_path / "w.xlsx")
    write_xlsx(spark.sql("select 1 as a"), path)
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b'<row r="2">', b'<row r="5" outlineLevel="2">')
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    rows = Workbook(spark, path).rows_with_metadata(0).orderBy("row_idx").collect()
    assert [(r.row_idx, r["cells"], r.outline) for r in rows] == [(1, ["a"], 0), (2, [], 0), (3, [], 0), (4, [], 0), (5, ["1"], 2)]


def test_catalog_declaration_keeps_lengths(spark):
    from ledgerflow.tools.declare import main, render

    spark.sql("create table if not exists declared_lengths (a varchar(20), b int) using parquet")
    try:
        assert 'Column("a", "VARCHAR(20)")' in render(spark.table("declared_lengths").schema)
        assert main(["--table", "declared_lengths", "--style", "ddl"]) == 0 and main(["--table", "declared_lengths", "--exclude", "zz"]) == 1
    finally:
        spark.sql("drop table declared_lengths")


def test_entry_survives_a_missing_module():
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None\nimport warnings; warnings.simplefilter('ignore')\nimport __spark_entry__ as e; print(len(e.queries()) > 50)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rpartition("/tests/")[0], capture_output=True, text=True).stdout.strip() == "True"
