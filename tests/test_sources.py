import os

import pytest

from ledgerflow.sources import files as fs
from ledgerflow.sources.csv import CsvError, CsvOptions, fast_csv, read_csv, read_csv_set, read_latest_csv
from ledgerflow.sources.jdbc import JdbcSource, catalog_table
from ledgerflow.sources.xlsx import Workbook, cell_range, column_letters
from ledgerflow.sinks import copy_text, write_xlsx


def put(path, text, encoding="utf-8", at=None):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    if at:
        os.utime(path, (at, at))
    return str(path)


def data(df):
    return [tuple(r) for r in df.collect()]


WIDTHS = [
    ("1;2", "strict", None), ("1;2", "pad", ("1", "2", "")), ("1;2", "truncate", None), ("1;2", "pad_or_truncate", ("1", "2", "")),
    ("1;2;3;4", "strict", None), ("1;2;3;4", "pad", None), ("1;2;3;4", "truncate", ("1", "2", "3")), ("1;2;3;4", "pad_or_truncate", ("1", "2", "3")),
]


@pytest.mark.parametrize("line,mode,want", WIDTHS)
def test_widths(spark, tmp_path, line, mode, want):
    f = put(tmp_path / "a.csv", f"a;b;c\n{line}\n")
    df = read_csv(spark, f, CsvOptions(row_width=mode))
    if want is None:
        with pytest.raises(Exception, match="record 2 has"):
            df.collect()
    else:
        assert data(df) == [want]


def test_csv_details(spark, tmp_path):
    f = put(tmp_path / "a.csv", 'имя;b\n"x\ny";1\n\n;\n" ";2\n', "utf-8-sig")
    assert data(read_csv(spark, f)) == [("x\ny", "1"), ("", ""), (" ", "2")]
    assert read_csv(spark, f).columns == ["имя", "b"]
    assert data(read_csv(spark, f, CsvOptions(header=False)))[0] == ("имя", "b") and read_csv(spark, f, CsvOptions(header=False)).columns == ["Column1", "Column2"]
    assert data(read_csv(spark, f, CsvOptions(columns=("z",))))[0] == ("x\ny",)
    assert [r._record for r in read_csv(spark, f, position=True).collect()] == [2, 4, 5]  # blank records count
    assert sorted(data(fast_csv(spark, put(tmp_path / "b.csv", "a;b\n1;\n;2\n")))) == [("", "2"), ("1", "")]
    for bad in ("a;a\n1;2\n", "a;\n1;2\n"):
        with pytest.raises(CsvError):
            read_csv(spark, put(tmp_path / "bad.csv", bad))
    with pytest.raises(CsvError):
        read_csv(spark, put(tmp_path / "none.csv", "\n\n"))
    for wrong in ({"row_width": "x"}, {"delimiter": ";;"}, {"columns": ("a", "a")}, {"columns": ()}):
        with pytest.raises(CsvError):
            CsvOptions(**wrong)
    with pytest.raises(LookupError):
        CsvOptions(encoding="nope")


def test_csv_sets(spark, tmp_path):
    put(tmp_path / "B.csv", "x;y\n3;4\n", at=100)
    put(tmp_path / "a.csv", "x;y\n1;2\n", at=200)
    put(tmp_path / "c.csv", "\n", at=50)
    df = read_csv_set(spark, str(tmp_path), position=True)
    assert sorted((r._file, r.x) for r in df.collect()) == [(0, "1"), (1, "3")]
    assert data(read_latest_csv(spark, str(tmp_path))) == [("1", "2")]
    put(tmp_path / "d.csv", "y;x\n1;2\n")
    with pytest.raises(CsvError, match="another header"):
        read_csv_set(spark, str(tmp_path))
    assert read_csv_set(spark, str(tmp_path), "*.none", CsvOptions(columns=("q",)), on_empty="empty").count() == 0
    with pytest.raises(fs.NoMatchingFilesError):
        read_csv_set(spark, str(tmp_path), "*.none")


def test_selection_and_fingerprints(tmp_path):
    for n in ("a.csv", ".h.csv", "~$a.csv", "B.CSV"):
        put(tmp_path / n, n, at=1000)
    os.makedirs(tmp_path / "sub")
    put(tmp_path / "sub" / "c.csv", "c", at=3000)
    names = lambda **k: [f.relative_path for f in fs.select_files(str(tmp_path), "*.csv", **k)]
    assert names() == ["a.csv", "B.CSV"] and names(recursive=True) == ["a.csv", "B.CSV", "sub/c.csv"]
    assert names(hidden=True, temporary=True) == [".h.csv", "a.csv", "B.CSV", "~$a.csv"]
    assert fs.latest_file(str(tmp_path), "*.csv").relative_path == "a.csv"
    with pytest.raises(fs.NoMatchingFilesError):
        fs.select_files(str(tmp_path), "*.x")
    with pytest.raises(FileNotFoundError):
        fs.file_set(str(tmp_path / "gone"), on_empty="empty")
    files = fs.select_files(str(tmp_path), "*.csv")
    before = fs.set_fingerprint(files, str(tmp_path), "*.csv")
    assert before.signature == fs.set_fingerprint(files[::-1], str(tmp_path), "*.csv").signature and before.files == 2
    put(tmp_path / "a.csv", "longer", at=1000)
    assert fs.set_fingerprint(fs.select_files(str(tmp_path), "*.csv"), str(tmp_path), "*.csv").signature != before.signature
    assert fs.resolve("x/../y.csv", "/base") == "/base/y.csv" and fs.resolve("/z") == "/z"


def test_query_fingerprint(spark):
    one = fs.query_fingerprint(spark, "select 1 as a, date '2024-01-01' as d")
    assert one.signature == fs.query_fingerprint(spark, "select 1 as a, date '2024-01-01' as d").signature
    for bad in ("select 1 as a, 2 as a", "select explode(array(1, 2)) as a", "select 1 as a where false"):
        with pytest.raises(ValueError):
            fs.query_fingerprint(spark, bad)


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    df = spark.sql("select * from values (1, 'Север', 1.5d, true, date '2024-03-01', timestamp_ntz '2024-03-01 10:30:00'), (2, '<&>', double('nan'), null, null, null) as t(n, s, f, b, d, t)")
    assert write_xlsx(df, path) == 2
    w = Workbook(spark, path)
    assert w.sheets == ["Sheet1"] and w.sheet_name(0) == "Sheet1"
    got = w.get_sheet(0)
    assert got.columns == ["row_idx", "n", "s", "f", "b", "d", "t"]
    assert data(got) == [(2, "1", "Север", "1.5", "true", "2024-03-01 00:00:00", "2024-03-01 10:30:00"), (3, "2", "<&>", None, None, None, None)]
    assert data(w.get_range("Sheet1", "A2:B3")) == [(3, "2", "<&>")]
    with pytest.raises(KeyError):
        w.sheet_name("none")
    with pytest.raises(IndexError):
        w.sheet_name(4)
    with pytest.raises(TypeError):
        w.sheet_name(1.5)


def sparse_book(path):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}"><Relationship Id="r1" Type="w" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/_rels/s.xml.rels", f'<Relationships xmlns="{pack}"><Relationship Id="t1" Type="t" Target="../tables/t.xml"/></Relationships>')
        z.writestr("xl/tables/t.xml", f'<table xmlns="{main}" name="map" displayName="map" ref="B2:C8"/>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>key</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf/><xf><alignment indent="3"/></xf></cellXfs></styleSheet>')
        cell = lambda r, v, k="": f'<c r="{r}"{k}>{v}</c>'
        rows = f'<row r="2">{cell("B2", "<v>0</v>", " t=\"s\"")}{cell("C2", "<v>1</v>", " t=\"s\"")}</row>'
        rows += f'<row r="4">{cell("B4", "<v>7</v>", " s=\"1\"")}{cell("C4", "<v>8</v>")}</row><row r="8" outlineLevel="1">{cell("B8", "<v>7</v>")}{cell("C8", "<v>9</v>")}</row>'
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return str(path)


def test_sparse_sheet_tables_and_metadata(spark, tmp_path):
    w = Workbook(spark, sparse_book(tmp_path / "s.xlsx"))
    assert w.tables == {"map": {"sheet": "S", "range": "B2:C8"}}
    assert data(w.get_table("map")) == [(4, "7", "8"), (8, "7", "9")]
    assert data(w.get_map("map")) == [("7", "8")]
    assert data(w.row_metadata("S")) == [(2, 0), (4, 0), (8, 1)]
    assert data(w.row_metadata("S", "indent", "B")) == [(2, 0), (4, 3), (8, 0)]
    assert [r.cells for r in w.raw_rows("S").collect()][0] == [None, "key", "value"]
    assert column_letters(27) == "AB" and column_letters("c") == "C" and cell_range("A1:C9") == (1, 0, 9, 2)


def test_jdbc_pushes_filters_down(spark, tmp_path):
    url = "jdbc:derby:memory:t;create=true"
    spark.createDataFrame([(1, "a"), (2, "b")], "ID int, V string").write.format("jdbc").option("url", url).option("dbtable", "T1").option("createTableColumnTypes", "V varchar(10)").save()
    db = JdbcSource(spark, url)
    df = db.get_table(table="T1", postprocess=lambda d: d.filter("ID > 1"))
    assert data(df) == [(2, "b")] and "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,1)]" in df._jdf.queryExecution().toString()
    assert data(db.get_table(query="select V from T1 where ID = 1")) == [("a",)]
    for bad in ({}, {"table": "T1", "query": "x"}, {"table": "T1; drop table T1"}):
        with pytest.raises(ValueError):
            db.get_table(**bad)
    with pytest.raises(ValueError):
        catalog_table(spark, "a b")


def test_copy_text(spark):
    df = spark.sql("select 'a\\tb\\\\\\n' as s, true as b, cast(null as int) as n, 1.5d as f, X'00ff' as x")
    assert data(copy_text(df)) == [("a\\tb\\\\\\n\tt\t\\N\t1.5\t\\\\x00ff",)]
