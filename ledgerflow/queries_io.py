"""Queries over sources, headers, schemas, publication and runs, and the same in SQL. Their files stand in a temporary folder of
this machine, which tasks must see, and are small: region and nation never grow."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerflow import functions as X
from ledgerflow import operators as O
from ledgerflow.queries import _csv, _folder, _small, query, t


@query("select r_regionkey::varchar as key, case when r_regionkey % 2 = 0 then '' else r_name || ',''x''' end as name from region")
def csv_options(spark, sf_dir):
    from ledgerflow.sources.csv import CsvOptions, read_latest_csv

    d = _folder()
    with open(f"{d}/r.csv", "w", encoding="cp1251", newline="") as f:
        for k, n in _small(spark, sf_dir, "region", "r_regionkey", "r_name"):
            f.write(f"{k}\r\n\r\n" if k % 2 == 0 else f"{k}; |{n},'x'|;Ж\r\n")
    o = CsvOptions(encoding="cp1251", quotechar="|", skipinitialspace=True, header=False, columns=("key", "name"), row_width="pad_or_truncate")
    return read_latest_csv(spark, d, options=o)


@query("select n_regionkey::varchar || '.csv' as member, n_nationkey::varchar as key, n_name as name, (select count(distinct n_regionkey) from nation)::int as files from nation")
def file_set_members(spark, sf_dir):
    from ledgerflow.sources.xlsx import FileSet

    d, rows = _folder(), _small(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", "n_name")
    for k in {r[1] for r in rows}:
        _csv(f"{d}/{k}.csv", [(a, n) for a, r, n in rows if r == k], ["key", "name"])
    s = FileSet(spark, d, "*.csv")
    return O.union_same([s.csv(f).select(F.lit(f.relative_path).alias("member"), "key", "name", F.lit(s.fingerprint().files).alias("files")) for f in s.files])


@query("""with f as (select r_regionkey as k, case when r_regionkey = 4 then 'deep/' else '' end || r_name || '.txt' as path, length(r_name) as size from region)
select string_agg(path, ',' order by lower(path), path) as paths, max_by(path, k) as latest, sum(size)::bigint as total, 0 as none, count(*)::int as files,
md5('[' || string_agg('{"mtime":' || (1700000000 + k)::bigint * 1000000000 || ',"path":"' || path || '","size":' || size || '}', ',' order by lower(path), path) || ']') as signature from f""")
def file_selection(spark, sf_dir):
    from ledgerflow.sources import files as fs

    d = _folder()
    os.mkdir(f"{d}/deep")
    rows = _small(spark, sf_dir, "region", "r_regionkey", "r_name")
    for k, n in [*rows, (99, ".hidden"), (98, "~$open")]:
        path = f"{d}/{'deep/' if k == 4 else ''}{n}.txt"
        with open(path, "w") as f:
            f.write(n)
        os.utime(path, ns=((1_700_000_000 + k) * 10**9,) * 2)
    found = fs.select_files(fs.resolve(os.path.basename(d), os.path.dirname(d)), "*.TXT", recursive=True)
    last = fs.latest_file(d, "*.txt", recursive=True)
    whole = fs.set_fingerprint(found, d, "*.txt", True)
    row = (",".join(f.relative_path for f in found), fs.fixed_file(last.path) and last.relative_path, whole.total_size, len(fs.file_set(d, "*.none", "empty")), whole.files, whole.signature)
    return spark.createDataFrame([row], "paths string, latest string, total long, none int, files int, signature string")


@query("select n_nationkey::varchar as n_nationkey, n_name, (n_nationkey + 2)::int as row_idx, 'Sheet1' as sheet, 'nations' as tab from nation")
def xlsx_tables(spark, sf_dir):
    from ledgerflow.sinks import write_xlsx
    from ledgerflow.sources.xlsx import Workbook

    path = f"{_folder()}/nation.xlsx"
    write_xlsx(t(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), path, table="nations")
    with Workbook(spark, path) as w:
        return w.get_table("nations").withColumns({"sheet": F.lit(w.sheets[0]), "tab": F.lit(next(iter(w.tables)))})


@query("select n_regionkey::varchar as key, min_by(n_name, n_nationkey) as value from nation group by 1")
def xlsx_lookup_map(spark, sf_dir):
    from ledgerflow.sinks import write_xlsx
    from ledgerflow.sources.xlsx import Workbook

    path = f"{_folder()}/nation.xlsx"
    write_xlsx(t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_regionkey", "n_name"), path, table="map_nation")
    return Workbook(spark, path).get_map("map_nation")


@query("""select (r_regionkey + 2)::int as row_idx, r_regionkey::varchar as key, 1 as style, 0 as outline from region union all select 1, 'key', 0, 0""")
def xlsx_metadata(spark, sf_dir):
    from ledgerflow.sinks import write_xlsx
    from ledgerflow.sources.xlsx import Workbook

    path = f"{_folder()}/region.xlsx"
    write_xlsx(t(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("key"), F.make_date(F.lit(2024), F.lit(1), F.col("r_regionkey") + 1).alias("day")), path)
    w = Workbook(spark, path)
    levels = w.row_metadata(0).select("row_idx", F.col("value").alias("outline"))
    return w.rows_with_metadata(0, "style", "B").join(levels, "row_idx").select("row_idx", F.get("cells", F.lit(0)).alias("key"), "style", "outline")


@query("""select n_nationkey::varchar as key, (case when n_nationkey % 3 = 0 then null else n_nationkey + 0.5 end)::varchar as number, '2024-01-01 06:30:00' as at, (n_nationkey % 2 = 0)::varchar as flag from nation""")
def xlsx_normal_values(spark, sf_dir):
    from ledgerflow.sinks import write_xlsx
    from ledgerflow.sources.xlsx import Workbook

    n = F.col("n_nationkey")
    path = f"{_folder()}/nation.xlsx"
    rows = t(spark, sf_dir, "nation").orderBy(n).select(n.alias("key"), F.when(n % 3 == 0, F.lit(float("nan"))).otherwise(n + 0.5).alias("number"), F.lit("2024-01-01 06:30:00").cast("timestamp_ntz").alias("at"), (n % 2 == 0).alias("flag"))
    write_xlsx(rows, path)
    return Workbook(spark, path).get_sheet("Sheet1").drop("row_idx")


def _database(spark: SparkSession) -> str:
    """A database in the driver's memory. The tasks of a local session share it; in others the driver reads and writes it."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{_folder()}/derby.log")
    return f"jdbc:derby:memory:lf{uuid.uuid4().hex[:12]};create=true"


@query("select n_nationkey, upper(n_name) as n_name from nation where n_regionkey = 1 union all select n_nationkey, n_name from nation where n_regionkey = 2")
def jdbc_scan(spark, sf_dir):
    from ledgerflow.plans import JdbcPublisher
    from ledgerflow.sources.jdbc import JdbcSource

    p = JdbcPublisher(spark, url := _database(spark))
    p.commit([p.stage(t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", "r1", types="n_name VARCHAR(40)")], "task")
    s = JdbcSource(spark, url)
    a = s.get_table("nation", postprocess=lambda df: df.withColumn("n_name", F.upper("n_name")), partition=("n_nationkey", 0, 25, 2)).filter("n_regionkey = 1")
    b = s.get_table(query='select "n_nationkey", "n_name" from nation where "n_regionkey" = 2')
    return O.union_same([a.select("n_nationkey", "n_name"), b])


@query("""select r_regionkey::bigint as key, upper(r_name) as name, 'refused' as other, (select md5('[{"n":' || count(*) || '}]') from nation) as state from region""")
def jdbc_publish(spark, sf_dir):
    from ledgerflow.plans import JdbcPublisher, PublishError
    from ledgerflow.sources.files import query_fingerprint

    t(spark, sf_dir, "nation").createOrReplaceTempView(view := f"v{uuid.uuid4().hex[:12]}")
    print_ = query_fingerprint(spark, f"select count(*) as n from {view}")
    p = JdbcPublisher(spark, _database(spark))
    rows = t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    for run, df, how in (("r1", rows.limit(1), "replace"), ("r2", rows, "replace"), ("r3", rows.withColumn("name", F.upper("name")), "refill")):
        p.commit([p.stage(df, "regions", run, how, "name VARCHAR(40)")], "task", {"nation": print_.row()})
    other = "accepted"
    try:
        p.commit([s := p.stage(rows.select("key"), "regions", "r4", "refill")], "task")
    except PublishError:
        other = "refused"
        p.rollback([s])
    return p.read("regions").withColumns({"other": F.lit(other), "state": F.lit(p.state("task")["nation"])})


@query("""select n_name as name, n_nationkey::varchar as key, n_regionkey::varchar as "key.2", true as gate from nation where n_nationkey >= 2
union all select n_name, n_nationkey::varchar, null, false from nation where n_nationkey >= 4""")
def header_policies(spark, sf_dir):
    n = F.col("n_nationkey")
    cells = F.array("n_name", F.lit("-"), n.cast("string"), F.col("n_regionkey").cast("string"))
    cells = F.when(n == 0, F.array(F.lit("Period"))).when(n == 1, F.array(F.lit(" name"), F.lit(""), F.lit("key"), F.lit("key"))).otherwise(cells)
    raw = t(spark, sf_dir, "nation").select(n.alias("row_idx"), cells.alias("cells"))
    whole = O.promote_header(O.skip_rows(raw, 1), "key", policy="number").drop("row_idx").withColumn("gate", F.lit(O.has_marker(raw, "key", 2, 5, 4)))
    some = O.promote_header(raw, "key", ["key", "name"], "first")
    below = O.skip_until(some, F.col("row_idx") >= 4).drop("row_idx").withColumn("gate", F.lit(O.has_marker(raw, "key", 0)))
    return O.union_aligned([whole, below])


@query("select c_custkey::bigint as c_custkey, c_name, c_acctbal, c_nationkey::varchar as c_nationkey from customer")
def types_by_name(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_acctbal", "c_nationkey")])
    kinds = O.types_by_name(rows.columns, {"str": ["NATION", "name"], "int": ["key"], "float": ["bal"]})
    return O.apply_types(rows, kinds)


@query("select o_orderkey, o_orderdate + interval '3 hours 15 minutes' as later from orders")
def time_added(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", X.plus_time(F.col("o_orderdate"), 3, 15).alias("later"))


@query("select min(d) as low, max(d) as high from (select o_orderdate as d from orders union all select l_shipdate from lineitem union all select ts from events where false)")
def bounds_across_tables(spark, sf_dir):
    return O.bounds_across([(t(spark, sf_dir, "orders"), "o_orderdate"), (t(spark, sf_dir, "lineitem"), "l_shipdate"), (t(spark, sf_dir, "events").filter("false"), "ts")])


@query("""select 'customer: column ''c_mktsegment'' has ' || count(*) || ' values that aren''t int: [' || string_agg(distinct '''' || c_mktsegment || '''', ', ' order by '''' || c_mktsegment || '''') || ']' as message from customer""")
def bad_value_sample(spark, sf_dir):
    from ledgerflow.operators.projections import CastError

    try:
        O.strict_cast(t(spark, sf_dir, "customer"), {"c_mktsegment": "int"}, "customer")
        message = ""
    except CastError as e:
        message = str(e)
    return spark.createDataFrame([(message,)], "message string")


@query("""select r_name as "lev.1", n_name as "lev.2", 'unit ' || n_nationkey as position, 2 as depth from nation join region on n_regionkey = r_regionkey
union all select null, null, r_name, 0 from region""")
def level_order(spark, sf_dir):
    region, nation = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    place = F.col("n_regionkey").cast("long") * 1000 + F.col("n_nationkey") * 2 + 1
    deep = region.select((F.col("r_regionkey").cast("long") * 1000).alias("pos"), F.lit(1).alias("level"), F.col("r_name").alias("label"))
    deep = deep.union(nation.select(place, F.lit(2), "n_name")).union(nation.select(place + 1, F.lit(3), F.concat(F.lit("unit "), F.col("n_nationkey"))))
    flat = region.select(F.col("r_regionkey").cast("long").alias("pos"), F.lit(1).alias("level"), F.col("r_name").alias("label"))
    parts = [O.outline_leaves(x, "level", "label", "pos").drop("pos").withColumn("depth", F.lit(d)) for x, d in ((flat, 0), (deep, 2))]
    return O.levels_first(O.union_aligned(parts))


@query("""select n_regionkey as "lev.region", n, true as stamped, 'published,skipped,published' as runs, 5::bigint as shared, 1 as snapshots
from (select n_regionkey, count(*)::bigint as n from nation group by 1)""")
def run_contract(spark, sf_dir):
    from ledgerflow.operators import Contract
    from ledgerflow.plans import Output, Pipeline, Publisher, custom, run_pipelines
    from ledgerflow.sources.files import query_fingerprint

    t(spark, sf_dir, "nation").createOrReplaceTempView(view := f"v{uuid.uuid4().hex[:12]}")
    seen = {}

    class Counted(Pipeline):
        output = Output("counted", lambda columns: Contract({c: c if c == "n" else f"lev.{c[2:-3]}" for c in columns}), updated_at="db_updated_at", share_as="counted")
        roles = {"rows": "nation"}

        def run(self, ctx, rows):
            return rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))

    class Again(Pipeline):
        def run(self, ctx):
            seen["shared"] = ctx.shared("counted")[0].count()
            return ctx.results["Counted"]

    source = custom("nation", lambda e: e.spark.table(view), lambda e: query_fingerprint(e.spark, f"select count(*) as n from {view}"))
    p = Publisher(spark, _folder())
    go = lambda **how: run_pipelines(spark, "task", [Counted, Again], [source], p, keep_snapshots=True, **how).status
    runs = ",".join((go(), go(), go(force=True)))
    rows = p.read("counted")
    extra = {"stamped": F.col("db_updated_at").isNotNull(), "runs": F.lit(runs), "shared": F.lit(seen["shared"]).cast("long"), "snapshots": F.lit(len(p.state("task")["nation"]["snapshot"]))}
    return rows.withColumns(extra).drop("db_updated_at")


@query("""select count(*)::bigint as rows, 'r2' as run, 'replace' as strategy, 'parts/gen=r1' as cleaned, 'busy' as second, true as gone, true as reserved from part""")
def publication_life(spark, sf_dir):
    from ledgerflow.plans import Busy, Publisher, PublishError

    p = Publisher(spark, _folder(), keep_generations=0)
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    for run in ("r1", "r2"):
        p.commit([p.stage(rows, "parts", "task", run)], "task", run)
    left = p.stage(rows, "parts", "task", "r3")
    p.rollback([left], "r3")
    gone = not os.path.exists(p._folder("parts", "gen=r3"))
    with p.task_lock("task"):
        try:
            with p.task_lock("task"):
                second = "held"
        except Busy:
            second = "busy"
    try:
        p.preflight(["_locks"])
        reserved = False
    except PublishError:
        reserved = True
    live = p.provenance("parts")
    out = p.read("parts").agg(F.count(F.lit(1)).alias("rows"))
    cleaned = ",".join(p.clean_up("task"))
    return out.withColumns({"run": F.lit(live["run"]), "strategy": F.lit(live["strategy"]), "cleaned": F.lit(cleaned), "second": F.lit(second), "gone": F.lit(gone), "reserved": F.lit(reserved)})


@query("select r_regionkey as key, r_name as name, true as refused, 'false,true' as nullable from region")
def refill_rules(spark, sf_dir):
    """A declared schema is what a refill keeps, whatever the plan says of nulls: first a literal, then a table."""
    from ledgerflow.plans import Publisher, PublishError
    from ledgerflow.schema import Column, enforce, struct_of

    columns = (Column("key", "INTEGER", nullable=False), Column("name", "CHAR"))
    p = Publisher(spark, _folder())
    rows = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    for run, df in (("r1", spark.range(1).select(F.lit(7).alias("key"), F.lit("x").alias("name"))), ("r2", rows)):
        p.commit([p.stage(enforce(df, columns), "regions", "task", run, "refill", struct_of(columns))], "task", run)
    other = (Column("key", "BIGINT", nullable=False), Column("name", "TEXT"))
    try:
        p.commit([p.stage(enforce(rows, other), "regions", "task", "r3", "refill", struct_of(other))], "task", "r3")
        refused = False
    except PublishError:
        refused = True
    nullable = ",".join(str(f.nullable).lower() for f in p.schema_of("regions"))
    return p.read("regions").withColumns({"refused": F.lit(refused), "nullable": F.lit(nullable)})


@query("""select '    Column("' || column_name || '", "' || case column_type when 'VARCHAR' then 'TEXT' when 'DOUBLE' then 'DOUBLE PRECISION' else column_type end || '"),' as line
from (describe supplier) where column_name <> 's_name' union all select '    Column("s_name", "VARCHAR(40)"),'""")
def declaration_text(spark, sf_dir):
    from pyspark.sql import types as T

    from ledgerflow.tools.declare import render

    kinds = [T.StructField(f.name, T.VarcharType(40) if f.name == "s_name" else f.dataType) for f in t(spark, sf_dir, "supplier").schema]
    return spark.createDataFrame([(x,) for x in render(T.StructType(kinds)).split("\n")[1:-2]], "line string")


@query("select event_id, case when event_id % 4 = 0 then null else value end as value, case when event_id % 2 = 0 then 'true' else 'false' end as flag, ts from events")
def inferred_payload(spark, sf_dir):
    """NaN becomes null, and a column whose values are bools in one table and texts in another becomes text."""
    from ledgerflow.schema import apply_inferred, infer_schema

    rows = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), (F.col("event_id") % 2 == 0).alias("flag"), "ts")
    schema = infer_schema(rows, rows.limit(1).withColumn("flag", F.lit("text")))
    return apply_inferred(rows, schema)

