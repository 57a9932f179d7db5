"""Queries over the operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import functions as X
from ledgerflow import operators as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STAGES = ["signup", "view", "click", "purchase", "error"]
_PIVOT = "select user_id, date_trunc('month', ts)::date as month, " + ", ".join(f"min(case when event_type = '{s}' then ts end) as {s}" for s in STAGES) + " from events group by 1, 2"


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user and month with the first time of each stage."""
    first = [F.min(F.when(F.col("event_type") == s, F.col("ts"))).alias(s) for s in STAGES]
    return t(spark, sf_dir, "events").groupBy("user_id", F.trunc("ts", "MM").alias("month")).agg(*first)


@query(f"""with p as ({_PIVOT}), f as (select user_id, month, {", ".join(f"coalesce({', '.join(STAGES[i:])}) as {s}" for i, s in enumerate(STAGES))} from p)
{" union all ".join(f"select user_id, month, '{s}' as stage, {s} as at from f where {s} is not null" for s in STAGES)}""")
def funnel_backfill_unpivot(spark, sf_dir):
    return O.to_rows(O.backfill_row(_stages(spark, sf_dir), STAGES), ["user_id", "month"], STAGES, "stage", "at")


@query(f"""with p as (select user_id, month, {", ".join(f"nullif({s}, {s}) as {s}" if s != "error" else s for s in STAGES)} from ({_PIVOT}))
select user_id, month, case when error is null then month::timestamp + interval '14 hours 10 minutes' end as signup, error from p""")
def all_null_row_repair(spark, sf_dir):
    rows = _stages(spark, sf_dir).withColumns({s: F.nullif(F.col(s), F.col(s)) for s in STAGES[:-1]})
    return O.first_stage(rows, STAGES, "month").select("user_id", "month", "signup", "error")


@query("select o_orderpriority, sum(o_totalprice::decimal(18, 2)) as total from orders group by 1")
def agg_sum_by_key(spark, sf_dir):
    return O.sum_by(t(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)")), ["o_orderpriority"], {"total": "price"})


@query("""select nullif(l_returnflag, 'A') as flag, l_linestatus, coalesce(sum(case when l_linenumber > 5 then l_quantity end), 0) as quantity,
coalesce(sum(case when l_linenumber > 99 then l_quantity end), 0) as none from lineitem group by 1, 2""")
def agg_sum_null_as_zero(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"), "l_linestatus", F.when(F.col("l_linenumber") > 5, F.col("l_quantity")).alias("q"), F.when(F.col("l_linenumber") > 99, F.col("l_quantity")).alias("z"),
    )
    return O.sum_or_zero(rows, ["flag", "l_linestatus"], {"quantity": "q", "none": "z"})


_SPARSE = "case when l_linenumber % 2 = 0 then l_shipdate end as a, case when l_linenumber % 3 = 0 then l_shipdate end as b, case when l_quantity > 25 then l_shipdate end as c"


@query(f"""with r as (select l_orderkey, l_linenumber as p, {_SPARSE} from lineitem),
n as (select *, (a is not null)::int + (b is not null)::int + (c is not null)::int as n from r),
k as (select *, row_number() over (partition by l_orderkey order by n, p, a nulls first, b nulls first, c nulls first) as lo, row_number() over (partition by l_orderkey order by n desc, p, a nulls first, b nulls first, c nulls first) as hi from n)
select x.l_orderkey, least(x.a, y.a) as a, least(x.b, y.b) as b, least(x.c, y.c) as c from k x join k y on x.l_orderkey = y.l_orderkey and x.lo = 1 and y.hi = 1""")
def argmin_argmax_collapse(spark, sf_dir):
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("p"), F.when(n % 2 == 0, d).alias("a"), F.when(n % 3 == 0, d).alias("b"), F.when(F.col("l_quantity") > 25, d).alias("c"))
    return O.collapse_extremes(rows, ["l_orderkey"], ["a", "b", "c"], "p")


@query("select o_custkey, bool_or(coalesce(o_orderstatus = 'F', false)) as has_closed from orders group by 1")
def group_any_override(spark, sf_dir):
    return O.any_of(t(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", "has_closed")


@query("select o_orderkey, o_orderdate from orders where year(o_orderdate) = (select max(year(o_orderdate)) from orders)")
def current_year_filter(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    last = orders.agg(F.max(F.year("o_orderdate")).alias("y"))
    return orders.withColumn("y", F.year("o_orderdate")).join(last, "y").select("o_orderkey", "o_orderdate")


@query("""select l_orderkey, l_linenumber, o_custkey, o_orderpriority from lineitem join
(select distinct o_orderkey, o_custkey, o_orderpriority from orders where o_orderstatus = 'O') o on l_orderkey = o_orderkey""")
def scope_join_distinct(spark, sf_dir):
    scope = t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return O.in_scope(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), scope, ["l_orderkey"])


_DIM = "select n_nationkey, nullif(n_name, (select max(n_name) from nation where n_regionkey = 1)) as n_name from nation where n_regionkey < 3"


@query(f"""with d as ({_DIM}) select c_custkey, case when n_nationkey is not null then n_name else 'none' end as nation from customer left join d on c_nationkey = n_nationkey""")
def lookup_default(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    hidden = nation.filter("n_regionkey = 1").agg(F.max("n_name")).first()[0]
    dim = nation.filter("n_regionkey < 3").select("n_nationkey", F.nullif(F.col("n_name"), F.lit(hidden)).alias("n_name"))
    return O.lookup(t(spark, sf_dir, "customer"), "c_nationkey", dim, "n_nationkey", "n_name", "nation", F.lit("none")).select("c_custkey", "nation")


@query("""select c_custkey, case when a.n_nationkey is not null then a.n_name when b.n_nationkey is not null then lower(b.n_name) else c_nationkey::varchar end as nation
from customer left join (select * from nation where n_regionkey = 0) a on c_nationkey = a.n_nationkey left join (select * from nation where n_regionkey < 3) b on c_nationkey = b.n_nationkey""")
def lookup_chain(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    second = nation.filter("n_regionkey < 3").withColumn("n_name", F.lower("n_name"))
    rows = O.chained_lookup(t(spark, sf_dir, "customer"), "c_nationkey", [(nation.filter("n_regionkey = 0"), "n_nationkey", "n_name"), (second, "n_nationkey", "n_name")], "nation", F.col("c_nationkey").cast("string"))
    return rows.select("c_custkey", "nation")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id) r from events) where r = 1")
def first_wins_dedup(spark, sf_dir):
    return O.first_wins(t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select distinct user_id, event_type from events")
def distinct_keys(spark, sf_dir):
    return t(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("""select l_orderkey, l_linenumber, least(case when l_linenumber % 2 = 0 then l_shipdate end, o_orderdate) as first_at
from lineitem join orders on l_orderkey = o_orderkey""")
def row_min_pair(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("even", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")))
    return rows.select("l_orderkey", "l_linenumber", O.row_least("even", "o_orderdate").alias("first_at"))


@query("""with s as (select l_suppkey, sum(l_quantity) as quantity, sum(case when l_discount = 0 then 1 else 0 end)::double as full_price, sum(case when l_returnflag = 'X' then 1 else 0 end)::double as other from lineitem group by 1)
select l_suppkey, 'quantity' as measure, quantity as amount from s where quantity <> 0 union all select l_suppkey, 'full_price', full_price from s where full_price <> 0 union all select l_suppkey, 'other', other from s where other <> 0""")
def unpivot_measures_nonzero(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_discount") == 0).alias("full_price"), F.count_if(F.col("l_returnflag") == "X").alias("other"),
    )
    return O.to_rows(rows, ["l_suppkey"], ["quantity", "full_price", "other"], "measure", "amount", keep="nonzero", cast="double")


@query("""with s as (select o_custkey, min(o_orderdate)::date as a, max(o_orderdate)::date as b from orders group by 1),
m as (select o_custkey, b, unnest(generate_series(date_trunc('month', a)::timestamp, date_trunc('month', b)::timestamp, interval 1 month))::date as month from s)
select o_custkey, month, case when month = date_trunc('month', b) then 'closed' else 'open' end as status from m""")
def month_expand_status(spark, sf_dir):
    spans = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return O.month_spans(spans, "a", "b").select("o_custkey", "month", "status")


@query("""with d as (select unnest(generate_series(make_date(min(year(o_orderdate))::int, 1, 1)::timestamp, make_date(max(year(o_orderdate))::int, 12, 31)::timestamp, interval 1 day))::date as date from orders)
select date, year(date)::int as year, quarter(date)::int as quarter, month(date)::int as month, day(date)::int as day, isodow(date)::int as weekday, date_trunc('month', date)::date as month_start from d""")
def calendar(spark, sf_dir):
    return O.calendar(t(spark, sf_dir, "orders"), "o_orderdate", "o_orderdate")


@query("""with p as (select p_partkey, string_split(p_type || ' / ' || p_brand || case when p_size % 2 = 0 then ' / ' || p_size::varchar || ' / x / y' else '' end, ' / ') as s from part)
select p_partkey, trim(s[1]) as a, trim(s[2]) as b, coalesce(trim(s[3]), '-') as c, coalesce(trim(s[4]), '-') as d from p""")
def split_four(spark, sf_dir):
    c = F.concat(F.col("p_type"), F.lit(" / "), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" / "), F.col("p_size").cast("string"), F.lit(" / x / y"))).otherwise(F.lit("")))
    return t(spark, sf_dir, "part").select("p_partkey", *O.split_parts(c, ["a", "b", "c", "d"], missing="-"))


@query("select c_custkey as key, c_name as name, c_mktsegment as segment, null::double as balance from customer union all select s_suppkey, s_name, null, s_acctbal from supplier")
def union_missing_columns(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return O.union_aligned([a, b])


@query("select c_custkey as key from customer union all select s_suppkey from supplier")
def union_same_columns(spark, sf_dir):
    return O.union_same([t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))])


@query("""select c_mktsegment as segment, c_custkey as "customer.key", timestamp '2024-05-01 00:00:00' as db_updated_at from customer""")
def contract_project_rename(spark, sf_dir):
    contract = O.Contract({"c_mktsegment": "segment", "c_custkey": "customer.key"}, {"db_updated_at": F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")})
    return O.project(t(spark, sf_dir, "customer"), contract)


@query("""select event_id, try_cast(nullif(trim(regexp_extract(props, '([0-9.]+)', 1)), '') as double) as number from events""")
def strict_numeric_gate(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r"([0-9.]+)", 1).alias("number"))
    return O.strict_cast(rows, {"number": "float"}, "events")


@query("""select event_id, try_cast(event_type as bigint) as as_int, try_cast(event_id::varchar as bigint) as key, try_cast(case when event_id % 2 = 0 then ts::varchar else 'x' end as timestamp) as at,
try_cast(case when event_id % 2 = 0 then ts::varchar else 'x' end as timestamp)::date as day, try_cast(event_id::varchar || '.5' as double) as half from events""")
def lenient_casts(spark, sf_dir):
    c, e = F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")).otherwise(F.lit("x")), F.col("event_id").cast("string")
    return t(spark, sf_dir, "events").select(
        "event_id", X.lenient(F.col("event_type"), "int").alias("as_int"), X.lenient(e, "int").alias("key"), X.lenient(c, "datetime").alias("at"), X.lenient(c, "date").alias("day"), X.lenient(F.concat(e, F.lit(".5")), "float").alias("half"),
    )


_DIRTY = "case c_custkey % 6 when 0 then '#n/a' when 1 then ' #ДЕЛ / 0! ' when 2 then '  ' when 3 then '#Ref!' else ' ' || c_name || ' ' end"
_ERRORS = ", ".join("'" + x + "'" for x in X.ERROR_LITERALS)


@query(f"""with d as (select c_custkey, {_DIRTY} as v from customer)
select c_custkey, case when upper(replace(trim(v), ' ', '')) in ({_ERRORS}) then null else v end as cleaned, nullif(trim(case when upper(replace(trim(v), ' ', '')) in ({_ERRORS}) then null else v end), '') as text from d""")
def error_literal_clean(spark, sf_dir):
    v = F.expr(_DIRTY)
    cleaned = X.clean_errors(F.col("v"))
    return t(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", cleaned.alias("cleaned"), X.blank_to_null(cleaned).alias("text"))


@query("""select l_orderkey, l_linenumber, datediff('day', o_orderdate::date, l_shipdate::date)::int as days, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6 as elapsed,
(datediff('day', o_orderdate::date, l_shipdate::date) <= 30)::int as within_sla, case when l_linenumber % 3 = 0 then datediff('day', o_orderdate::date, l_shipdate::date)::int else l_linenumber % 3 end as or_days,
(l_linenumber * 480 + coalesce(nullif(l_linenumber, 2), 0))::int as minutes from lineitem join orders on l_orderkey = o_orderkey""")
def sla_flags(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days, n = X.day_difference(F.col("o_orderdate"), F.col("l_shipdate")), F.col("l_linenumber")
    return rows.select(
        "l_orderkey", "l_linenumber", days.alias("days"), X.elapsed_days(F.col("o_orderdate"), F.col("l_shipdate")).alias("elapsed"), X.sla_flag(days, 30).alias("within_sla"), X.truthy_or(n % 3, days).alias("or_days"),
        X.work_minutes(n, F.nullif(n, F.lit(2))).alias("minutes"),
    )


@query("""select o_orderkey, o_orderkey::int as number, (o_orderkey % 50 * 60 + o_orderkey % 60)::int as minutes, (o_orderkey % 90)::int / 60 as seconds, 0 as none from orders""".replace("(o_orderkey % 90)::int / 60", "((o_orderkey % 90) // 60)::int"))
def text_to_minutes(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat((k % 50).cast("string"), F.lit(" Часов "), (k % 60).cast("string"), F.lit("минут, 5 дней"))
    return t(spark, sf_dir, "orders").select("o_orderkey", X.duration_minutes(k + 0.9).alias("number"), X.duration_minutes(text).alias("minutes"), X.duration_minutes(F.concat((k % 90).cast("string"), F.lit(" секунд"))).alias("seconds"), X.duration_minutes(F.lit(None).cast("string")).alias("none"))


@query("""with n as (select r_regionkey, r_name, n_nationkey, n_name from region left join nation on n_regionkey = r_regionkey)
select case when n_name is null then null else r_name end as "lev.1", coalesce(n_name, r_name) as position, (r_regionkey * 1000 + coalesce(n_nationkey + 1, 0))::bigint as pos from n""")
def outline_hierarchy(spark, sf_dir):
    region = t(spark, sf_dir, "region").select((F.col("r_regionkey").cast("bigint") * 1000).alias("pos"), F.lit(1).alias("level"), F.col("r_name").alias("label"))
    nation = t(spark, sf_dir, "nation").select((F.col("n_regionkey").cast("bigint") * 1000 + F.col("n_nationkey") + 1).alias("pos"), F.lit(2).alias("level"), F.col("n_name").alias("label"))
    return O.outline_leaves(region.union(nation), "level", "label", "pos")


@query("select event_id, (nullif(event_type, 'view') is not null)::int + (nullif(value > 50, false) is not null)::int + (props is not null)::int as filled from events")
def non_null_count(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("a"), F.nullif(F.col("value") > 50, F.lit(False)).alias("b"), "props")
    return rows.select("event_id", O.non_null_count("a", "b", "props").alias("filled"))


_FAMILY = "max(case when typeof({0}) in ('BIGINT', 'INTEGER') then 'int' when typeof({0}) = 'DOUBLE' then 'numeric' when typeof({0}) = 'TIMESTAMP' then 'datetime_naive' else 'text' end) as {0}"


@query(f"""select {", ".join(_FAMILY.format(c) for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))}, '' as none from events""")
def infer_families(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.nullif(F.col("value"), F.col("value")).alias("none"))
    sets = O.family_sets(rows)
    return sets.select(*[F.array_join(c, ",").alias(c) for c in sets.columns])


@query("select n_nationkey, n_name from nation where n_nationkey not in (select n_nationkey from nation where n_regionkey = 2)")
def state_prune(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return O.missing_keys(nation, nation.filter("n_regionkey = 2"), ["n_nationkey"]).select("n_nationkey", "n_name")


@query("select n_nationkey, case when n_regionkey = 2 then lower(n_name) else n_name end as n_name from nation")
def state_upsert(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    changes = nation.filter("n_regionkey = 2").withColumn("n_name", F.lower("n_name"))
    return O.upsert(nation.filter("n_nationkey % 2 = 0").select("n_nationkey", "n_name").unionByName(nation.filter("n_nationkey % 2 = 1").select("n_nationkey", "n_name")), changes.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("""select p_partkey as row_idx, p_name as name, p_brand as brand from part where p_partkey > (select min(p_partkey) + 3 from part)""")
def header_promote(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    least = part.agg(F.min("p_partkey")).first()[0]
    head = F.col("p_partkey") == least + 3
    cells = F.when(head, F.array(F.lit("  name "), F.lit(""), F.lit("brand"))).otherwise(F.array("p_name", F.lit("x"), "p_brand"))
    # the label is looked for as written
    return O.promote_header(part.select(F.col("p_partkey").alias("row_idx"), cells.alias("cells")), "brand")


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 when 'AUTOMOBILE' then 2 end as sort_level, case when c_mktsegment = 'BUILDING' then 'HOUSES' else c_mktsegment end as segment,
c_mktsegment like '%MO%' as has_mo, c_mktsegment like 'B%' as is_b from customer""")
def literal_maps(spark, sf_dir):
    s = F.col("c_mktsegment")
    return t(spark, sf_dir, "customer").select(
        "c_custkey", X.literal_map(s, {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 2}).alias("sort_level"), X.replace_values(s, {"BUILDING": "HOUSES"}).alias("segment"), X.text_like(s, "MO").alias("has_mo"), X.text_like(s, "B", True).alias("is_b"),
    )


@query("""with d as (select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as a, o_orderdate::date as v from orders)
select o_orderkey, v as plain, v::timestamp + interval '9 hours 5 minutes' as timed, v::timestamp as short, date_trunc('month', v)::date as month, v as named, date_trunc('month', v)::date as named_month, year(v)::int as year, a as found from d""")
def date_parsing(spark, sf_dir):
    names = F.array(*map(F.lit, ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]))
    firsts = F.array(*map(F.lit, ["Январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]))
    d = F.col("o_orderdate")
    text = F.date_format(d, "dd.MM.yyyy")
    named = F.concat_ws(" ", F.day(d), F.element_at(names, F.month(d)), F.year(d), F.lit("г."))
    month = F.concat_ws("  ", F.element_at(firsts, F.month(d)), F.year(d))
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", X.parse_date(text).cast("date").alias("plain"), X.parse_date(F.concat(text, F.lit(" 9:05"))).alias("timed"), X.parse_date(F.date_format(d, "d/M/yy")).alias("short"), X.month_of_text(text).alias("month"),
        X.parse_date(named).cast("date").alias("named"), X.parse_date(month).cast("date").alias("named_month"), X.date_year(d.cast("string")).alias("year"),
        X.first_date_text(F.concat(F.lit("from "), text, F.lit(" on"))).alias("found"),
    )


@query("""select event_id, try_cast(ts::varchar[:19] as timestamp) as at, case when event_id % 3 = 0 then null else value end as value, coalesce(event_type = 'view', false) as is_view, date_trunc('month', ts)::date as month from events""".replace("ts::varchar[:19]", "left(ts::varchar, 19)"))
def timestamp_and_missing(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    return t(spark, sf_dir, "events").select("event_id", X.parse_timestamp(text).cast("timestamp_ntz").alias("at"), X.missing_to_null(value, True).alias("value"), X.text_like(F.col("event_type"), "view").alias("is_view"), X.month_start(F.col("ts")).alias("month"))


@query("""select p_partkey, p_size between 5 and 20 as fits, round(p_retailprice::decimal(18, 4), 2) = p_retailprice::decimal(18, 4) as whole, (p_size = 1) as is_one, (p_size // 10)::int as level, coalesce(p_brand, '-- нет --') as grp,
case when p_size % 2 = 0 then p_name end as label from part""")
def value_tests(spark, sf_dir):
    n = F.col("p_size")
    label = F.when(n % 2 == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit(" (до 01.02.2024)"))).otherwise(F.lit("(до 5)"))
    return t(spark, sf_dir, "part").select(
        "p_partkey", X.in_range(n, 5, 20).alias("fits"), X.whole_scale(F.col("p_retailprice").cast("decimal(18,4)"), 2).alias("whole"), X.is_one(n).alias("is_one"), X.outline_level((n / 10).cast("string")).alias("level"),
        X.group_label(F.concat(F.col("p_brand"), F.lit("\t"))).alias("grp"), X.hierarchy_label(label).alias("label"),
    )


@query("select min(o_orderdate) as low, max(o_orderdate) as high from orders")
def global_bounds(spark, sf_dir):
    return O.bounds(t(spark, sf_dir, "orders"), "o_orderdate")


@query("select sum((nullif(event_type, 'view') is null)::int)::bigint as event_type, sum((props is null)::int)::bigint as props from events")
def null_counts(spark, sf_dir):
    return O.null_count(t(spark, sf_dir, "events").select(F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"), "props"), ["event_type", "props"])


@query("select count(*) as n from lineitem")
def row_counts(spark, sf_dir):
    return O.row_count(t(spark, sf_dir, "lineitem"))


@query("select l_orderkey, l_linenumber from lineitem where nullif(l_returnflag, 'R') is null or nullif(l_returnflag, 'R') = 'A'")
def null_or_equal_filter(spark, sf_dir):
    flag = F.nullif(F.col("l_returnflag"), F.lit("R"))
    return t(spark, sf_dir, "lineitem").filter(flag.isNull() | (flag == "A")).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where nullif(l_returnflag, 'R') is distinct from 'A'")
def not_equal_keeps_null(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").filter(~F.nullif(F.col("l_returnflag"), F.lit("R")).eqNullSafe(F.lit("A"))).select("l_orderkey", "l_linenumber")


@query("select p_partkey from part where p_size % 3 <> 0 and nullif(p_brand, 'Brand#11') is not null and p_brand <> ''")
def truthiness_filter(spark, sf_dir):
    return t(spark, sf_dir, "part").filter(X.truthy(F.col("p_size") % 3) & X.truthy(F.nullif(F.col("p_brand"), F.lit("Brand#11")), "text")).select("p_partkey")


@query("select l_orderkey, l_linenumber from lineitem where l_shipdate >= timestamp '1998-01-01' and l_quantity between 10 and 20 and l_returnflag in ('A', 'N')")
def pushed_filters(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "N"))
    return rows.select("l_orderkey", "l_linenumber")


@query("select c_custkey as id, c_name as name, 7 as run from customer")
def cut_rename_assign(spark, sf_dir):
    rows = O.keep_columns(O.drop_columns(t(spark, sf_dir, "customer"), "c_acctbal"), "c_custkey", "c_name")
    return O.assign(O.rename(rows, {0: "id", "c_name": "name"}), {"run": F.lit(7)})


@query("select n_nationkey, n_name from nation")
def drop_empty_columns(spark, sf_dir):
    return O.drop_empty_columns(t(spark, sf_dir, "nation").select("n_nationkey", F.lit(None).cast("string").alias("void"), "n_name"))


@query("""select o_orderkey, o_custkey::bigint as o_custkey, o_orderdate::date as o_orderdate from orders""")
def schema_application(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderstatus")
    return O.apply_types(rows, {"o_orderkey": {"type": "int", "nullable": False}, "o_custkey": "int", "o_orderdate": "date"}, drop_other=True)


@query("""select md5('["' || n_nationkey::varchar || '","' || n_name || '"]') as signature, n_nationkey from nation""")
def row_signature(spark, sf_dir):
    return t(spark, sf_dir, "nation").select(X.signature(F.col("n_nationkey"), F.col("n_name")).alias("signature"), "n_nationkey")


@query("""select o_orderpriority, max(o_orderdate) as at, max(struct_pack(d := o_orderdate, k := o_orderkey)).k as o_orderkey from orders group by 1""")
def latest_by_key(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_orderpriority", F.col("r.o_orderdate").alias("at"), F.col("r.o_orderkey").alias("o_orderkey"))


# Sources, schemas and publication: their files stand in a temporary folder of this machine, which tasks must see.


def _folder() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="ledgerflow-query-")


def _csv(path: str, rows: list, header: list[str]) -> str:
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, delimiter=";")
        w.writerow(header)
        w.writerows(rows)
    return path


def _small(spark, sf_dir, name, *columns):
    """Rows of one of the two tables whose size never changes."""
    return [tuple(r) for r in t(spark, sf_dir, name).select(*columns).orderBy(columns[0]).collect()]


@query("""select n_nationkey::varchar as key, n_name || chr(10) || '"x";' as name, case when n_regionkey = 2 then '' else n_regionkey::varchar end as region from nation""")
def csv_scan(spark, sf_dir):
    from ledgerflow.sources.csv import CsvOptions, read_csv

    rows = [(k, f'{n}\n"x";', *([] if r == 2 else [r])) for k, n, r in _small(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")]
    return read_csv(spark, _csv(f"{_folder()}/nation.csv", rows, ["key", "name", "region"]), CsvOptions(row_width="pad"))


@query("select n_regionkey as _file, n_nationkey::varchar as key, n_name as name from nation")
def csv_set_union(spark, sf_dir):
    from ledgerflow.sources.csv import read_csv_set

    d = _folder()
    rows = _small(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    for k in range(5):
        _csv(f"{d}/{k}.csv", [r[:2] for r in rows if r[2] == k], ["key", "name"])
    return read_csv_set(spark, d, position=True).drop("_record")


@query("select n_nationkey::varchar as n_nationkey, n_name, (n_nationkey + 2)::int as row_idx from nation")
def xlsx_scan(spark, sf_dir):
    from ledgerflow.sinks import write_xlsx
    from ledgerflow.sources.xlsx import Workbook

    path = f"{_folder()}/nation.xlsx"
    write_xlsx(t(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), path)
    return Workbook(spark, path).get_sheet(0)


@query("select o_orderpriority as priority, count(*)::bigint as n, sum(o_totalprice::decimal(18, 2))::decimal(28, 2) as total from orders group by 1")
def publish_replace(spark, sf_dir):
    from ledgerflow.plans import Publisher
    from ledgerflow.schema import apply_inferred, infer_schema

    p = Publisher(spark, _folder())
    rows = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    for run, df in (("r1", rows.limit(1)), ("r2", rows)):
        p.commit([p.stage(apply_inferred(df, infer_schema(df)), "priorities", "task", run)], "task", run)
    return p.read("priorities").withColumn("total", F.col("total").cast("decimal(28,2)"))


@query("select p_partkey, p_size::smallint as p_size, p_retailprice::decimal(12, 2) as price, p_brand from part")
def publish_refill(spark, sf_dir):
    from ledgerflow.plans import Publisher
    from ledgerflow.schema import Column, enforce

    p = Publisher(spark, _folder())
    columns = (Column("p_partkey", "BIGINT"), Column("p_size", "SMALLINT"), Column("price", "NUMERIC(12, 2)"), Column("p_brand", "VARCHAR(20)"))
    rows = t(spark, sf_dir, "part").select(F.col("p_retailprice").cast("decimal(18,2)").alias("price"), "p_partkey", "p_size", "p_brand")
    for run, df in (("r1", rows.filter("p_size > 40")), ("r2", rows)):
        p.commit([p.stage(enforce(df, columns), "parts", "task", run, "refill")], "task", run)
    return p.read("parts")


@query("select n_nationkey::varchar || chr(9) || case when n_regionkey = 0 then '\\N' else n_name end || chr(9) || (case when n_regionkey = 1 then 't' else 'f' end) as value from nation")
def copy_text_export(spark, sf_dir):
    from ledgerflow.sinks import copy_text

    r = F.col("n_regionkey")
    return copy_text(t(spark, sf_dir, "nation").select("n_nationkey", F.when(r != 0, F.col("n_name")).alias("name"), (r == 1).alias("b")))


@query("select 'published' as first, 'skipped' as second, 'published' as third, 5::bigint as rows, sum(n_nationkey)::bigint as total from nation")
def run_and_skip(spark, sf_dir):
    from ledgerflow.plans import Output, Pipeline, Publisher, csv_file, run_pipelines

    class ByRegion(Pipeline):
        output = Output("by_region")
        roles = {"rows": "nation"}

        def run(self, ctx, rows):
            return O.sum_by(O.strict_cast(rows, {"key": "int"}), ["region"], {"total": "key"})

    d = _folder()
    path = _csv(f"{d}/nation.csv", _small(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")[:5], ["key", "region"])
    p = Publisher(spark, f"{d}/published")
    go = lambda: run_pipelines(spark, "task", [ByRegion], [csv_file("nation", path)], p).status
    first, second = go(), go()
    _csv(path, _small(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), ["key", "region"])
    third = go()
    return p.read("by_region").agg(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(third).alias("third"), F.count(F.lit(1)).alias("rows"), F.sum("total").alias("total"))


import ledgerflow.queries_io  # noqa: E402, F401  its queries are registered here
