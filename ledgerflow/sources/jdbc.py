"""JDBC tables and queries; filters and columns are pushed down by Spark.

An embedded database is part of the process that opened it, the driver. Tasks in other processes would open empty ones of
their own, so there the driver itself reads such a database, whole and once for each call, without push-down.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

SAFE = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)?")
EMBEDDED = re.compile(r"jdbc:(derby:(?!//)|h2:(?!tcp:|ssl:)|hsqldb:(?!hsqls?:|https?:)|sqlite:)", re.IGNORECASE)


def driver_only(spark: SparkSession, url: str) -> bool:
    """Whether the database is in the driver's process and tasks are in others."""
    return bool(EMBEDDED.match(url)) and not spark.sparkContext._jsc.sc().isLocal()


@contextlib.contextmanager
def connection(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator:
    """A connection of the driver's, one transaction."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    known = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            known.setProperty(k, options[k])
    c = jvm.java.sql.DriverManager.getConnection(url, known)
    try:
        c.setAutoCommit(False)
        yield c
        c.commit()
    except BaseException:
        c.rollback()
        raise
    finally:
        c.close()


def read_by_driver(df: DataFrame, url: str, options: dict[str, str], query: str) -> DataFrame:
    """The rows that the query has now. df: the same as Spark would read it, for its schema."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    with connection(spark, url, options) as c:
        s = c.createStatement()
        dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
        rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(s.executeQuery(query), df._jdf.schema(), dialect)
        rows = jvm.java.util.ArrayList(jvm.scala.jdk.javaapi.CollectionConverters.asJavaCollection(rows.toList()))
        s.close()
    return DataFrame(spark._jsparkSession.createDataFrame(rows, df._jdf.schema()), spark)


class JdbcSource:
    """A database. Tables are kept by what they were asked for with, and read anew by every action; by every call, where the
    driver reads."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options, self._kept = spark, url, options, {}

    def get_table(self, table: str | None = None, query: str | None = None, postprocess: Callable[[DataFrame], DataFrame] | None = None, fetch_size: int = 2000, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        """One of table and query. partition: (column, lower, upper, parts) reads in parallel."""
        if (table is None) == (query is None):
            raise ValueError("one of table and query")
        if table is not None and not SAFE.fullmatch(table):
            raise ValueError(f"{table!r} isn't a plain table name")
        if partition and query is not None:
            raise ValueError("only tables are read in parts")
        key = (table, query, fetch_size, partition)
        if key not in self._kept:
            r = self.spark.read.format("jdbc").option("url", self.url).options(**self.options).option("fetchsize", fetch_size)
            if partition:
                column, low, high, parts = partition
                r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
            self._kept[key] = r.option("query", query).load() if query else r.option("dbtable", table).load()
        df = self._kept[key]
        if driver_only(self.spark, self.url):
            df = read_by_driver(df, self.url, self.options, query or f"SELECT * FROM {table}")
        return postprocess(df) if postprocess else df


def catalog_table(spark: SparkSession, table: str, postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table of Spark's catalog, under the same rules."""
    if not SAFE.fullmatch(table):
        raise ValueError(f"{table!r} isn't a plain table name")
    df = spark.table(table)
    return postprocess(df) if postprocess else df
