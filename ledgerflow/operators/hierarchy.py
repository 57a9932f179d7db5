"""Outline hierarchies of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerflow.operators.aggregates import quoted


def outline_leaves(df: DataFrame, level: str, label: str, position: str, by: list[str] | None = None, leaf: str = "position", prefix: str = "lev.", max_level: int | None = None) -> DataFrame:
    """The leaf rows of an outline (the next row isn't deeper) with their ancestors' labels, compacted to the left, in
    columns lev.1 to lev.(deepest - 1), and the last label as leaf. An ancestor at level k is the last label at k since
    any shallower row. Rows follow position; ``by`` (a file or sheet, which has 1,048,576 rows at most) sets outlines
    apart and is what the windows are partitioned by. A level under 1 raises, unless no row has one above 0."""
    by = by or []
    if max_level is None:
        max_level = df.agg(F.max(quoted(level))).first()[0] or 0
    rest = [quoted(c) for c in df.columns if c not in (level, label, *by)]
    keys = [quoted(c) for c in by]
    if max_level <= 0:
        return df.select(*keys, quoted(label).alias(leaf), *rest)
    order = W.partitionBy(*keys).orderBy(quoted(position))
    before = order.rowsBetween(W.unboundedPreceding, 0)
    n = F.col("_level")
    rows = df.withColumn("_level", F.when(quoted(level) >= 1, quoted(level)).otherwise(F.raise_error(F.concat(F.lit("invalid outline level at row "), quoted(position).cast("string"))).cast("int")))
    rows = rows.withColumn("_next", F.lead("_level", 1, 0).over(order))
    for k in range(1, max_level + 1):
        rows = rows.withColumn(f"_at{k}", F.last(F.when(n <= k, F.struct(n.alias("l"), quoted(label).alias("v"))), ignorenulls=True).over(before))
    labels = F.array_compact(F.array(*[F.when((n >= k) & (F.col(f"_at{k}.l") == k), F.col(f"_at{k}.v")) for k in range(1, max_level + 1)]))
    rows = rows.filter(F.col("_next") <= n).withColumn("_path", labels).filter(F.size("_path") > 0)
    levels = [F.when(F.size("_path") > k, F.get("_path", F.lit(k - 1))).alias(f"{prefix}{k}") for k in range(1, max_level)]
    return rows.select(*keys, *levels, F.element_at("_path", -1).alias(leaf), *rest)
