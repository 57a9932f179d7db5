"""Connected components of an edge table, by alternating large and small stars.

Each task first reduces its own edges to a spanning star forest, which bounds what a
hub sends. FEW edges at most are then merged by one task: rounds over so little would only burden the driver, which
plans each and holds the small tables that its joins broadcast. More edges go through the rounds, each a written table, so
that lineage stays short. Nothing but a row of checksums reaches the driver.

Defined cases: an edge with a null end, or from a node to itself, links nothing; repeated edges count once; an empty
table gives no row; columns but u and v are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import written

PAIR = "u long, v long"
#: At most 2^19 nodes, fewer than a task holds in _forest().
FEW = 1 << 18


def _forest(batches):
    """(u, v) -> (node, root of the batch's forest); roots are minima."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    def out():
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter((root(x) for x in parent), np.int64, len(parent))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = root(x), root(y)
            lo, hi = min(a, c), max(a, c)
            parent.setdefault(lo, lo)
            parent[hi] = lo
        if len(parent) > 1_000_000:
            yield out()
            parent.clear()
    if parent:
        yield out()


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of u. The join's key differs from the aggregate's, so that both sides are
    exchanged and Spark can split a hub's edges over tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(1)).alias("k"), "m")
    return edges.withColumn("k", F.col("u").bitwiseXOR(F.lit(1))).join(least, "k").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """u and v, the least node of u's component, for every node with an edge to another (but the least ones)."""
    flat = edges.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = written(flat.mapInArrow(_forest, PAIR).distinct(), "cc")
    if now.count() <= FEW:
        return written(now.coalesce(1).mapInArrow(_forest, PAIR), "cc")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        stars = _with_least(large)
        small = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "cc")
        h = F.xxhash64("u", "v")
        row = now.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(F.shiftright(h, 20) % 1_000_003)).first()
        if tuple(row) == seen or not row[0]:
            return now
        seen = tuple(row)
