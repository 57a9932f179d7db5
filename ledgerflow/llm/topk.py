"""Exact top-k search by inner product, through segment statistics at several resolutions.

A vector's segments have a mean m and a deviation s. For segments of l components
q.c <= sum l * (m_q m_c + s_q s_c), which bounds the distance |q-c|^2 = |q|^2 +
|c|^2 - 2 q.c from below. Bounds are taken over 1, 4, then 16 segments; what they
cannot rule out against the k-th best score so far is scored exactly.

Vectors are packed, BLOCK_ROWS to a row, so that pairs of blocks, not of vectors,
move. Query blocks are replicated over the cells of candidate blocks by an
equi-join on the cell number; nothing is broadcast, and a task keeps one candidate
block, one query block and the best k of the query block.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of another length than the query's are not its candidates; rows
of one vec_id are one vector, whose score is the best of its rows; rows without a
vec_id take no part; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerflow.llm.common import table, written

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Candidate rows that share one copy of the query blocks.
CELL_ROWS = 131072
SEGMENTS = (1, 4, 16)
#: Rows whose scores are made at once.
TILE = 256


def _pack(rows: int, scale: float):
    """Rows of (id, vector) to rows of (dim, ids, data): whole numbers floor(scale * x) in 64 bits."""

    def run(frames):
        kept: dict[int, list] = {}

        def out(d):
            ids = np.array([i for i, _ in kept[d]], np.int64)
            data = np.array([v for _, v in kept[d]], np.int64).reshape(len(ids), d)
            kept[d] = []
            return pd.DataFrame({"dim": [np.int32(d)], "ids": [ids.tobytes()], "data": [data.tobytes()], "rows": [np.int64(len(ids))]})

        for pdf in frames:
            for i, v in zip(pdf["id"], pdf["v"]):
                x = np.floor(scale * np.asarray(v, np.float64))
                if np.abs(x).max(initial=0) >= 2.0**31:
                    raise ValueError(f"vector {i}: a component beyond 2^31 / {scale}")
                kept.setdefault(len(x), []).append((i, x))
                if len(kept[len(x)]) == rows:
                    yield out(len(x))
        for d in kept:
            if kept[d]:
                yield out(d)

    return run


PACKED = "dim int, ids binary, data binary, rows long"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of a segment's length: bounds are then one product."""
    n, d = x.shape
    cuts = np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(int)
    cols = []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = x[:, a:b]
            m = part.mean(1)
            dev = np.sqrt(np.maximum((part * part).mean(1) - m * m, 0))
            cols += [m * (b - a) ** 0.5, dev * (b - a) ** 0.5]
    return np.array(cols).T.reshape(n, -1)


class _Block:
    def __init__(self, dim: int, ids: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        raw = np.frombuffer(data, np.int64).reshape(len(self.ids), dim)
        top = int(np.abs(raw).max(initial=0))
        self.exact = raw if top * top * max(dim, 1) >= 2**53 else None  # else whole numbers fit in a double's 53 bits
        self.x = raw.astype(np.float64)
        self.stats = [_stats(self.x, s) for s in SEGMENTS if s < dim] if dim else []


def _merge(best: list, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """best[r]: at most k (score, id), highest first, ties to the smaller id, an id once."""
    _, at = np.unique(np.stack([rows, ids]), axis=1, return_inverse=True)
    order = np.lexsort((-scores, at.ravel()))  # each id's best score in each row comes first
    first = np.concatenate([[True], np.diff(at.ravel()[order]) != 0])
    rows, ids, scores = rows[order][first], ids[order][first], scores[order][first]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    for r in np.unique(rows):
        a, b = np.searchsorted(rows, r), np.searchsorted(rows, r, "right")
        top = {int(i): int(s) for i, s in zip(ids[a : min(b, a + k)], scores[a:b])}
        for s, i in best[r]:
            top[i] = max(s, top.get(i, s))
        best[r] = sorted(((s, i) for i, s in top.items()), key=lambda t: (-t[0], t[1]))[:k]


def search(q: _Block, c: _Block, best: list, k: int) -> None:
    """Brings the candidates of one block into best."""
    for a in range(0, len(q.ids), TILE):
        qi = slice(a, min(a + TILE, len(q.ids)))
        for b in range(0, len(c.ids), 16 * TILE):
            ci = slice(b, min(b + 16 * TILE, len(c.ids)))
            floor_ = np.array([t[-1][0] if len(t := best[r]) == k else -np.inf for r in range(qi.start, qi.stop)], np.float64)
            live = np.ones((qi.stop - qi.start, ci.stop - ci.start), bool)
            for sq, sc in zip(q.stats, c.stats):
                bound = sq[qi] @ sc[ci].T
                live &= bound + 1e-6 * (1 + np.abs(bound)) >= floor_[:, None]
                if not live.any():
                    break
            cols = np.flatnonzero(live.any(0))
            if not len(cols):
                continue
            if q.exact is None and c.exact is None and q.x.shape[1] == c.x.shape[1] and np.abs(q.x[qi]).max(initial=0) * np.abs(c.x[ci]).max(initial=0) * max(q.x.shape[1], 1) < 2**53:
                s = q.x[qi] @ c.x[ci][cols].T
            else:
                s = q.x[qi].astype(np.int64) @ c.x[ci][cols].astype(np.int64).T
            ids = c.ids[ci][cols]
            ok = live[:, cols] & (ids[None, :] != q.ids[qi][:, None])
            # the k-th best of this tile bounds what can still be among the best, if ids don't repeat in it
            if ok.shape[1] > k and len(np.unique(ids)) == len(ids):
                lowest = np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf
                ok &= s >= np.partition(np.where(ok, s, lowest), -k, axis=1)[:, -k][:, None]
            ok &= s >= floor_[:, None]
            r, j = np.nonzero(ok)
            if len(r):
                _merge(best, r + a, ids[j], s[r, j].astype(np.int64), k)


def _pairs(k: int):
    def run(frames):
        q_raw, q, best = None, None, []
        c_raw, c = None, None

        def rows():
            got = [(int(q.ids[r]), i, s) for r in range(len(best)) for s, i in best[r]]
            return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

        for pdf in frames:
            for dim, q_ids, q_data, ids, data in zip(pdf["dim"], pdf["q_ids"], pdf["q_data"], pdf["ids"], pdf["data"]):
                if q is None or q_raw != (dim, q_ids, q_data):
                    if q is not None:
                        yield rows()
                    q_raw, q = (dim, q_ids, q_data), _Block(dim, q_ids, q_data)
                    best = [[] for _ in q.ids]
                if c is None or c_raw != (dim, ids, data):
                    c_raw, c = (dim, ids, data), _Block(dim, ids, data)
                search(q, c, best, k)
        if q is not None:
            yield rows()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of other ids with the highest inner product."""
    spark = candidates.sparkSession
    qs = usable(queries, id_col, vec_col)
    n_q, n_c = queries.count(), candidates.select(id_col).count()
    parts = max(1, -(-n_q // QUERY_ROWS))
    cells = max(spark.sparkContext.defaultParallelism, -(-n_c // CELL_ROWS))
    q = written(qs.repartition(parts).mapInPandas(_pack(QUERY_ROWS, scale), PACKED), "topk-q")
    q = q.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    c = usable(candidates, id_col, vec_col).mapInPandas(_pack(BLOCK_ROWS, scale), PACKED)
    c = c.withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int"))
    # one key and a number of partitions: the work is in the scores, so cells aren't put together by their bytes
    slot = (F.col("cell").cast("long") * 2**31 + F.col("dim")).alias("slot")
    q, c = (x.select(slot, *[k for k in x.columns if k != "cell"]).repartition(cells, "slot") for x in (q, c.withColumnRenamed("dim", "c_dim").withColumn("dim", F.col("c_dim"))))
    pairs = q.hint("merge").join(c.drop("dim"), "slot").select("dim", "q_ids", "q_data", "ids", "data")
    found = pairs.mapInPandas(_pairs(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
