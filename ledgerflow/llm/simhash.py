"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints are made by Arrow batches over whole texts; all else works on distinct
fingerprints. Bit i of a fingerprint gets a non-zero vector m(i) of radius + 1 bits;
table v (every non-zero vector) keeps the bits whose m(i) has an odd product with v.
Any radius positions have vectors that leave some v orthogonal to all of them, so
every pair within the radius agrees in some table: no pair is missed.

A bucket's pairs are not listed. Fingerprints that share a bucket are candidates;
each candidate names itself and its 64 one-bit neighbours as pivots. Two
fingerprints share a pivot exactly if they differ in at most two bits, and a pivot
has at most 65 candidates, so each pivot's group becomes a star.

Defined cases: null and empty texts have the fingerprint zero; repeated rows share a
fingerprint, hence a component; null ids belong to components but name none (a
component of null ids alone has a null id); deduplicated() keeps a row for each text
among rows without an id; an empty table gives no row; extra columns are ignored by
the query and kept by deduplicated().
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm import near_copies
from ledgerflow.llm.common import scratch, table, text_bytes, text_hash, unused, written
from ledgerflow.llm.components import components

BITS, SHINGLE, RADIUS, HASH_SEED = 64, 3, 2, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z alone
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=HASH_SEED), parts), np.uint64)
    n, ones = len(h), np.zeros(BITS, np.int64)
    raw = h.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(raw[a : a + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' bit masks, as signed 64-bit numbers."""
    size = 1 << (radius + 1)
    m = [1 + i % (size - 1) for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (m[i] & v).bit_count() % 2) for v in range(1, size)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", text_bytes(text).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _companions(batches):
    """Of rows sorted by (t, key): the fp of rows whose bucket has another row."""
    last, first_out = None, False
    for b in batches:
        t, key, fp = (b.column(i).to_numpy() for i in range(3))
        if not len(t):
            continue
        same = np.zeros(len(t), bool)
        same[1:] = (t[1:] == t[:-1]) & (key[1:] == key[:-1])
        out = same.copy()
        out[:-1] |= same[1:]
        extra = []
        if last is not None and last[:2] == (t[0], key[0]):
            out[0] = True
            if not first_out:
                extra = [last[2]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(extra, np.int64), fp[out]]))], names=["fp"])
        last, first_out = (t[-1], key[-1], fp[-1]), bool(out[-1])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: edges between fingerprints, whose components are those of all pairs within the radius."""
    if radius not in (1, 2):
        raise ValueError("pivots link fingerprints of radius 1 or 2")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    rows = distinct.select("fp", F.explode(tables).alias("b")).select("b.t", "b.key", "fp")
    rows = rows.repartition("t", "key").sortWithinPartitions("t", "key")
    candidates = rows.mapInArrow(_companions, "fp long").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(BITS)])
    near = candidates.select("fp", F.explode(flips).alias("flip"))
    groups = near.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("pivot")).agg(F.collect_list("fp").alias("all"))
    if radius == 1:  # a pivot and its neighbours, where the pivot itself is a fingerprint
        groups = groups.filter(F.array_contains("all", F.col("pivot")))
        return groups.select("pivot", F.explode("all").alias("v")).select(F.col("pivot").alias("u"), "v").filter("u <> v")
    stars = groups.filter(F.size("all") > 1).select(F.array_min("all").alias("v"), F.explode("all").alias("u"))
    return stars.filter("u <> v").distinct()


def grouped(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    fps = written(fingerprints(docs, text), "simhash")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(reps.select("fp"), radius))
    named = reps.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = written(named, "simhash-roots")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(named.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id"), "simhash-components")
    return fps.join(names, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def near_grouped(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id of every row, texts being linked by their fingerprints or as near copies (near_copies.py)."""
    with scratch() as kept:
        sketched = near_copies.sketches(docs, fingerprint, text)
        texts = written(sketched.groupBy("t").agg(F.first("fp").alias("fp")), "near-texts")
        heads = written(texts.groupBy("fp").agg(F.min("t").alias("head")), "near-heads")
        alike = texts.join(heads, "fp").filter("t <> head").select(F.col("t").alias("u"), F.col("head").alias("v"))
        of = lambda c, to: heads.select(F.col("fp").alias(c), F.col("head").alias(to))
        # one thing after the other: side by side these jobs take the executors' memory together
        with scratch() as links_kept:
            near = written(near_copies.near_links(sketched), "near-all-links")
            links_kept.append(near)
        within = written(links(heads.select("fp"), radius), "near-within").join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
        roots = components(alike.union(within).union(near))
        rows = docs.select("doc_id", text_hash(text).alias("_t"))
        rows = written(rows.join(roots, F.col("_t") == F.col("u"), "left").select("doc_id", F.coalesce("v", "_t").alias("root")), "near-roots")
        lowest = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-lowest")
        kept += [rows, lowest]
    return rows.join(lowest, "root").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of each group of near copies (near_grouped) the row with the smallest doc_id (one of them, if the id repeats), with
    all its columns."""
    (name,) = unused(docs.columns, "_keep")
    keep = near_grouped(docs, text).select(F.col("component_id").alias(name)).filter(F.col(name).isNotNull()).distinct()
    rows = docs.join(keep, F.col("doc_id") == F.col(name), "left_semi")
    alone = docs.filter("doc_id is null")
    return rows.dropDuplicates(["doc_id"]).unionByName(alone.dropDuplicates([text]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    rows = grouped(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
