"""Substring dedup on a compacted de Bruijn graph of words.

Edges are word k-mers. Of a document's edges only the anchors are drawn: the least
hashed k-mer of each window of SPAN words (a window's anchor depends on its words
alone, so equal windows have equal anchors). 1. Anchors meet by hash; those with one
occurrence are unique paths and go. 2. Joined back to their documents, repeated
anchors select the windows that may repeat, and runs of them are the graph's
nonbranching paths, kept as source coordinates (document, first word) in one
packed row. 3. Windows meet by their anchor's and a hash of all their words; all but the
earliest occurrence are duplicates. 4. Their coordinates go back to the documents.

Each task first settles what repeats inside a chunk of CHUNK_WORDS words and sends one
row of each anchor or window. A passage that millions of documents share
thus costs a row per chunk, not per document, and sorted runs are read as streams:
no group is held in memory.

Defined cases: a null or empty text has no words; rows with equal doc_id and text are
one document, each row gets its result; among rows with one doc_id and different
texts the smaller text hash is earlier; a null id is the smallest; ids that aren't whole
numbers are refused; documents under SPAN words have no window; an empty table gives no
row; extra columns are kept, whatever their names, by deduplicated() and ignored by the query.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import bounded, encoded, id_key, mix64, numbered, scratch, split_all, starts_of, table, text_bytes, text_hash, unused, with_n_chars, written

SPAN, K, CHUNK_WORDS = 20, 6, 400_000
NO_ID = -(2**63)
#: Windows of one task that are put together by document before they move.
HELD = 1_000_000
_MOST = np.uint64(2**64 - 1)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _keyed(docs: DataFrame, text: str, names: tuple[str, str] = ("_k1", "_k2")) -> DataFrame:
    """docs with keys, whose names no column may have."""
    return docs.withColumns({names[0]: id_key(docs), names[1]: text_hash(text)})


def _packed(at: int):
    """Batches with column at (binary, texts) compressed: they are moved twice, and Spark's own codec does half as well."""

    def run(batches):
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            cols = b.columns
            cols[at] = pa.array([None if t is None else z.compress(t) for t in cols[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def _opened(blobs: list[bytes | None]) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if t is None else z.decompress(t) for t in blobs]


def _chunks(batches, at: int, unpack: bool = False):
    """Columns of rows with about CHUNK_WORDS words, as lists; at: the text's column."""
    rows: list[list] | None = None
    size = 0
    for b in batches:
        cols = [(_opened(c.to_pylist()) if unpack else c.to_pylist()) if i == at else c for i, c in enumerate(b.columns)]
        start = 0
        for j, t in enumerate(cols[at]):
            size += len(t)
            if size >= 6 * CHUNK_WORDS or j == len(cols[at]) - 1:
                part = [c[start : j + 1] if i == at else c.slice(start, j + 1 - start) for i, c in enumerate(cols)]
                rows = [[p] for p in part] if rows is None else [[*r, p] for r, p in zip(rows, part)]
                start = j + 1
                if size >= 6 * CHUNK_WORDS:
                    yield [sum(r, []) if i == at else pa.concat_arrays(r) for i, r in enumerate(rows)]
                    rows, size = None, 0
    if rows is not None:
        yield [sum(r, []) if i == at else pa.concat_arrays(r) for i, r in enumerate(rows)]


class _Words:
    """Hashes of a chunk's words, with the documents' bounds."""

    def __init__(self, texts: list[bytes]):
        self.flat, self.counts = split_all(texts)
        codes, forms = encoded(self.flat)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, forms), np.uint64, len(forms))
        self.h = hashes[codes] if len(forms) else np.empty(0, np.uint64)
        self.starts = starts_of(self.counts)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.left = np.repeat(self.starts + self.counts, self.counts) - np.arange(len(self.h))  # words up to the end

    def rolled(self, k: int, p: np.uint64) -> np.ndarray:
        """A hash of the k words from each place on."""
        n = max(len(self.h) - k + 1, 0)
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc = acc * p + self.h[j : j + n]
        return mix64(acc ^ p)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places where windows start, their anchors' hashes and places."""
        n = len(self.h) - SPAN + 1
        if n <= 0:
            e = np.empty(0, np.int64)
            return e, e.astype(np.uint64), e
        x, w = self.rolled(K, _P1), SPAN - K + 1
        m, have = x, 1
        while have * 2 <= w:
            m, have = np.minimum(m[: len(m) - have], m[have:]), have * 2
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])[:n] if have < w else m[:n]
        place = np.full(n, -1, np.int64)
        for j in range(w - 1, -1, -1):
            place[x[j : j + n] == m] = j
        at = np.flatnonzero(self.left[:n] >= SPAN)
        return at, m[at], at + place[at]


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind) -> pa.Array:
    """values, of which doc tells the row (ascending), as a list column of n rows."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _draw(batches):
    """(doc_id, k1, k2, text) -> a row for each document: once and many, anchors that the chunk has once or more often,
    each named by its first document; own, the document's anchors that the chunk has more often."""
    for doc_id, k1, k2, texts in _chunks(batches, 3):
        w = _Words(texts)
        _, a, place = w.anchors()
        place, first = np.unique(place, return_index=True)
        a, doc = a[first], w.doc[place] if len(place) else place
        _, lead, inv, count = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
        again = count[inv] > 1
        lead = np.sort(lead)
        one, more = lead[~again[lead]], lead[again[lead]]
        n = len(texts)
        sha = [hashlib.sha256(b" ".join(w.flat[s : s + c])).hexdigest() for s, c in zip(w.starts, w.counts)]
        yield pa.RecordBatch.from_arrays(
            [doc_id, k1, k2, pa.array(w.counts), pa.array(sha), *(_lists(_signed(a)[i], doc[i], n, pa.int64()) for i in (one, more, np.flatnonzero(again)))],
            names=["doc_id", "k1", "k2", "n_words", "sha", "once", "many", "own"],
        )


def _repeated(batches):
    """(a, g, many), sorted by a -> (g, a) of rows whose a has another row, or many."""
    flagged, pending = None, None
    for b in batches:
        a, g = (b.column(i).to_numpy() for i in range(2))
        many = b.column(2).to_numpy(zero_copy_only=False)
        if pending is not None:
            a, g, many = (np.concatenate([[p], c]) for p, c in zip(pending, (a, g, many)))
        if not len(a):
            continue
        new = np.concatenate([[True], a[1:] != a[:-1]])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        flag = (size > 1) | (np.bincount(group, many) > 0)
        if a[0] == flagged:
            flag[0] = True
        out = flag[group] & (many == 0)
        if flag[-1]:
            flagged, pending = a[-1], None
        else:
            flagged, pending = None, (a[-1], g[-1], many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (g, a)], names=["g", "a"])


def _windows(batches):
    """(k1, k2, anchors, packed text) -> paths of windows to compare (a, k1, k2, pos, hashes), neighbours with one anchor in
    a row, each sequence of a chunk once; and the windows that already repeat one in their chunk (lost)."""
    for k1, k2, anchors, texts in _chunks(batches, 3, unpack=True):
        w = _Words(texts)
        at, a, _ = w.anchors()
        k1, k2, n = k1.to_numpy(), k2.to_numpy(), len(texts)
        wanted = anchors.flatten().to_numpy().view(np.uint64)
        size = np.diff(anchors.offsets.to_numpy())
        # (document, anchor) pairs in question, as one number each; a false agreement only adds a window to compare
        pair = lambda d, x: mix64(x ^ mix64(d.astype(np.uint64) + np.uint64(1)))
        on = np.isin(pair(w.doc[at], a), pair(np.repeat(np.arange(n), size), wanted)) if len(at) else np.zeros(0, bool)
        at, a = at[on], a[on]
        if not len(at):
            continue
        h = w.rolled(SPAN, _P2)[at]
        doc = w.doc[at]
        pos = at - w.starts[doc]
        rank = np.empty(n, np.int64)
        order = np.lexsort((k2, k1))
        rank[order] = np.cumsum(np.concatenate([[0], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]))
        when = (rank[doc] << 32) | pos
        order = np.lexsort((when, h, a))
        lead = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (h[order][1:] != h[order][:-1])])
        first = when[order][np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))]
        sent, lost = np.zeros(len(at), bool), np.zeros(len(at), bool)
        sent[order] = lead
        lost[order] = when[order] != first
        d, p, x, y = doc[sent], pos[sent], a[sent], h[sent]
        start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (x[1:] != x[:-1])]))
        ends = np.append(start, len(p)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_signed(x[start])), pa.array(k1[d[start]]), pa.array(k2[d[start]]), pa.array(p[start].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(y))), pa.nulls(len(start), pa.binary())],
            names=["a", "k1", "k2", "pos", "hashes", "lost"],
        )
        if lost.any():
            d, p = doc[lost], pos[lost].astype(np.int32)
            ids = np.unique(d)
            spread = _signed(mix64(k2[ids].view(np.uint64)))
            ends = np.append(np.searchsorted(d, ids), len(d))
            places = [p[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(k1[ids]), pa.array(k2[ids]), pa.array(np.full(len(ids), -1, np.int32)), pa.nulls(len(ids), pa.list_(pa.int64())), pa.array(places, pa.binary())],
                names=["a", "k1", "k2", "pos", "hashes", "lost"],
            )


def _by_document(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((pos, k2, k1))
    k1, k2, pos = k1[order], k2[order], pos[order]
    start = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    ends = np.append(start, len(pos)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(k1[start]), pa.array(k2[start]), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))], names=["k1", "k2", "lost"])


def _later(batches):
    """Windows sorted by h -> (k1, k2, lost) of all but the earliest of each sequence (h, a). Of a sequence that goes on in
    the next batch the earliest so far is kept, so any number of copies streams through."""
    heads: dict[int, tuple] = {}
    last, held, n_held = None, [], 0
    for b in batches:
        packed = pa.compute.is_valid(b.column(5))
        whole = b.filter(packed)
        if whole.num_rows:
            places = whole.column(5).to_pylist()
            ends = np.cumsum([0, *(len(x) // 4 for x in places)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(places), np.int32)))
            yield pa.RecordBatch.from_arrays([whole.column(2), whole.column(3), lists], names=["k1", "k2", "lost"])
            b = b.filter(pa.compute.invert(packed))
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(5)]
        order = np.lexsort((cols[4], cols[3], cols[2], cols[0], cols[1]))
        a, h, k1, k2, pos = (c[order] for c in cols)
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])]))
        source = np.repeat(first, np.diff(np.append(first, len(a))))
        b1, b2, bp = k1[source], k2[source], pos[source]
        late: list[tuple] = []
        if h[0] == last:
            for i, end in zip(first, np.append(first[1:], len(a))):
                if h[i] != last:
                    break
                own, best = (k1[i], k2[i], pos[i]), heads.get(a[i])
                if best is not None and best < own:
                    b1[i:end], b2[i:end], bp[i:end] = best
                elif best is not None and own < best:
                    late.append(best)
        else:
            heads = {}
        if h[-1] != last:
            heads, last = {}, h[-1]
        for i in reversed(first):
            if h[i] != last:
                break
            heads[a[i]] = (b1[i], b2[i], bp[i])
        lost = (k1 != b1) | (k2 != b2) | (pos != bp)
        if late or lost.any():
            more = np.array(late, np.int64).reshape(-1, 3)
            held.append([np.concatenate([c[lost], x.astype(c.dtype)]) for c, x in zip((k1, k2, pos), more.T)])
            n_held += len(held[-1][0])
            if n_held > HELD:
                yield _by_document(*map(np.concatenate, zip(*held)))
                held, n_held = [], 0
    if held:
        yield _by_document(*map(np.concatenate, zip(*held)))


def drawn(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document's key, words and anchors, as a written table."""
    rows = _keyed(docs.select("doc_id", F.col(text).alias("text")), "text").select("doc_id", "_k1", "_k2", text_bytes().alias("_text"))
    longs = T.ArrayType(T.LongType())
    kind = T.StructType([rows.schema["doc_id"], *[T.StructField(c, t) for c, t in (("k1", T.LongType()), ("k2", T.LongType()), ("n_words", T.LongType()), ("sha", T.StringType()), ("once", longs), ("many", longs), ("own", longs))]])
    return written(rows.mapInArrow(_draw, kind), "substrings-drawn")


def suspects(docs: DataFrame, edges: DataFrame, text: str = "text") -> DataFrame:
    """k1, k2, anchors, text (packed) of the documents with repeated anchors, as a written table. Up to here documents go by
    g, their id or, without one, their text's hash: should some share an id, they are only compared at more places."""
    g = F.when(F.col("k1") == NO_ID, F.col("k2")).otherwise(F.col("k1")).alias("g")
    met = edges.select(F.explode("once").alias("a"), g, F.lit(False).alias("many"))
    met = met.union(edges.select(F.explode("many").alias("a"), F.lit(0).cast("long"), F.lit(True)))
    replies = met.repartition("a").sortWithinPartitions("a").mapInArrow(_repeated, "g long, a long")
    flagged = replies.groupBy("g").agg(F.collect_list("a").alias("anchors"))
    flagged = flagged.union(edges.filter(F.size("own") > 0).select(g, F.col("own").alias("anchors")))
    flagged = flagged.groupBy("g").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    rows = _keyed(docs.select("doc_id", F.col(text).alias("text")), "text").select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), text_bytes().alias("text"))
    rows = rows.mapInArrow(_packed(2), "k1 long, k2 long, text binary").withColumn("_g", g)
    joined = rows.join(flagged.hint("merge"), F.col("_g") == F.col("g"))
    return written(joined.select("k1", "k2", "anchors", "text"), "substrings-suspects")


def lost_windows(found: DataFrame) -> DataFrame:
    """k1, k2, lost: the first words of a document's windows that also start earlier. found: as of suspects()."""
    rows = found.mapInArrow(_windows, "a long, k1 long, k2 long, pos int, hashes array<long>, lost binary").repartition("a")
    # lost is binary as Spark takes ten times as long to hand rows with a list to Python
    # paths move packed and are spread into windows where they meet; one sort key of 64 bits is sorted by radix
    rows = rows.select("a", "k1", "k2", "pos", "lost", F.posexplode_outer("hashes").alias("i", "h"))
    rows = rows.select("a", "h", "k1", "k2", (F.col("pos") + F.coalesce("i", F.lit(0))).alias("pos"), "lost")
    late = rows.sortWithinPartitions("h").mapInArrow(_later, "k1 long, k2 long, lost array<int>")
    return late.groupBy("k1", "k2").agg(F.flatten(F.collect_list("lost")).alias("lost"))


def _covered(lost, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.asarray(lost, np.int64))
    edge[at] += 1
    edge[at + SPAN] -= 1
    return np.cumsum(edge)[:n] > 0


def _digest(batches):
    for b in batches:
        n_removed, sha = [], []
        for lost, t in zip(b.column(3).to_pylist(), _opened(b.column(4).to_pylist())):
            words = t.split()
            gone = _covered(lost, len(words))
            n_removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join([x for x, g in zip(words, gone) if not g])).hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n_removed, pa.int64()), pa.array(sha)], names=["k1", "k2", "n", "n_removed", "kept_sha256"])


def without(text: bytes, lost) -> bytes:
    """text without the words of the lost windows, and without the white space before each of them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = _covered(lost, len(spans))
    out, at = [], 0
    for (_, end), g in zip(spans, gone):
        if not g:
            out.append(text[at:end])
        at = end
    return b"".join(out).lstrip(b" ") + text[at:]


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, their texts without words that repeat earlier ones; texts without such words are as they were."""
    with scratch() as kept:
        kept.append(found := suspects(docs, drawn(docs, text), text))
    lost = lost_windows(found)
    names, at = docs.columns, docs.columns.index(text)
    bounded(docs.sparkSession)
    k1, k2 = unused(names, "_k1", "_k2")
    rows = numbered(_keyed(docs, text, (k1, k2)).withColumn(text, F.col(text).cast("binary")))
    rows = rows.mapInArrow(_packed(at), rows.schema)
    own, (k1, k2) = rows.columns[:-2], rows.columns[-2:]
    lost = lost.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "lost").hint("merge")
    rows = rows.join(lost, (F.col(k1) == F.col("l1")) & (F.col(k2) == F.col("l2")), "left").select(*own, "lost")
    kind = numbered(docs).schema

    def run(batches):
        for b in batches:
            cols, lists = b.columns[:-1], b.column(b.num_columns - 1).to_pylist()
            texts = [t if t is None or x is None else without(t, x) for t, x in zip(_opened(cols[at].to_pylist()), lists)]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=own)

    return with_n_chars(rows.mapInArrow(run, kind).toDF(*names), text)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space) of every row."""
    bounded(docs.sparkSession)
    edges = drawn(docs, text)
    found = suspects(docs, edges, text)
    lost = written(lost_windows(found), "substrings-lost")
    keys = ["k1", "k2"]
    cut = found.join(lost.hint("merge"), keys).select(*keys, F.lit(0).alias("n"), "lost", "text")
    cut = cut.mapInArrow(_digest, "k1 long, k2 long, n int, n_removed long, kept_sha256 string").dropDuplicates(keys).drop("n")
    rows = edges.select("doc_id", *keys, "n_words", "sha").join(cut, keys, "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 20-word windows that start earlier as well."""
    return judged(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from d),
k as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d where len(ws) >= 20)),
r as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from k),
g as (select distinct doc_id, i + j as p from r, (select unnest(range(20)) as j) where r > 1),
s as (select w.doc_id, count(*) as n_words, count(g.p) as n_removed, string_agg(word, ' ' order by w.p) filter (g.p is null) as kept
      from w left join g on w.doc_id = g.doc_id and w.p = g.p group by w.doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join s on d.doc_id = s.doc_id
"""
