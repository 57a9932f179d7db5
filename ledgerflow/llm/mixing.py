"""Mixing sources to target weights, by blocks.

Each source's words form one stream, cut into blocks of BLOCK words. A mix has as
many block slots as the targets ask for, spread over output shards. How many slots
of a shard a source gets is drawn multinomially, given the source totals: a binary
tree over the shards splits the totals by multivariate hypergeometric draws, which
is the multinomial's law under fixed sums, so that every shard can be computed on
its own from the seed. Slot j of a source holds block perm(j) of that source;
perm is a keyed permutation of the source's block numbers (another for each
epoch), so a block recurs only after all others were used. A source's last slot is
cut so that its words are the target, rounded. Slots and documents' blocks then
meet in an equi-join on (source, block).

Defined cases: a null text has no words and is never taken; null is a source of
its own, the last; repeated rows count and are taken each on its own; a source
without words has target 0; a null id comes first; ids that aren't whole numbers are
refused; an empty table gives no row; extra columns are ignored by the query and kept,
whatever their names, by mixed_documents().
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerflow.llm.common import bounded, id_key, n_words, numbered, table, text_hash, unused, with_n_chars, written

#: Words in a block, and slots of a shard.
BLOCK = 64
SHARD_SLOTS = 16384
#: Documents in one piece of a source's stream; pieces are what prefix sums go over.
PIECE_DOCS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, 20240521


def targets_for(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most times its size; what is over goes to the others by weight."""
    out = [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], total
    while free:
        w = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permuted(j: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """perm(j) for j in [0, n): a four-round Feistel network on the least even number of bits, walked until inside. inverse: the
    j of which perm(j) is given."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), j.astype(np.uint64)
    todo = np.arange(len(out))

    def mixed_in(x, r):
        f = (x + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        f ^= f >> np.uint64(29)
        return ((f * np.uint64(0x94D049BB133111EB)) >> np.uint64(31)) & mask

    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in (3, 2, 1, 0) if inverse else range(4):
            left, right = (right ^ mixed_in(left, r), left) if inverse else (right, left ^ mixed_in(right, r))
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(shard: int, n_shards: int, counts: list[int], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Each source's slots in the shard, and the number of its slots in the shards before."""
    have, before = np.array(counts, np.int64), np.zeros(len(counts), np.int64)
    lo, hi = 0, n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = (int(have.sum()) * (mid - lo)) // (hi - lo)
        left = np.array(_draw(seed, lo, hi, tuple(have.tolist()), take), np.int64)
        if shard < mid:
            have, hi = left, mid
        else:
            have, before, lo = have - left, before + left, mid
    return have, before


@lru_cache(256)  # shards beside each other share all draws but the last
def _draw(seed: int, lo: int, hi: int, have: tuple[int, ...], take: int) -> tuple[int, ...]:
    """How many of each source's slots are among take of all of them."""
    rng, out, rest = np.random.default_rng(_key(seed, lo, hi)), [], sum(have)
    for n in have:
        rest -= n
        out.append(hypergeometric(rng.random(), n, rest, take))
        take -= out[-1]
    return tuple(out)


def hypergeometric(u: float, good: int, bad: int, take: int) -> int:
    """The value of the hypergeometric law at u in [0, 1), by inversion from its mode. Numbers of any size; what lies beyond
    14 deviations and 40, which is less than a double can hold beside 1, counts as impossible."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    n = good + bad
    mode = min(max((take + 1) * (good + 1) // (n + 2), low), high)
    reach = 40 + math.ceil(14 * math.sqrt(take * (good / n) * (bad / n) * ((n - take) / max(n - 1, 1))))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((take - k) / (bad - take + k + 1))  # of P(k + 1) / P(k)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(below, u * below[-1], "right")), high - low)


def slots_of(no: int, size: int, target: float, seed: int = SEED) -> tuple[int, int]:
    """How many slots a source has, and how many words of the last one's block are left out, so that target (rounded) are taken."""
    words, blocks = round(target), -(-size // BLOCK)
    if not size or not words:
        return 0, 0
    epoch, words = divmod(words - 1, size)
    words += 1  # of the last epoch, 1 to size
    short = size - (blocks - 1) * BLOCK  # what the last block has
    at = int(permuted(np.array([blocks - 1]), blocks, _key(seed, no, epoch), inverse=True)[0])
    n = -(-words // BLOCK)
    if at < n:  # the last block is among them
        n = max(at + 1, -(-(words + BLOCK - short) // BLOCK))
    return epoch * blocks + n, n * BLOCK - (BLOCK - short if at < n else 0) - words


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, text: str = "text", source: str = "source", seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """The documents' places in their sources' streams, and the sources with size, target, blocks and slots.

    Sources are collected to the driver: they number as the corpora that are mixed, not as their documents."""
    base = docs.select("doc_id", F.col(source).cast("string").alias("source"), n_words(text).alias("size"), id_key(docs).alias("k1"), text_hash(text).alias("k2"))
    n = docs.select(F.lit(1)).count()
    pieces = max(64, -(-n // PIECE_DOCS))
    base = written(base.withColumn("piece", F.pmod(F.xxhash64("k1", "k2", "size"), F.lit(pieces)).cast("int")), "mix-sizes")
    per = written(base.groupBy("source", "piece").agg(F.sum("size").alias("words")), "mix-pieces")
    found = sorted(((r.source, int(r.words)) for r in per.groupBy("source").agg(F.sum("words").alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    target = targets_for([s for _, s in found], [weights[i % len(weights)] for i in range(len(found))], share * sum(s for _, s in found), most)
    sources = []
    for i, ((name, size), t) in enumerate(zip(found, target)):
        blocks = -(-size // BLOCK)
        n, unused_words = slots_of(i, size, t, seed)
        sources.append({"no": i, "source": name, "size": size, "target": t, "blocks": blocks, "slots": n, "cut": unused_words})
    dim = _dimension(docs.sparkSession, sources)
    within = W.partitionBy("piece", "source").orderBy("k1", "size", "k2")
    placed = base.repartition(F.col("piece")).withColumn("_end", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
    offsets = per.withColumn("_from", F.sum("words").over(W.partitionBy("source").orderBy("piece")) - F.col("words"))
    offsets = offsets.select(F.col("source").alias("_s"), F.col("piece").alias("_p"), "_from")
    placed = placed.join(offsets, (F.col("piece") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    placed = placed.join(F.broadcast(dim.select(F.col("source").alias("_t"), "no", "source_size", "target")), F.col("source").eqNullSafe(F.col("_t")))
    start = F.col("_from") + F.col("_end") - F.col("size")
    return placed.select("doc_id", "k1", "k2", "source", "no", "size", "source_size", "target", start.alias("start")), sources


def _dimension(spark: SparkSession, sources: list[dict]) -> DataFrame:
    rows = [(s["no"], s["source"], s["size"], float(s["target"]), s["blocks"], s["slots"]) for s in sources]
    return spark.createDataFrame(rows, "no int, source string, source_size long, target double, blocks long, slots long")


def slots(spark: SparkSession, sources: list[dict], seed: int = SEED) -> DataFrame:
    """Every slot of the mix: shard, no (the source's), epoch, block and upto, how many of the block's words are taken."""
    counts, blocks = [s["slots"] for s in sources], [s["blocks"] for s in sources]
    ends = [s["size"] - (s["blocks"] - 1) * BLOCK for s in sources]
    cuts = [s["cut"] for s in sources]
    n_shards = max(1, -(-sum(counts) // SHARD_SLOTS))

    def run(frames):
        for pdf in frames:
            for shard in pdf["id"]:
                have, before = shard_counts(int(shard), n_shards, counts, seed)
                for no in np.flatnonzero(have):
                    j = np.arange(before[no], before[no] + have[no], dtype=np.int64)
                    epoch = j // blocks[no]
                    block = np.empty_like(j)
                    for e in np.unique(epoch):
                        at = epoch == e
                        block[at] = permuted(j[at] % blocks[no], blocks[no], _key(seed, int(no), int(e)))
                    upto = np.where(block == blocks[no] - 1, ends[no], BLOCK) - np.where(j == counts[no] - 1, cuts[no], 0)
                    yield pd.DataFrame({"shard": np.int64(shard), "no": np.int32(no), "epoch": epoch.astype(np.int32), "block": block, "upto": upto.astype(np.int32)})

    return spark.range(0, n_shards, 1, min(n_shards, 4096)).mapInPandas(run, "shard long, no int, epoch int, block long, upto int")


def spans(placed: DataFrame) -> DataFrame:
    """The parts of each document that lie in one block: first and length count the document's own words, skip the block's before."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK).cast("long")
    first = F.floor(F.col("start") / BLOCK).cast("long")
    cut = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return cut.select("doc_id", "k1", "k2", "no", "size", "start", "block", (begin - F.col("start")).alias("first"), (end - begin).alias("length"), (begin - F.col("block") * BLOCK).alias("skip"))


def mixed(placed: DataFrame, sources: list[dict], seed: int = SEED) -> DataFrame:
    """The mix: a row for each slot and document in its block, with shard, epoch, first and length."""
    # the slots grow with the input, which Spark can't see from their few seed rows: never broadcast
    rows = spans(placed).join(slots(placed.sparkSession, sources, seed).hint("merge"), ["no", "block"]).filter("skip < upto")
    return rows.withColumn("length", F.least(F.col("length"), F.col("upto") - F.col("skip"))).drop("skip", "upto")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def excerpt(text: str, parts: list[tuple[int, int]]) -> str:
    """The words of parts (first, length) as they stand in text; parts that don't touch are joined by a line end."""
    at = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for first, length in sorted(parts):
        if runs and runs[-1][1] == first:
            runs[-1][1] = first + length
        else:
            runs.append([first, first + length])
    if runs == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as documents: for each document and epoch the words taken, with the document's other columns (n_chars, if
    there, counts the new text). Rows with equal doc_id and text are told apart by their place in the stream alone."""
    placed, sources = plan(docs, text=text, source=source, **how)
    rows = mixed(written(placed, "mix-placed"), sources, how.get("seed", SEED)).groupBy("k1", "k2", "start", "epoch")
    rows = rows.agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("length").cast("int").alias("length"))).alias("_parts"))
    rows = rows.select("k1", "k2", F.col("_parts").alias("parts")).hint("merge")
    names, at = docs.columns, docs.columns.index(text)
    d1, d2 = unused(names, "_d1", "_d2")
    texts = numbered(docs.withColumns({d1: id_key(docs), d2: text_hash(text)}))
    own, (d1, d2) = texts.columns[:-2], texts.columns[-2:]
    texts = texts.dropDuplicates([d1, d2])
    rows = texts.join(rows, (F.col(d1) == F.col("k1")) & (F.col(d2) == F.col("k2"))).select(*own, "parts")
    bounded(docs.sparkSession)

    def run(batches):
        for b in batches:
            cols = b.columns[:-1]
            parts = [[(p["first"], p["length"]) for p in x] for x in b.column(b.num_columns - 1).to_pylist()]
            new = [excerpt(t, p) for t, p in zip(cols[at].to_pylist(), parts)]
            cols[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=own)

    return with_n_chars(rows.mapInArrow(run, numbered(docs).schema).toDF(*names), text)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target, taken."""
    placed, sources = plan(table(spark, sf_dir, "documents"))
    placed = written(placed, "mix-placed")
    taken = mixed(placed, sources).groupBy(F.col("no").alias("_no"), F.col("start").alias("_start")).agg(F.sum("length").alias("_taken"))
    # words of a source's stream lie in one document each, so (source, start) names any document that has words
    on = (F.col("no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    rows = placed.join(taken, on, "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
