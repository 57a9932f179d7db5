"""Near copies beyond the fingerprint's radius, for stages that drop documents.

Texts with four fifths of their distinct five-word shingles in common are linked, all of them, by an exact prefix
filter with positions. Shingles have one order for all texts, rare ones first; of a text with n shingles the first
n - ceil(0.8 n) + 1 are its keys. The first shingle that two similar texts share, in that order, is a key of both, and
what follows it bounds what they share: with n - i shingles from it on, a text can only be similar to texts of at most
(9 (n - i) - 4 n) / 4 shingles. So texts that merely share a common passage meet under its shingles, but are no pair:
their own, rarer shingles come first. The order only decides how many meet under a key, not what is found.

1. Texts whose least shingle (under one of MINIMA hash functions) is the same are compared, each with LAGS others of other
groups, TURNS times over; what is verified makes groups. After the first turn, which is drawn, the others are those with the
most links so far. So a large group of copies costs a few pairs a text, even if most of its texts are less than similar to
each other and linked by way of others: these others have the most links.
2. Texts of different groups that share a key and may be similar by the bound are paired. A pair is dropped early only if
parities of hashed shingles, a lower bound of how many differ, rule it out: where a key is known to be frequent as the pair
is made, else before the shingles are fetched. The rest is verified on all shingles (as 40-bit hashes).

Of the two texts of a pair the smaller one's bound reaches its own size (a strong row); a task holds strong rows alone, the
others stream by. A key that the sample shows to be very frequent is dealt over cells: each strong row goes to one, the
others to all, so a cell has about CELL_ROWS strong rows, whatever a key has. No pair, key or candidate is left out.

Defined cases: a null text is an empty one; texts under five words have no shingle and no link here; repeated texts count
once; an empty table gives no link. Only the text's column is read, so extra columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerflow.llm.common import text_bytes, text_hash, written
from ledgerflow.llm.components import components
from ledgerflow.llm.substrings import _P1, _chunks, _Words

SHINGLE, BITS, MINIMA = 5, 40, 4
#: One text in SAMPLE is looked at for frequent shingles, of which HOT at most are ordered by frequency.
SAMPLE, HOT, HOT_LEAST = 8, 1 << 19, 3
MOST_PARITIES = 1 << 15
CELL_ROWS = 1 << 20
#: In the first step, texts that each is compared with, how often, and how many stand in one order.
LAGS, TURNS, CELL_TEXTS = 3, 3, 1024
#: Places compared at once, and pairs of a task that are made distinct before they move.
COMPARED, HELD = 1 << 21, 1 << 20
#: Rows of frequent keys carry parities of FOLD buckets; so many pairs' parities are compared at once.
FOLD, FOLDED = 512, 1 << 16
_ODDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _parities(own: np.ndarray) -> bytes:
    """A bit for each bucket: whether an odd number of shingles falls into it."""
    size = min(max(64, 1 << len(own).bit_length()), MOST_PARITIES)
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At most so many shingles as differ between two sets."""
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)), axis=0)
    return int.from_bytes((folded ^ np.frombuffer(x, np.uint8)).tobytes(), "little").bit_count()


def _folded(own: np.ndarray) -> bytes:
    """Parities of FOLD buckets, whatever the set's size."""
    return np.packbits(np.bincount((own & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1, bitorder="little").tobytes()


def _unpacked(parities: pa.Array) -> np.ndarray:
    """FOLD bits a row, none set where there are no parities."""
    out = np.zeros((len(parities), FOLD // 64), np.uint64)
    raw = b"".join(parities.drop_null().to_pylist())
    out[parities.is_valid().to_numpy(zero_copy_only=False)] = np.frombuffer(raw, np.uint64).reshape(-1, FOLD // 64)
    return out


def _closed(own: np.ndarray) -> bytes:
    """A sorted set of BITS-bit numbers, five bytes each."""
    return (own >> np.uint64(8)).astype(np.uint32).tobytes() + own.astype(np.uint8).tobytes()


def _opened(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(raw, np.uint8, n, 4 * n)


def _sets(rolled: np.ndarray, doc: np.ndarray, left: np.ndarray, n: int) -> tuple[list[np.ndarray], pa.Array]:
    """Each document's distinct shingles, sorted, and the least of them under each of MINIMA functions. A chunk has fewer than
    2^(64 - BITS) documents with a shingle, so that one sort does for all of them."""
    at = np.flatnonzero(left[: len(rolled)] >= SHINGLE)
    owners, own = np.unique(doc[at], return_inverse=True)
    both = np.sort(own.astype(np.uint64) << np.uint64(BITS) | rolled[at] >> np.uint64(64 - BITS))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    owner, h = both >> np.uint64(BITS), both & np.uint64((1 << BITS) - 1)
    cuts = np.searchsorted(owner, np.arange(len(owners) + 1).astype(np.uint64))
    sets = [h[:0]] * n
    for i, a, c in zip(owners.tolist(), cuts, cuts[1:]):
        sets[i] = h[a:c]
    least = np.stack([np.minimum.reduceat(h * odd, cuts[:-1]) for odd in _ODDS[:MINIMA]], 1) if len(h) else np.empty((0, MINIMA), np.uint64)
    ends = np.zeros(n + 1, np.int32)
    ends[1:][owners] = MINIMA
    return sets, pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(least.ravel().view(np.int64)))


def _sketch(fingerprint):
    def run(batches):
        seen: set[int] = set()
        for k2, texts in _chunks(batches, 1):
            new = []
            for i, t in enumerate(k2.to_pylist()):
                if t not in seen:
                    seen.add(t)
                    new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            lower = [texts[i].lower() for i in new]
            w = _Words(lower)
            sets, least = _sets(w.rolled(SHINGLE, _P1), w.doc, w.left, len(lower))
            fp = np.array([fingerprint(t) for t in lower], np.uint64).view(np.int64)
            cols = [k2.take(pa.array(new, pa.int64())), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), least]
            cols += [pa.array([_parities(s) for s in sets], pa.binary()), pa.array([_closed(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["t", "fp", "size", "least", "parities", "shingles"])

    return run


def _counted(batches):
    """(shingles) -> key, n: what occurs more than once is counted here."""
    for b in batches:
        all_of = [_opened(s) for s in b.column(0).to_pylist()]
        if all_of:
            key, n = np.unique(np.concatenate(all_of), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def _keys(shared):
    """(t, size, shingles, root) -> place, t, size, most, root, folded: a row for each key of a text (and cell of the key). place:
    cell, key, and whether the row isn't strong. most: the size up to which the text's partners under the key can go. folded: the
    text's parities if the key is frequent, else null."""

    def run(batches):
        hot, level, cells = shared.value
        for b in batches:
            sets = [_opened(s) for s in b.column(2).to_pylist()]
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            if not len(flat):
                continue
            if len(hot):
                at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
                flat = flat | np.where(hot[at] == flat, level[at], np.uint64(0)) << np.uint64(BITS)
            firsts, start = [], 0
            for s in sets:
                n = len(s)
                own, first = flat[start : start + n], n - (4 * n + 4) // 5 + 1 if n else 0
                firsts.append(np.sort(np.partition(own, first - 1)[:first] if 0 < first < n else own))
                start += n
            counts = np.array([len(x) for x in firsts])
            row, key = np.repeat(np.arange(len(sets)), counts), np.concatenate(firsts) & np.uint64((1 << BITS) - 1)
            size = np.array([len(s) for s in sets])[row]
            i = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            most = (9 * (size - i) - 4 * size) // 4
            weak, cell, frequent = most < size, np.zeros(len(row), np.int64), np.zeros(len(row), bool)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                frequent = hot[at] == key
                times = np.where(frequent, cells[at], 1)
                own_cell = b.column(0).to_numpy().view(np.uint64)[row] % times.astype(np.uint64)
                each = np.repeat(np.arange(len(row)), times)
                cell = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                weak = weak[each] | (cell != own_cell[each].astype(np.int64))
                row, key, size, most, frequent = row[each], key[each], size[each], most[each], frequent[each]
            folded = [None] * len(sets)
            for j in np.unique(row[frequent]).tolist():
                folded[j] = _folded(sets[j])
            place = (cell << (BITS + 1)) | (key.astype(np.int64) << 1) | weak
            rows = pa.array(row)
            folded = pa.array(folded, pa.binary()).take(pa.array(row, mask=~frequent))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), b.column(0).take(rows), pa.array(size.astype(np.int32)), pa.array(most.astype(np.int32)), b.column(3).take(rows), folded],
                names=["place", "t", "size", "most", "root", "folded"],
            )

    return run


def _met(s: list[np.ndarray], r: list[np.ndarray]):
    """(group, t, size, most, root, parities) of strong rows and of all rows of the same groups -> pairs of texts (n x 2) that may be
    similar: those of one group and different roots, the strong one not larger, that the parities don't rule out."""
    k = len(s[0])
    group, root = np.concatenate([s[0], r[0]]), np.concatenate([s[4], r[4]])
    order = np.lexsort((root, group))
    new_group = np.append(True, np.diff(group[order]) != 0)[: len(order)]
    new = new_group | np.append(True, np.diff(root[order]) != 0)[: len(order)]
    gid, pid = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    gid[order], pid[order] = np.cumsum(new_group) - 1, np.cumsum(new) - 1
    several = np.bincount(gid[order][new]) > 1  # groups with more than one root
    strong = np.flatnonzero(several[gid[:k]])
    by_root = order[order >= k] - k
    by_root = by_root[several[gid[k:][by_root]]]
    if not len(strong) or not len(by_root):
        return
    r_gid, r_pid = gid[k:][by_root], pid[k:][by_root]
    lo, hi = (np.searchsorted(r_gid, gid[strong], side) for side in ("left", "right"))
    own, past = (np.searchsorted(r_pid, pid[strong], side) for side in ("left", "right"))
    count = hi - lo - (past - own)
    ends = np.cumsum(count)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(COMPARED, ends[-1], COMPARED)) + 1, [len(count)]]))
    for a, c in zip(cuts, cuts[1:]):
        which = np.repeat(np.arange(a, c), count[a:c])
        at = lo[which] + np.arange(len(which)) - np.repeat(ends[a:c] - count[a:c] - (ends[a - 1] if a else 0), count[a:c])
        at += np.where(at >= own[which], (past - own)[which], 0)
        x, y = strong[which], by_root[at]
        n, m = s[2][x], r[2][y]
        ok = (n <= m) & (m <= s[3][x]) & (n <= r[3][y])
        x, y = x[ok], y[ok]
        for i in range(0, len(x), FOLDED):
            p, q = x[i : i + FOLDED], y[i : i + FOLDED]
            apart = np.bitwise_count(s[5][p] ^ r[5][q]).sum(1, dtype=np.int64)
            near = 9 * apart <= s[2][p].astype(np.int64) + r[2][q]
            t, u = s[1][p[near]], r[1][q[near]]
            yield np.stack([np.maximum(t, u), np.minimum(t, u)], 1)


def _across(batches):
    """Rows of _keys(), sorted by place within groups -> (t, r): pairs that share a key."""
    held, pairs, n_pairs = None, [], 0

    def out():
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["t", "r"])

    for b in batches:
        place, *rest = (c.to_numpy() for c in b.columns[:5])
        if not len(place):
            continue
        rows = [place >> 1, *rest, _unpacked(b.column(5))]
        strong = [c[place & 1 == 0] for c in rows]
        before = held if held is not None and held[0][0] == rows[0][0] else [c[:0] for c in rows]
        for part in (*_met([np.concatenate(c) for c in zip(before, strong)], rows), *_met(strong, before)):
            pairs.append(part)
            n_pairs += len(part)
            if n_pairs > HELD:
                yield out()
                pairs, n_pairs = [], 0
        last = rows[0][-1]
        kept = [c[strong[0] == last] for c in strong]
        if len(before[0]) and before[0][0] == last:
            kept = [np.concatenate(c) for c in zip(before, kept)]
        held = kept if len(kept[0]) else None
    yield out()


def _possible(batches):
    """(t, r, sizes, parities) -> (t, r) of pairs that sizes and parities don't rule out."""
    for b in batches:
        t, r, n, m, x, y = (c.to_pylist() for c in b.columns)
        keep = [5 * min(i, j) >= 4 * max(i, j) and 9 * _apart(p, q) <= i + j for i, j, p, q in zip(n, m, x, y)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["t", "r"])


def _verified(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = _opened(x), _opened(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["u", "v"])


def sketches(docs: DataFrame, fingerprint, text: str = "text") -> DataFrame:
    """t (the text's hash), fp, size, least, parities, shingles of the texts, as a written table; a task's repeated texts once."""
    rows = docs.select(text_hash(text).alias("t"), text_bytes(text).alias("_text"))
    return written(rows.mapInArrow(_sketch(fingerprint), "t long, fp long, size int, least array<long>, parities binary, shingles binary"), "near-sketches")


def _links(sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v: those of the pairs (t, r) that are similar."""
    texts = sketched.select("t", "size", "parities").dropDuplicates(["t"])
    others = texts.select(F.col("t").alias("r"), F.col("size").alias("m"), F.col("parities").alias("y"))
    both = pairs.join(texts, "t").join(others, "r").select("t", "r", "size", "m", "parities", "y")
    pairs = written(both.mapInArrow(_possible, "t long, r long"), "near-pairs")
    # written, so that Spark knows its size and, if it is small, leaves the shingles where they are
    suspects = written(pairs.select("t").union(pairs.select("r")).distinct(), "near-suspects")
    sets = written(sketched.select("t", "shingles").join(suspects, "t").dropDuplicates(["t"]), "near-sets")
    both = pairs.join(sets.withColumnRenamed("shingles", "x"), "t").join(sets.select(F.col("t").alias("r"), F.col("shingles").alias("y")), "r")
    return written(both.select("t", "r", "x", "y").mapInArrow(_verified, "u long, v long"), "near-links")


def _frequent(sketched: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles of the sample, sorted, how frequent they are (in doublings), and how many cells they are dealt over."""
    some = sketched.filter(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).dropDuplicates(["t"]).select("shingles")
    n = some.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST)
    got = n.orderBy(F.desc("n"), "key").limit(HOT).toArrow()
    key, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], (1 + np.log2(n[order])).astype(np.uint64), 1 + n[order] * SAMPLE // CELL_ROWS


def _least_shared(sketched: DataFrame) -> DataFrame:
    """t, k, n: each text's least shingles that n > 1 texts of about its size have as well. Sizes are banded in two ways, by turns
    of the hash functions, so that texts of nearly one size share a band."""
    band = F.floor(F.log(F.col("size")) / F.lit(math.log(1.25)) + (F.col("i") % 2) / 2)
    rows = sketched.filter("size > 0").select("t", "size", F.posexplode("least").alias("i", "m"))
    rows = rows.select("t", F.xxhash64("i", "m", band).alias("k")).distinct()
    n = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the join's key isn't the aggregate's: both sides are exchanged, and Spark can split a key that many texts have
    n = n.select(F.col("k").bitwiseXOR(F.lit(1)).alias("x"), "n")
    return written(rows.withColumn("x", F.col("k").bitwiseXOR(F.lit(1))).join(n, "x").select("t", "k", "n"), "near-least")


def _known(links: DataFrame) -> DataFrame:
    """u, root, degree: the group and the number of links of each text that has one."""
    ends = links.select("u").union(links.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    return written(ends.join(components(links), "u", "left").select("u", F.coalesce("v", "u").alias("root"), "degree"), "near-known")


def _neighbours(least: DataFrame, known: DataFrame | None, turn: int) -> DataFrame:
    """t, r: texts of different groups that share a least shingle. A shingle's texts are dealt over cells of about CELL_TEXTS,
    anew each turn. At first each text is compared with the next LAGS in a drawn order; then with those of its cell that have the
    most links so far, in each turn with the next LAGS of these."""
    rows = least if known is None else least.join(known, F.col("t") == F.col("u"), "left")
    root, degree = (F.col("t"), F.lit(0)) if known is None else (F.coalesce("root", "t"), F.coalesce("degree", F.lit(0)))
    cell = F.pmod(F.xxhash64("t", "k", F.lit(turn)), 1 + F.floor(F.col("n") / CELL_TEXTS))
    place = F.xxhash64("k", F.lit(turn), "t")
    rows = rows.select("t", root.alias("root"), degree.alias("degree"), F.xxhash64("k", cell).alias("cell"), place.alias("place"))
    order = W.partitionBy("cell").orderBy(F.desc("degree"), "place")
    if turn:
        whole, before = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), (turn - 1) * LAGS
        at = lambda c, j: F.nth_value(c, before + j).over(whole)
    else:
        at = lambda c, j: F.lead(c, j).over(order)
    others = F.array(*[F.struct(at("t", j).alias("r"), at("root", j).alias("other")) for j in range(1, LAGS + 1)])
    rows = rows.select("t", "root", others.alias("others")).select("t", "root", F.explode("others").alias("a")).filter("a.r is not null and a.other <> root")
    return rows.select(F.greatest("t", "a.r").alias("t"), F.least("t", "a.r").alias("r")).distinct()


def near_links(sketched: DataFrame) -> DataFrame:
    """u, v: links whose components are those of all texts with four fifths of their shingles in common."""
    shared = sketched.sparkSession.sparkContext.broadcast(_frequent(sketched))
    least, first, known = _least_shared(sketched), None, None
    for turn in range(TURNS):
        found = _links(sketched, _neighbours(least, known, turn))
        first = found if first is None else first.union(found)
        known = _known(first)
    # a text that several tasks have sketched has one root in all its rows, so these make no pairs
    texts = sketched.select("t", "size", "shingles").join(known, F.col("t") == F.col("u"), "left")
    texts = texts.select("t", "size", "shingles", F.coalesce("root", "t").alias("root"))
    rows = texts.mapInArrow(_keys(shared), "place long, t long, size int, most int, root long, folded binary")
    rows = rows.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")
    pairs = written(rows.mapInArrow(_across, "t long, r long").distinct(), "near-across")
    shared.destroy()  # else it stays with the driver until that happens to collect its garbage
    return first.union(_links(sketched, pairs))
