"""Quality rules: plain statistics of a text, and an isolation forest over them.

The forest is fitted on at most FIT_ROWS labelled rows of good quality (those with the
smallest hashed ids; without labels, of all rows); as many bad ones only widen the
range of splits. Each tree isolates SUBSAMPLE rows by random splits; short paths mark
anomalies. The score's threshold comes from
all labelled rows: the one with the best (share of bad rows found - PRICE * share of
good rows lost) that loses at most MOST_LOST of the good rows. Without bad labelled
rows nothing is rejected by the forest.

Defined cases: a null or empty text has no words and fails the base rules; an id
that repeats in the labels has its lowest quality; rows repeat as they came; an
empty table gives no row; extra columns are ignored by the query and kept by filtered().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import bounded, encoded, numbered, split_all, starts_of, table, text_bytes, written

FIT_ROWS, TREES, SUBSAMPLE, SEED = 4096, 100, 256, 11
MARGIN, EXTRA_DEPTH = 0.3, 4
PRICE, MOST_LOST, BINS = 3.0, 0.01, 2000
MIN_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "dup_lines", "repeats", "upper", "digits", "marks", "word_length", "variety", "top_word", "line_length")
_SYMBOLS, _WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?.,:;"
_INNER = bytes(range(0x80, 0xC0))


def _without(t: bytes, drop: bytes) -> int:
    return len(t) - len(t.translate(None, drop))


def rule_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (a column for each of COUNTS) and features (FEATURES) of each text."""
    flat, counts = split_all(texts)
    codes, forms = encoded(flat)
    out, feats = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    wide = len(forms) >= 1 << 21
    for i, (t, a, n) in enumerate(zip(texts, starts_of(counts), counts)):
        c = codes[a : a + n]
        _, own, each = np.unique(c, return_inverse=True, return_counts=True) if n else (None, c, np.zeros(0, np.int64))
        if wide:
            c = own
        repeated = 0
        if n >= 3:
            if len(each) < 1 << 21:
                key = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
            else:  # three numbers don't fit in 63 bits: neighbours get a number first
                _, pair = np.unique((c[:-1] << 32) | c[1:], return_inverse=True)
                key = (pair[:-1] << 32) | c[2:]
            order = np.argsort(key, kind="stable")
            s = key[order]
            same = s[1:] == s[:-1]
            if same.any():
                again = np.zeros(len(s), bool)
                again[1:] |= same
                again[:-1] |= same
                at, covered = order[again], np.zeros(n, bool)
                covered[at] = covered[at + 1] = covered[at + 2] = True
                repeated = int(covered.sum())
        seen, dup, lines = set(), 0, 0
        for line in t.split(b"\n"):
            if line.strip(_WHITE):
                lines += 1
                if line in seen:
                    dup += 1
                seen.add(line)
        white = _without(t, _WHITE)
        chars = len(t) - white - _without(t, _INNER)
        symbols = _without(t, _SYMBOLS)
        out[i] = n, chars, symbols, dup, repeated
        if n:
            per = 1.0 / chars
            feats[i] = (
                symbols * per, dup / max(lines, 1), repeated / n, _without(t, _UPPER) * per, _without(t, _DIGITS) * per,
                _without(t, _MARKS) / n, min(chars / n, 50.0), math.log(1 + len(each)) / math.log(1 + n), each.max() / n, math.log(n / max(lines, 1)),
            )
    return out, feats


class IsolationForest:
    """Trees as arrays; fitted from a seed, hence the same for the same rows.

    Splits are drawn over a node's range widened by MARGIN of the feature's whole range (that of ``scale``), so that
    values which the fitted rows don't have fall into empty leaves early."""

    def __init__(self, x: np.ndarray, scale: np.ndarray | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2)))) + EXTRA_DEPTH
        self.wide = np.ptp(x, axis=0) if scale is None and len(x) else scale
        self.trees = [self._grow(x[rng.permutation(len(x))[: self.size]], rng) for _ in range(trees)] if len(x) else []

    @staticmethod
    def _expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, child, path = [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), child.append(at), path.append(depth + self._expected(len(rows)))
            spread = np.flatnonzero(self.wide > 0) if len(rows) > 1 and depth < self.depth else []
            if len(spread):
                f = int(rng.choice(spread))
                more = MARGIN * self.wide[f]
                feature[at], cut[at] = f, float(rng.uniform(rows[:, f].min() - more, rows[:, f].max() + more))
                below = rows[:, f] <= cut[at]
                left = node(rows[below], depth + 1)
                right = node(rows[~below], depth + 1)
                child[at] = (left, right)
            return at

        node(x, 0)
        pairs = np.array([(c, c) if isinstance(c, int) else c for c in child], np.int64)
        return np.array(feature), np.array(cut), pairs[:, 0], pairs[:, 1], np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near 1: isolated early; near 0.5 and below: like the rest."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = np.where(x[rows, f] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self._expected(self.size), 1e-9))


def _base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts, features (array) and base_failed of every row."""

    def run(batches):
        for b in batches:
            counts, feats = rule_statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[:, j]) for j in range(len(COUNTS))], pa.array(list(feats), pa.list_(pa.float64())), pa.array(_base_failed(counts))],
                names=["doc_id", *COUNTS, "features", "base_failed"],
            )

    rows = docs.select("doc_id", text_bytes(text).alias("_text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("base_failed", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """stats with the column anomaly."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("features")
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], names=[*b.schema.names, "anomaly"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def fit(stats: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float]:
    """The forest, and the score above which a document is rejected."""
    quality = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    known = written(stats.join(quality, F.col("doc_id") == F.col("_id")).filter(~F.col("base_failed")).select("doc_id", "features", "_quality"), "quality-known")
    order = [F.xxhash64("doc_id"), F.col("features")]
    good, bad = (known.filter(which).select("doc_id", "features").orderBy(*order).limit(FIT_ROWS).collect() for which in ("_quality > 0", "_quality <= 0"))
    good = good or stats.filter(~F.col("base_failed")).select("doc_id", "features").orderBy(*order).limit(FIT_ROWS).collect()
    x, other = (np.array([r.features for r in rows]).reshape(-1, len(FEATURES)) for rows in (good, bad))
    both = np.concatenate([x, other])
    forest = IsolationForest(x, np.ptp(both, axis=0) if len(both) else None)
    bins = scored(known, forest).groupBy(F.floor(F.col("anomaly") * BINS).alias("b"), (F.col("_quality") > 0).alias("good")).count().collect()
    return forest, threshold([(r.b, r.good, r["count"]) for r in bins])


def threshold(bins: list[tuple[int, bool, int]]) -> float:
    """From the counts of good and bad rows in bins of the score; infinite where no threshold is worth its price."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, is_good, n in bins:
        (good if is_good else bad)[min(b, BINS)] += n
    lost = np.cumsum(good[::-1])[::-1] / max(good.sum(), 1)
    found = np.cumsum(bad[::-1])[::-1] / max(bad.sum(), 1)
    worth = np.where(lost <= MOST_LOST, found - PRICE * lost, -1)
    best = int(worth.argmax())
    return best / BINS if worth[best] > 0 else math.inf


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly and kept of every row."""
    stats = written(statistics(docs), "quality-stats")
    forest, most = fit(stats, labels)
    kept = ~F.col("base_failed") & (F.col("anomaly") < F.lit(most))
    return scored(stats, forest).select("doc_id", *COUNTS, "base_failed", "anomaly", kept.alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The kept rows of docs, with all their columns. Texts are judged where they are read: they are not shuffled."""
    forest, most = fit(written(statistics(docs, text), "quality-stats"), labels)
    at = docs.columns.index(text)
    bounded(docs.sparkSession)

    def run(batches):
        for b in batches:
            counts, feats = rule_statistics([t or b"" for t in b.column(at).cast(pa.large_binary()).to_pylist()])
            yield b.filter(pa.array(~_base_failed(counts) & (forest.score(feats) < most)))

    return numbered(docs).mapInArrow(run, numbered(docs).schema).toDF(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule statistics and the verdict on every document."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
