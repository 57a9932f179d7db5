"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

Rules decide first; the longest that fits wins. The URLs that rules decide are the
labelled ones: the trees learn from at most FIT_ROWS different ones (those with the
smallest hashed URLs, each verdict by its own half of the bound) and judge the rest.
Suffix statistics, the share of blocked URLs among labelled ones with the same last
host label, come from all labelled rows, smoothed; they are a table that is joined to
the URLs, and suffixes without labelled URLs have the overall share.

Defined cases: a null URL or one without "://" has an empty host and path, fits no
rule and is judged by the trees; without labelled rows of both verdicts the trees
allow all; rows repeat as they came; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import table, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FIT_ROWS = 20000
TREES, DEPTH, RATE, CUTS, RIDGE = 40, 3, 0.3, 32, 1.0
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "query_length", "fragment", "upper_ratio", "longest_run", "suffix_share")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile(r"[A-Za-z]+")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as written; else null. A rule is a host and a path from its first slash."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a later, longer one covers
        name, slash, rest = rule.partition("/")
        fits = (host == name) | F.endswith(host, F.lit("." + name))
        out = F.when(fits & F.startswith(path, F.lit(slash + rest)), F.lit(rule)).otherwise(out)
    return out


def lexical(url: str, host: str, path: str) -> list[float]:
    n = max(len(url), 1)
    query = url.partition("?")[2].partition("#")[0]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(map(url.count, "0123456789")) / n, sum(map(host.count, "0123456789")), host.count("-"),
        entropy, query.count("&") + bool(query), len(query), float("#" in url), sum(c.isupper() for c in url) / n, max(map(len, _RUN.findall(url)), default=0),
    ]


class BoostedTrees:
    """Binary logistic loss; each tree splits by quantile cuts, by the gain of Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.depth, self.trees, self.bias = depth, [], 0.0
        if len(np.unique(y)) < 2:
            self.bias = -1.0
            return
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        self.bias = math.log(y.mean() / (1 - y.mean()))
        f = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, y - p, p * (1 - p), np.zeros(len(y), np.int64))
            self.trees.append(tree)
            f += RATE * self._walk(tree, x)

    def _grow(self, bins, g, h, node):
        feature, cut = np.full((1 << self.depth) - 1, -1), np.zeros((1 << self.depth) - 1)
        for at in range((1 << self.depth) - 1):
            rows = np.flatnonzero(node == at)
            best, gain = None, 1e-6
            gt, ht = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(self.cuts):
                if len(c) and len(rows) > 1:
                    gl = np.cumsum(np.bincount(bins[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[rows, j], h[rows], len(c) + 1))[:-1]
                    gains = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                    k = int(gains.argmax())
                    if gains[k] > gain:
                        best, gain = (j, k), gains[k]
            if best:
                feature[at], cut[at] = best[0], self.cuts[best[0]][best[1]]
                node[rows] = 2 * at + 1 + (bins[rows, best[0]] > best[1])
            else:
                node[rows] = 2 * at + 1
        first = (1 << self.depth) - 1
        gs, hs = np.bincount(node - first, g, 1 << self.depth), np.bincount(node - first, h, 1 << self.depth)
        return feature, cut, gs / (hs + RIDGE)

    def _walk(self, tree, x):
        feature, cut, leaf = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (x[rows, f] > cut[at]))
        return leaf[at - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for tree in self.trees:
            f += RATE * self._walk(tree, x)
        return 1 / (1 + np.exp(-f))


def parsed(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    host, path = host_and_path(url)
    verdicts = {r: v for v, r in rules}
    rows = pages.select("page_id", F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for r, v in verdicts.items():
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    return rows.withColumn("_given", verdict)


def with_shares(rows: DataFrame) -> DataFrame:
    """rows (as of parsed()) with _share, the smoothed share of blocked URLs among the labelled ones of their suffix."""
    blocked = F.sum(F.when(F.col("_given") == "block", 1).otherwise(0))
    suffix = F.substring_index("host", ".", -1)
    per = written(rows.filter("_given is not null").groupBy(suffix.alias("_s")).agg(F.count(F.lit(1)).alias("_n"), blocked.alias("_b")), "url-suffixes")
    n, b = per.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    overall = (b + 1) / (n + 2)
    share = F.coalesce((F.col("_b") + 10 * overall) / (F.col("_n") + 10), F.lit(overall))
    return rows.join(per, suffix == F.col("_s"), "left").select(*rows.columns, share.alias("_share"))


def _features(b: pa.RecordBatch) -> np.ndarray:
    cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path", "_share"))
    return np.array([[*lexical(u, h, p), x] for u, h, p, x in zip(*cols)]).reshape(-1, len(FEATURES))


def fit(rows: DataFrame) -> BoostedTrees:
    """rows: as of with_shares()."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_features(b)), pa.list_(pa.float64()))], names=["x"])

    x, y = [], []
    for k, v in enumerate(("allow", "block")):
        some = rows.filter(F.col("_given") == v).select("url", "host", "path", "_share").distinct().orderBy(F.xxhash64("url"), "url").limit(FIT_ROWS // 2)
        found = some.mapInArrow(run, "x array<double>").collect()  # numbers, whatever the URLs' lengths
        x += [r.x for r in found]
        y += [float(k)] * len(found)
    return BoostedTrees(np.array(x).reshape(-1, len(FEATURES)), np.array(y))


def judged(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (the trees' probability of block) of every row."""
    rows = with_shares(written(parsed(pages, url, rules), "urls"))
    trees = fit(rows)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees.score(_features(b)))], names=[*b.schema.names, "block_score"])

    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("block_score", T.DoubleType())]))
    learned = F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_given", learned).alias("verdict"), "block_score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judged(table(spark, sf_dir, "pages"))
