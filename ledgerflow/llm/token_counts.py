"""Token counts: an exact histogram of encoded lengths and its suffix sums.

The texts are encoded once, by Arrow batches. Rows of one length then meet in a
map-side combined aggregate, so that the rest works on distinct lengths alone.
Prefix and suffix sums run in two levels (inside blocks of lengths, then over the
blocks), hence no task ever holds all lengths.

Nulls and empty texts have length 0. Repeated rows count each time. An empty
table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerflow.llm.common import table, text_bytes, written

#: Lengths in one block of the two-level sums.
BLOCK = 64
_encoders: dict[str, object] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encoded_lengths(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: the columns of ``keep`` and tokens (long)."""
    import public_tokenizers

    path, pattern = path or vocabulary(), pattern or public_tokenizers.PATTERN

    def run(batches):
        enc = _encoder(path, pattern)
        for b in batches:
            lengths = [len(enc.encode_ordinary(t.decode("utf-8", "replace"))) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lengths, pa.int64())], names=[*keep, "tokens"])

    rows = docs.select(*keep, text_bytes(text).alias("_text"))
    fields = [rows.schema[c] for c in keep]
    return rows.mapInArrow(run, _schema(fields))


def _schema(fields):
    from pyspark.sql import types as T

    return T.StructType([*fields, T.StructField("tokens", T.LongType())])


def histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, tokens, n_docs."""
    return lengths.groupBy(*by, "tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each length L as a context limit: documents and tokens at or below it, documents above it, the tokens left
    when every document is cut at L, all tokens, and the share of documents at or below L (the quantile that L is)."""
    keys = [F.col(c).eqNullSafe for c in by]
    blocks = hist.withColumn("_block", F.floor(F.col("tokens") / BLOCK)).groupBy(*by, "_block").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("tokens")).alias("_t"))
    over = W.partitionBy(*by).orderBy("_block")
    whole = W.partitionBy(*by)
    sums = blocks.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_block").alias("_b"),
        (F.sum("_d").over(over) - F.col("_d")).alias("_d0"),
        (F.sum("_t").over(over) - F.col("_t")).alias("_t0"),
        F.sum("_d").over(whole).alias("docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    on: Column = F.col("_block") == F.col("_b")
    for i, same in enumerate(keys):
        on = on & same(F.col(f"_by{i}"))
    within = W.partitionBy(*by, "_block").orderBy("tokens").rowsBetween(W.unboundedPreceding, 0)
    rows = hist.withColumn("_block", F.floor(F.col("tokens") / BLOCK))
    rows = rows.withColumn("_dw", F.sum("n_docs").over(within)).withColumn("_tw", F.sum(F.col("n_docs") * F.col("tokens")).over(within))
    docs_le, tokens_le = F.col("_d0") + F.col("_dw"), F.col("_t0") + F.col("_tw")
    return rows.join(sums, on).select(
        *by,
        "tokens",
        "n_docs",
        docs_le.alias("docs_le"),
        (F.col("docs") - docs_le).alias("docs_gt"),
        tokens_le.alias("tokens_le"),
        (tokens_le + F.col("tokens") * (F.col("docs") - docs_le)).alias("truncated_tokens"),
        "total_tokens",
        (docs_le / F.col("docs")).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """The totals for any one context limit, whether or not a document has that length."""
    over = F.col("tokens") > limit
    return hist.agg(
        F.lit(limit).cast("long").alias("context"),
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("tokens")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs")).otherwise(0)), F.lit(0)).alias("docs_gt"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("tokens"), F.lit(limit))), F.lit(0)).alias("truncated_tokens"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct encoded length of all documents as a context limit."""
    hist = histogram(encoded_lengths(table(spark, sf_dir, "documents")))
    return context_limits(written(hist, "lengths"))  # read twice
