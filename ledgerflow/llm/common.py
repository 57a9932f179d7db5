"""Shared plumbing: session folders, tables written to cut lineage, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these six ASCII characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"

#: Bounds what a Python worker holds of long texts at once.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own. A session that names none gets
    a temporary one if it runs in one process (tests); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerflow-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's name in the shared one; what is written there goes when the process ends, or with scratch()."""
    path = f"{shared_dir(spark)}/lf-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on: Spark hands no column to Python whose name has a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column has."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def bounded(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of BATCH_BYTES at most, unless it has a bound of its own.
    Operators whose result is a plan that reads texts call this: they don't know when the plan runs."""
    if spark.conf.get(BATCH_BYTES[0]).rstrip("b") == str(64 << 20):
        spark.conf.set(*BATCH_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and an executor's loss costs no more than a task."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(BATCH_BYTES[0])
    spark.conf.set(*BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES[0], before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _drop(entries: list[tuple[SparkSession, str]]) -> None:
    for spark, path in entries:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S112  the session is gone, and its folder with it; others may not be
            continue


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that are put into the list it gives: whatever is read later
    must come from these alone."""
    start, kept = len(_written), []
    yield kept
    stay = {df._written_at for df in kept}
    gone = [entry for entry in _written[start:] if entry[1] not in stay]
    _drop(gone)
    for entry in gone:
        _written.remove(entry)


@atexit.register
def _drop_written() -> None:
    _drop(_written)


def text_bytes(c: str = "text") -> Column:
    """The text in UTF-8, null as empty."""
    return F.coalesce(F.col(c).cast("binary"), F.lit(b""))


def text_hash(c: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(c), F.lit("")))


def id_key(docs: DataFrame, c: str = "doc_id") -> Column:
    """The id as a long; a null id sorts before all others. Ids that aren't whole numbers are refused."""
    kind = docs.schema[c].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{c} has the type {kind.simpleString()}; ids are whole numbers")
    return F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))


def with_n_chars(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_chars, where it has that column, as its texts have them now."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))


def n_words(c: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit(WORD)).cast("long")


def split_all(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts in a row, and how many each text has."""
    flat: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        counts[i] = len(w)
        flat += w
    return flat, counts


def encoded(flat: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Number of each word's form, and the distinct forms."""
    if not flat:
        return np.empty(0, np.int64), []
    d = pa.array(flat, pa.large_binary()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.empty(0, np.int64)
