"""SentencePiece encoding and decoding over a relational lattice.

A text is cut where no piece can span: before a run of word marks, and around line ends
and tabs. What is left, its units, are encoded each on its own. Frequent units (at least
N / HEAD of all N, so at most HEAD of them) make the lattice: their substrings of at most the longest piece's length are exploded, joined
to the piece table, and the edges grouped by unit. A higher-order aggregate folds each
unit's edges: for unigram models it is the Viterbi recursion; for BPE models, whose
ids the best path does not give, each step takes the merge that the model scores
highest, on a bit mask of the cuts that are left. Units that are rare, or longer than a
mask, are folded in place by the same rule: to join them back would shuffle the texts.

Only the space is normalised (to the word mark, with one before the text), as in models with
the identity normaliser; other models are refused. Characters without a piece become bytes.

Defined cases: null and empty texts have no ids; word marks (U+2581) in a text decode to
spaces, round_trip is then false; rows repeat as they came; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import bounded, table, text_bytes, written
from ledgerflow.llm.token_counts import vocabulary

MARK = "▁"
HEAD, MASK_CHARS, CHUNK_BYTES, REMEMBER = 1 << 22, 60, 2_000_000, 20_000
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("only models with the identity normaliser and a word mark before the text are read")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in m.pieces):
            raise ValueError("pieces defined by users aren't supported")
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.longest = max(map(len, self.pieces))
        inside = {c for p in self.pieces for c in p}
        apart = "".join(c for c in "\n\r\t" if c not in inside)
        self.unit = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + f"|[{apart}]+" * bool(apart))
        if any(p.lstrip(MARK).find(MARK) >= 0 for p in self.pieces):
            raise ValueError("a piece has a word mark after other characters")
        self.out = [b""] * len(m.pieces)
        for p, (i, _) in self.pieces.items():
            self.out[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.out[self.unknown] = " ⁇ ".encode()
        self.lowest = min((s for _, s in self.pieces.values()), default=0.0)
        self._known: dict[str, list[int]] = {}

    def units(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if p in self.pieces:
                out.append(self.pieces[p][0])
            else:
                out += [self.bytes[b] for b in p.encode()] if self.bytes else [self.unknown]
        return out

    def fold(self, unit: str) -> list[int]:
        """The unit's ids, by the rule of the relational fold."""
        if (ids := self._known.get(unit)) is None:
            if len(self._known) >= REMEMBER:
                self._known.clear()
            ids = self._known[unit] = self.ids_of((self._merged if self.bpe else self._best)(unit))
        return ids

    def _merged(self, unit: str) -> list[str]:
        get = self.pieces.get
        if get(unit) and len(unit) == 1:
            return [unit]
        if len(unit) <= 48:
            parts, low = list(unit), -1e30
            score = [p[1] if (p := get(a + b)) else low for a, b in zip(parts, parts[1:])]
            while score and (best := max(score)) > low:
                i = score.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del score[i]
                if i < len(score):
                    score[i] = p[1] if (p := get(parts[i] + parts[i + 1])) else low
                if i:
                    score[i - 1] = p[1] if (p := get(parts[i - 1] + parts[i])) else low
            return parts
        parts, after, before = list(unit), [*range(1, len(unit)), -1], [-1, *range(len(unit) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (p := get(both := parts[i] + parts[after[i]])):
                heapq.heappush(heap, (-p[1], i, both))

        for i in range(len(unit)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i]), offer(i)
        return [p for p in parts if p]

    def _best(self, unit: str) -> list[str]:
        n = len(unit)
        score, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                p = self.pieces.get(unit[s:e])
                own = p[1] if p else self.lowest - UNKNOWN_PENALTY if e - s == 1 else None
                if own is not None and score[s] + own > score[e]:
                    score[e], back[e] = score[s] + own, s
        out, e = [], n
        while e:
            out.append(unit[back[e] : e])
            e = back[e]
        return out[::-1]


_loaded: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _texts(batches, at: int):
    """Batches cut at about CHUNK_BYTES of text, with their texts."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(at)).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1], CHUNK_BYTES)) + 1 if len(ends) else []
        for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
            if y > x:
                part = b.slice(x, y - x)
                yield part, [t.decode("utf-8", "replace") for t in part.column(at).to_pylist()]


def unit_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """unit, n: how often each unit occurs in all texts."""

    def run(batches):
        p = pieces_at(path)
        for _, texts in _texts(batches, 0):
            units: Counter[str] = Counter()
            for t in texts:
                units.update(p.units(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())], names=["unit", "n"])

    return docs.select(text_bytes(text).alias("_text")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, path: str) -> DataFrame:
    """unit, edges: the pieces that each unit has, with their places as bit masks. Pieces are as many as the model has."""
    p = pieces_at(path)
    spark = units.sparkSession
    rows = [(k, i, float(s)) for k, (i, s) in p.pieces.items()]
    known = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double"))
    n = F.length("unit")
    cut = units.select("unit").withColumn("s", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = cut.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.longest), n - F.col("s")))))
    cut = cut.select("unit", "s", (F.col("s") + F.col("l")).alias("e"), F.substring("unit", F.col("s") + 1, F.col("l")).alias("piece"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    edge = F.struct("score", (-F.col("s")).alias("before"), (bit(F.col("e")) - 2 * bit(F.col("s"))).alias("inner"), (bit(F.col("s")) + bit(F.col("e"))).alias("ends"), "s", "e", "id")
    return cut.join(known, "piece", "left").groupBy("unit").agg(F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges"))


def merge_fold(edges: Column, n: Column) -> Column:
    """The cuts that are left after all merges, as a bit mask. An edge is a merge if its ends are cuts and one cut lies inside."""
    cuts = F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1

    def step(b, _):
        fits = F.filter(edges, lambda x: (b.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(b.bitwiseAND(x["inner"])) == 1))
        return b.bitwiseAND(F.bitwise_not(F.coalesce(F.array_max(fits)["inner"], F.lit(0).cast("long"))))

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), cuts, step)).otherwise(cuts)


def viterbi_fold(edges: Column, n: Column, unknown: float) -> Column:
    """The cuts of the path with the highest sum of scores, as a bit mask."""

    def forward(best, i):
        ways = F.transform(F.filter(edges, lambda x: x["e"] == i), lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("back")))
        alone = F.struct((F.get(best, i - 1)["score"] + F.lit(unknown)).alias("score"), (1 - i).alias("back"))
        bare = ~F.exists(edges, lambda x: (x["e"] == i) & (x["s"] == i - 1))
        return F.concat(best, F.array(F.array_max(F.when(bare, F.concat(ways, F.array(alone))).otherwise(ways))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))
    best = F.aggregate(F.sequence(F.lit(1), n), start, forward)

    def backward(acc, _):
        at = -F.get(acc["best"], acc["at"])["back"]
        return F.struct(acc["best"].alias("best"), at.alias("at"), acc["cuts"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias("cuts"))

    end = F.struct(best.alias("best"), n.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), n).alias("cuts"))
    return F.aggregate(F.sequence(F.lit(1), n), end, backward)["cuts"]


def folded(lattices: DataFrame, path: str) -> DataFrame:
    """unit, ids."""
    p = pieces_at(path)
    n, edges = F.length("unit"), F.col("edges")
    cuts = merge_fold(edges, n) if p.bpe else viterbi_fold(edges, n, p.lowest - UNKNOWN_PENALTY)
    rows = lattices.select("unit", "edges", F.explode(F.array(cuts)).alias("cuts"))  # a barrier: else the fold runs for each place
    places = F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("getbit", F.col("cuts"), i) == 1)
    rows = rows.select("unit", "edges", places.alias("at"))
    if p.bytes:
        first = p.bytes[0]
        if [p.bytes.get(b) for b in range(256)] != list(range(first, first + 256)):
            raise ValueError("the model's byte pieces aren't in a row")
        byte_ids = lambda part: F.transform(F.regexp_extract_all(F.hex(F.encode(part, "UTF-8")), F.lit("(..)")), lambda h: (F.conv(h, 16, 10).cast("int") + first))
    else:
        byte_ids = lambda part: F.array(F.lit(p.unknown))

    def ids(i):
        s, e = F.get(F.col("at"), i), F.get(F.col("at"), i + 1)
        own = F.filter(F.col("edges"), lambda x: (x["s"] == s) & (x["e"] == e))
        return F.when(F.size(own) > 0, F.array(F.get(own, F.lit(0))["id"])).otherwise(byte_ids(F.substring("unit", s + 1, e - s)))

    return rows.select("unit", F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - 2), ids)).alias("ids"))


def frequent(docs: DataFrame, path: str, text: str = "text") -> pa.Table:
    """unit and ids of the frequent units, of the lattice."""
    counts = written(unit_counts(docs, path, text), "pieces-units")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter((F.col("n") * HEAD >= total) & (F.length("unit") <= MASK_CHARS))
    # spread by number, which Spark doesn't coalesce: the lattice has some fifty rows for each unit
    often = often.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    return folded(lattice(often, path), path).toArrow()


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, and round_trip: whether the ids decode to the text."""
    path = path or vocabulary("piece_bpe_32k.model")
    spark = docs.sparkSession
    bounded(spark)
    shared = spark.sparkContext.broadcast(frequent(docs, path, text).combine_chunks())

    def run(batches):
        p, often = pieces_at(path), shared.value
        known = often.column("unit").combine_chunks().cast(pa.string())
        known_ids = often.column("ids").combine_chunks()
        known_at, known_flat = known_ids.offsets.to_numpy(), known_ids.values.to_numpy()
        for b, texts in _texts(batches, 1):
            code: dict[str, int] = {}
            flat, counts = [], np.empty(len(texts), np.int64)
            for i, t in enumerate(texts):
                u = p.units(t)
                counts[i] = len(u)
                flat += [code.setdefault(x, len(code)) for x in u]
            units = list(code)
            found = pa.compute.index_in(pa.array(units, pa.string()), known).fill_null(-1).to_numpy(zero_copy_only=False)
            rare = np.flatnonzero(found < 0)
            folds = [p.fold(units[k]) for k in rare]
            size = np.where(found >= 0, known_at[found + 1] - known_at[found], 0) if len(known) else np.zeros(len(units), np.int64)
            size[rare] = [len(x) for x in folds]
            at = np.where(found >= 0, known_at[found], 0) if len(known) else np.zeros(len(units), np.int64)
            at[rare] = len(known_flat) + np.cumsum(size[rare]) - size[rare]
            table_ = np.concatenate([known_flat, np.fromiter((i for x in folds for i in x), np.int32, int(size[rare].sum()))]).astype(np.int32)
            c = np.array(flat, np.int64)
            lengths = size[c] if len(c) else np.empty(0, np.int64)
            ends = np.cumsum(lengths)
            all_ids = table_[np.repeat(at[c] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)] if len(c) else np.empty(0, np.int32)
            per = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            same = [decode(p, all_ids[x:y]) == t for t, x, y in zip(texts, per, per[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(all_ids)), pa.array(np.diff(per).astype(np.int64)), pa.array(same)],
                names=["doc_id", "ids", "n_tokens", "round_trip"],
            )

    rows = docs.select("doc_id", text_bytes(text).alias("_text"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return rows.mapInArrow(run, kind)


def decode(p: Pieces, ids) -> str:
    out = b"".join(map(p.out.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """rows with their ids' text as the column text; null ids give null."""
    path = path or vocabulary("piece_bpe_32k.model")
    at = rows.columns.index(ids)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        p = pieces_at(path)
        for b in batches:
            texts = [None if x is None else decode(p, x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("text", T.StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    return encoded(table(spark, sf_dir, "documents"))
