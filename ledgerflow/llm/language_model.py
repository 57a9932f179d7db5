"""Language-model scoring with a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class, history), both from hashed
n-grams and skips of the history. A token's class comes from its form (its ending, or
the whole of a short one), the end of a text has its own. P(class | history) is a
softmax over CLASSES. Within a class, tokens are the leaves of a Huffman tree, and each
turn on the way to one is a binary maximum-entropy decision given the same features,
whose bias is the odds of the counts below. The frequent tokens are leaves of their own,
the others of a class share leaves by a hash of the form, as many as there are others
for; within such a leaf counts decide. Without weights P(token | class) would be that of
the counts, with half a count for what is not known, spread over the class's shared
leaves; the probabilities of all tokens and one unknown one a shared leaf sum to one. All
counts are exact and over all training texts.

Training takes every training text once, in ROUNDS: each task runs mini-batch
AdaGrad from the last round's weights over its texts and sends its change, in blocks.
Changes of the classes' feature rows are averaged by the number of updates of each row.
Those of the turns' weights, a hashed table that grows with the training tokens up to
2^CELL_BITS, are merged by precision: 1 + s in a task of squared gradients s, 1 + sum(s) in
all, so that what several tasks saw once each adds up, and what all know well is averaged.

Counts of frequent tokens (at least N / HEAD occurrences: at most HEAD tokens can
have so many) go to every task; the others' occurrences meet their counts in an
equi-join, so that no table that grows with the corpus is broadcast.

Defined cases: a null or empty text is its end alone; a null id counts as the empty text in
the hash, hence trains; repeated rows count each time; without training texts all
counts are zero; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import mix64, starts_of, table, text_bytes, written

CLASSES, ROWS, FEATURES, ROUNDS = 32, 1 << 15, 4, 3
HEAD = 1 << 20
BATCH, RATE, BLOCK_ROWS = 16384, 0.3, 1024
SUB_BATCH, SAFE_LOGIT = 2048, 80  # what a processor's cache holds; exp() is finite and above zero in single precision
DENSE = 16  # a table of fewer cells for each that is used is cleared as a whole
CHUNK_BYTES = 5_000_000
HELD_FORMS, HELD_BYTES = 1 << 20, 32_000_000
CELL_BITS, CELLS_A_TOKEN = 22, 4
TURN_BATCH, TURN_RATE, OCTAVE = 1024, 0.1, 12
SPOT_BITS, FORMS_A_SPOT = 13, 64
TASKS, TASK_TOKENS = 6, 2_000_000
END = CLASSES - 1
_NONE = 0x5851F42D4C957F2D
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_NODE, _ODD_CELL = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def class_of(form: bytes) -> int:
    return xxhash.xxh64_intdigest(form if len(form) <= 3 else b"-" + form[-2:]) % END


def classes_of(forms: list[bytes] | pa.Array) -> np.ndarray:
    """class_of() each, by way of the few distinct endings."""
    if not len(forms):
        return np.empty(0, np.int64)
    words = forms if isinstance(forms, pa.Array) else pa.array(forms, pa.binary())
    short = pa.compute.less_equal(pa.compute.binary_length(words), 3)
    ends = pa.compute.if_else(short, words, pa.compute.binary_join_element_wise(b"-", pa.compute.binary_slice(words, -2), b"")).dictionary_encode()
    own = [xxhash.xxh64_intdigest(e) % END for e in ends.dictionary.to_pylist()]
    return np.array(own, np.int64)[ends.indices.to_numpy()]


def hashes_of(forms: list[bytes]) -> np.ndarray:
    return np.array([*map(xxhash.xxh64_intdigest, forms)], np.uint64)


def token_hash(token: Column) -> Column:
    return F.xxhash64(token)


def spots_of(hashes: np.ndarray) -> np.ndarray:
    """Which of the 2^SPOT_BITS finest shared leaves of its class a form has."""
    return (hashes >> np.uint64(64 - SPOT_BITS)).astype(np.int64)


def _chunks(batches, at: int):
    """Batches cut at about CHUNK_BYTES of text."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(at)).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1], CHUNK_BYTES)) + 1 if len(ends) else []), b.num_rows]
        for a, c in zip(cuts, cuts[1:]):
            if c > a:
                yield b.slice(a, c - a)


def tokenized(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the forms of all words in a row, A-Z in lower case, the distinct forms, and how many words each text has. Arrow
    cuts at the six characters that bytes.split() cuts at, and leaves bytes beyond ASCII as they are; no word becomes an object."""
    parts = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.cast(pa.string(), safe=False)))
    words, ends = parts.flatten(), np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
    real = pa.compute.greater(pa.compute.binary_length(words), 0)  # white space at a text's ends leaves an empty word
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    counts = np.diff(before[np.concatenate([[0], ends]).astype(np.int64)])
    d = (words if before[-1] == len(words) else words.filter(real)).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.cast(pa.binary()), counts


def listed(words: pa.Array) -> list[bytes]:
    """to_pylist() of a binary array without nulls, a slice of its buffer each."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).tolist()
    raw = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [raw[a:c] for a, c in zip(ends, ends[1:])]


def _count(batches):
    """(text) -> token, class, spot, n: a row for each form of some chunks, of HELD_FORMS or few more together. The end of texts is
    the null token."""

    def rows():
        all_words = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
        forms = all_words.dictionary
        n = np.bincount(all_words.indices.to_numpy(), np.concatenate(counts), len(forms)).astype(np.int64) if len(forms) else np.empty(0, np.int64)
        classes = np.append(classes_of(forms), END).astype(np.int32)
        spots = np.append(spots_of(hashes_of(listed(forms))), 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([forms, pa.nulls(1, pa.binary())]), pa.array(classes), pa.array(spots), pa.array([*n, texts], pa.int64())], names=["token", "class", "spot", "n"])

    words, counts, texts, held, size = [], [], 0, 0, 0
    for b in _chunks(batches, 0):
        codes, own, per_text = tokenized(b.column(0))
        words.append(own)
        counts.append(np.bincount(codes, minlength=len(own)))
        texts, held, size = texts + len(per_text), held + len(own), size + own.nbytes
        if held >= HELD_FORMS or size >= HELD_BYTES:
            yield rows()
            words, counts, texts, held, size = [], [], 0, 0, 0
    if texts:
        yield rows()


def token_counts(texts: DataFrame) -> DataFrame:
    """token (binary, null: the end), class, spot and c, as a written table. texts: a binary column."""
    return written(texts.mapInArrow(_count, "token binary, class int, spot int, n long").groupBy("token", "class", "spot").agg(F.sum("n").alias("c")), "lm-counts")


class Tree:
    """A Huffman tree for each class but the end's. Leaves: the frequent tokens, then each class's shared ones."""

    def __init__(self, tokens: list[bytes], classes: np.ndarray, counts: np.ndarray, shared: np.ndarray):
        """shared: the mass of each class's shared leaves, a row a class, a power of two in number."""
        self.leaf, self.counts, self.spots = {t: i for i, t in enumerate(tokens)}, counts, shared.shape[1]
        mass = np.concatenate([counts + 0.5, shared.ravel()])
        own = np.concatenate([classes, np.repeat(np.arange(END), self.spots)])
        self.mass = np.bincount(own, mass, END)
        self.parent = np.full(2 * len(mass) - END + 1, -1, np.int32)  # what index -1 gives, so that roots have no way up
        self.right = np.zeros(len(self.parent), bool)
        self.bias = np.zeros(len(self.parent), np.float32)
        node = len(mass)
        by_class = np.lexsort((mass, own))
        for ids in np.split(by_class, np.searchsorted(own[by_class], np.arange(1, END))):
            leaves, inner, i, j = mass[ids].tolist(), [], 0, 0
            ids, first = ids.tolist(), node
            for _ in range(len(ids) - 1):  # the two least, of leaves and nodes in order
                two = []
                for _ in range(2):
                    if i < len(leaves) and (j == len(inner) or leaves[i] <= inner[j]):
                        two.append((ids[i], leaves[i]))
                        i += 1
                    else:
                        two.append((first + j, inner[j]))
                        j += 1
                (a, less), (b, more) = two
                self.parent[a] = self.parent[b] = node
                self.right[b] = True
                self.bias[node] = math.log(more / less)
                inner.append(less + more)
                node += 1

    def paths(self, t: _Tokens) -> _Paths:
        own = np.fromiter(map(self.leaf.get, t.forms, repeat(-1)), np.int64, len(t.forms))
        leaf, rare = own.copy(), np.flatnonzero(own < 0)
        leaf[rare] = len(self.leaf) + t.classes[rare] * self.spots + spots_of(t.hashes[rare]) * self.spots // (1 << SPOT_BITS)
        up, right, at = [np.full(len(leaf) + 1, -1, np.int32)], [np.zeros(len(leaf) + 1, bool)], np.append(leaf, -1)
        while (above := self.parent[at]).max() >= 0:
            up.append(above)
            right.append(self.right[at])
            at = above
        up, right = np.array(up).T, np.array(right).T
        return _Paths(up, right, up >= 0, self.bias, own)


class _Paths:
    """The turns to each of a chunk's forms and to the end, which has none: form by form, from the leaf up. own: the forms' leaves,
    -1 where these are shared."""

    def __init__(self, up: np.ndarray, right: np.ndarray, real: np.ndarray, bias: np.ndarray, own: np.ndarray):
        self.n, self.own = real.sum(1), own
        self.starts = starts_of(self.n)
        node, self.right = up[real], right[real].astype(np.float32)
        self.bias, self.key = bias[node], node.astype(np.uint32) * _ODD_NODE

    @cached_property
    def prior(self) -> np.ndarray:
        """Each form's log probability in its class by the biases alone."""
        return np.bincount(np.repeat(np.arange(len(self.n)), self.n), _log_of_turns(self.bias, self.right), len(self.n))


def _log_of_turns(z: np.ndarray, right: np.ndarray) -> np.ndarray:
    z = z * (1 - 2 * right)
    return -np.maximum(z, 0) - np.log(1 + np.exp(-np.abs(z)))


class _Turns:
    """The turns of some tokens of a chunk, all of one class, each with the cells of its weights."""

    def __init__(self, paths: _Paths, t: _Tokens, at: np.ndarray, n_cells: int):
        self.paths, self.code = paths, (code := t.code[at])
        n = paths.n[code]
        self.starts = starts_of(n)
        token = np.repeat(np.arange(len(at)), n)
        place = (paths.starts[code] - self.starts).take(token)
        place += np.arange(len(token))
        self.right, self.bias = paths.right.take(place), paths.bias.take(place)
        own = (n_cells // FEATURES).bit_length() - 1  # each feature has a part of the table: those of many values don't blur the others
        h = np.ascontiguousarray(t.keys_by_token.take(at).take(token).view(np.uint32).reshape(-1, FEATURES).T)
        h ^= paths.key.take(place)
        h *= _ODD_CELL
        h >>= np.uint32(32 - own)
        h += (np.arange(FEATURES, dtype=np.uint32) << np.uint32(own))[:, None]
        self.cells = h.astype(np.intp)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        z = weights[0] + weights[1]
        for w in weights[2:]:
            z += w
        z += self.bias
        return z

    def gain(self, cells: np.ndarray) -> np.ndarray:
        """For each token, the log probability of its turns less that by the counts alone."""
        z = self.logits(cells.take(self.cells))
        return np.add.reduceat(_log_of_turns(z, self.right), self.starts, dtype=np.float64) - self.paths.prior[self.code]


def _by_class(t: _Tokens, paths: _Paths) -> Iterator[tuple[int, np.ndarray]]:
    """The chunk's tokens that have turns, in parts of one class and TURN_BATCH at most: a class's weights are its own, and few
    enough for a processor's cache."""
    order = np.argsort(t.y.astype(np.uint8), kind="stable")
    order = order[paths.n[t.code[order]] > 0]
    ends = np.searchsorted(t.y[order], np.arange(END + 1))
    for k in range(END):
        for a in range(ends[k], ends[k + 1], TURN_BATCH):
            yield k, order[a : min(a + TURN_BATCH, ends[k + 1])]


class _Tokens:
    """A chunk's tokens with their classes and feature rows; each text has its end as its last token."""

    def __init__(self, texts: list[bytes] | pa.Array):
        codes, self.words, counts = tokenized(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        self.forms = listed(self.words)
        self.counts = counts + 1
        self.starts = starts_of(self.counts)
        n = int(self.counts.sum())
        ends = self.starts + counts
        self.code = np.full(n, len(self.forms), np.int64)  # the end comes after all forms
        inner = np.ones(n, bool)
        inner[ends] = False
        self.code[inner] = codes
        self.inner = inner
        self.hashes = np.append(hashes_of(self.forms), np.uint64(1))
        self.classes = np.append(classes_of(self.words), END)
        h, self.y = self.hashes.take(self.code), self.classes.take(self.code)
        # the first places of each text have no such history
        early = [self.starts[self.counts > k] + k for k in range(3)]

        def back(x, k, none):
            out = np.empty_like(x)
            out[:k], out[k:] = none, x[: n - k] if k <= n else x[:0]
            for at in early[:k]:
                out[at] = none
            return out

        h2 = back(h, 2, _NONE)
        h = back(h, 1, _NONE)
        self.keys = np.empty((FEATURES, n), np.uint32)
        # the token before, the two before, the one before that (skipping one), the classes of three: what one form decides is
        # mixed once for it, what the classes decide once for all
        for i, k in ((0, 1), (2, 2)):
            self.keys[i] = back(_mixed(self.hashes, i).take(self.code), k, _mixed(np.array([_NONE], np.uint64), i)[0])
        for part in _blocks(n, BATCH):
            self.keys[1, part] = _mixed(h[part] * _ODD + h2[part], 1)
        y = self.y.astype(np.uint16)
        c1, c2, c3 = (back(y, k, END) for k in (1, 2, 3))
        self.keys[3] = _MIXED_CLASSES.take((c1 * CLASSES + c2) * CLASSES + c3)
        self.rows = (self.keys >> np.uint32(32 - ROWS.bit_length() + 1)).astype(np.uint16)

    @cached_property
    def keys_by_token(self) -> np.ndarray:
        """The four keys of each token as one number of 16 bytes."""
        return np.ascontiguousarray(self.keys.T).view(np.complex128).ravel()


def _mixed(x: np.ndarray, feature: int) -> np.ndarray:
    return (mix64(x + np.uint64(feature << 56)) >> np.uint64(32)).astype(np.uint32)


_MIXED_CLASSES = _mixed(np.arange(CLASSES**3, dtype=np.uint64), 3)


def _logits(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits whose exponentials and their sum are finite and above zero."""
    z = w.take(rows[0], 0)
    for r in rows[1:]:
        z += w.take(r, 0)
    z += bias
    if not (z.max() < SAFE_LOGIT and z.min() > -SAFE_LOGIT):  # a row's own maximum takes as long as the rest together
        z -= z.max(1, keepdims=True)
    return z


def _own_logits(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The place of each row's class in z.ravel()."""
    return np.arange(0, z.size, CLASSES) + y


def _blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(a, a + size) for a in range(0, n, size))


def _sums_by_row(err: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the sum of the rows of err that it has: two classes at a time, as the parts of complex numbers."""
    sums = np.zeros((CLASSES // 2, n), np.complex64)
    for own, pair in zip(sums, np.ascontiguousarray(err.view(np.complex64).T)):
        for place in places:
            np.add.at(own, place, pair)
    return np.ascontiguousarray(sums.T).view(np.float32)


def _train(shared, bias):
    """(text) -> block, updates, change: what this task's texts make of the last weights. The turns' blocks come after
    those of the classes' ROWS, with precisions for updates."""

    def run(batches):
        old, cells, tree = shared.value
        where = np.empty(ROWS, np.intp)
        w, square, seen = old.copy(), np.full(old.shape, 1.0, np.float32), np.zeros(ROWS, np.float32)
        turns, ones = [_TurnWeights(c) for c in cells], np.ones((CLASSES, 1), np.float32)
        for b in _chunks(batches, 0):
            t = _Tokens(b.column(0))
            paths = tree.paths(t)
            for k, at in _by_class(t, paths):
                turns[k].learn(_Turns(paths, t, at, len(cells[k])))
            for a in range(0, len(t.y), BATCH):
                rows, y = t.rows[:, a : a + BATCH], t.y[a : a + BATCH]
                p = np.empty((len(y), CLASSES), np.float32)
                for part in _blocks(len(y), SUB_BATCH):
                    z = _logits(w, bias, rows[:, part])
                    np.exp(z, out=z)
                    np.divide(z, z @ ones, out=p[part])
                p.ravel()[_own_logits(p, y)] -= 1
                flat = rows.ravel().astype(np.intp)
                times = np.bincount(flat, minlength=ROWS)
                own = np.flatnonzero(times)
                where[own] = np.arange(len(own))
                g = _sums_by_row(p, where[flat].reshape(rows.shape), len(own))
                for part in _blocks(len(own), SUB_BATCH):
                    at, step = own[part], g[part]
                    scale = square.take(at, 0)
                    scale += step * step
                    square[at] = scale
                    step *= RATE
                    step /= np.sqrt(scale, out=scale)
                    new = w.take(at, 0)
                    new -= step
                    w[at] = new
                seen[own] += times[own]
            del t, paths  # before the next chunk takes their place
        for k in range(0, ROWS, BLOCK_ROWS):
            part = slice(k, k + BLOCK_ROWS)
            if seen[part].any():
                change = (w[part] - old[part]).astype(np.float16)
                yield _block(k, seen[part], change)
        for k, (c, new) in enumerate(zip(cells, turns)):
            if (new.square > 1).any():
                precision = np.minimum(np.rint(np.log2(new.square) * OCTAVE), 255).astype(np.uint8)
                yield _block(ROWS + k, precision, (new.w - c).astype(np.float16))

    return run


def _block(k: int, updates: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([updates.tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], names=["block", "updates", "change"])


class _TurnWeights:
    """The weights of a class's turns as a task learns them, with AdaGrad's sums of squares: real and imaginary parts of one
    array, as both are always read and written together."""

    def __init__(self, cells: np.ndarray):
        self.both, self.sums = (cells + np.complex64(1j)).astype(np.complex64), np.zeros(len(cells), np.float32)
        self.w, self.square = self.both.real, self.both.imag

    def learn(self, turns: _Turns) -> None:
        both = self.both.take(turns.cells)
        with np.errstate(over="ignore"):
            g = 1 / (1 + np.exp(-turns.logits(both.real))) - turns.right
        for cells, own in zip(turns.cells, both):  # no two features share a cell
            np.add.at(self.sums, cells, g)
            step = self.sums.take(cells)
            scale = step * step
            scale += own.imag
            own.imag = scale
            step *= TURN_RATE
            step /= np.sqrt(scale, out=scale)
            own.real -= step
            self.both[cells] = own  # a cell that comes twice gets the same twice
        if len(self.sums) < DENSE * turns.cells.size:
            self.sums.fill(0)
        else:
            self.sums[turns.cells.ravel()] = 0


_PRECISIONS = np.exp2(np.arange(256) / OCTAVE)


def _averaged(batches):
    """Sums a stream of changes, whatever blocks it has; one row for each block."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for k, n, d in zip(*(c.to_pylist() for c in b.columns)):
            if k < ROWS:
                n = np.frombuffer(n, np.float32).astype(np.float64)
                d = np.frombuffer(d, np.float16).reshape(BLOCK_ROWS, CLASSES).astype(np.float64) * n[:, None]
            else:
                n = _PRECISIONS.take(np.frombuffer(n, np.uint8))
                d = np.frombuffer(d, np.float16) * n
                n -= 1  # the squares of this task alone
            have = sums.get(k)
            sums[k] = (n, d) if have is None else (have[0] + n, have[1] + d)
    for k, (n, d) in sums.items():
        mean = (d / np.maximum(n, 1)[:, None] if k < ROWS else d / (1 + n)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["block", "change"])


def train(texts: DataFrame, part: Column, bias: np.ndarray, tree: Tree, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The weights of classes, and of turns for each class. part: the round of each text, 0 to ROUNDS - 1; n: how many tokens they have."""
    spark = texts.sparkSession
    w = np.zeros((ROWS, CLASSES), np.float32)
    share = tree.mass / tree.mass.sum() * min(1 << CELL_BITS, max(1 << 16, n * CELLS_A_TOKEN)) / FEATURES
    cells = [np.zeros(FEATURES << round(math.log2(max(x, 16))), np.float32) for x in share]
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, cells, tree))
        own = texts.filter(part == r).select("text").coalesce(n // ROUNDS // TASK_TOKENS + TASKS)
        change = own.mapInArrow(_train(shared, bias), "block int, updates binary, change binary")
        w = w.copy()
        for row in change.repartition("block").mapInArrow(_averaged, "block int, change binary").toLocalIterator():  # ROWS * CLASSES + 2^CELL_BITS numbers
            d = np.frombuffer(row.change, np.float32)
            if row.block < ROWS:
                w[row.block : row.block + BLOCK_ROWS] += d.reshape(BLOCK_ROWS, CLASSES)
            else:
                cells[row.block - ROWS] = cells[row.block - ROWS] + d
        shared.unpersist()
    return w, cells


class Model:
    """What scoring needs: weights, class totals and the trees with the frequent tokens' counts."""

    def __init__(self, w, bias, totals, distinct, cells, tree, end_count):
        self.w, self.bias, self.cells, self.tree, self.end_count = w, bias, cells, tree, end_count
        self.below = np.log10(totals[:END] + 0.5 * (distinct[:END] + 1))
        self.below = np.append(self.below, 0.0)


def _score(shared):
    """(uid, doc_id, held_out, text) -> sums of each text, and its tokens that aren't frequent."""

    def run(batches):
        m = shared.value
        tree, ones = m.tree, np.ones(CLASSES, np.float32)
        for b in _chunks(batches, 3):
            t = _Tokens(b.column(3))
            n, paths = len(t.counts), tree.paths(t)
            leaf = paths.own
            c = np.append(np.where(leaf < 0, -1, np.append(tree.counts, 0)[leaf]), 0)
            known = c >= 0
            logs = np.where(known, np.log10(np.maximum(c, 0) + 0.5), 0.0)
            logs[-1] = 0.0  # the end's part is added for each text
            part = np.empty(len(t.y))
            for own in _blocks(len(t.y), SUB_BATCH):
                z = _logits(m.w, m.bias, t.rows[:, own])
                mine = z.ravel().take(_own_logits(z, t.y[own]))
                part[own] = mine - np.log(np.exp(z, out=z) @ ones)
            for k, at in _by_class(t, paths):
                part[at] += _Turns(paths, t, at, len(m.cells[k])).gain(m.cells[k])
            total = np.add.reduceat(part, t.starts) / math.log(10) - np.add.reduceat(m.below[t.y], t.starts)
            counted = np.add.reduceat(logs[t.code], t.starts) + math.log10(m.end_count + 0.5)
            n_head = np.add.reduceat((known[t.code] & t.inner).astype(np.int64), t.starts) + (m.end_count > 0)
            rare = np.flatnonzero(~known[t.code])
            pair = np.repeat(np.arange(n), t.counts)[rare] * (len(t.forms) + 1) + t.code[rare]
            pair, times = np.unique(pair, return_counts=True)
            ends = np.searchsorted(pair // (len(t.forms) + 1), np.arange(n + 1)).astype(np.int32)
            words = t.words.take(pa.array(pair % (len(t.forms) + 1)))
            tail = pa.StructArray.from_arrays([words, pa.array(times.astype(np.int32))], names=["token", "n"])
            cols = [*b.columns[:3], pa.array(t.counts), pa.array(n_head), pa.array(counted), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), tail)]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "held_out", "n_tokens", "n_head", "counted", "classed", "tail"])

    return run


def fit(docs: DataFrame, training: Column, text: str = "text") -> tuple[Model, DataFrame, int, int]:
    """The model, the table of counts, N and V."""
    texts = docs.filter(training).select(text_bytes(text).alias("text"), F.pmod(F.xxhash64(text), F.lit(ROUNDS)).alias("part"))
    counts = token_counts(texts.select("text"))
    per = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    totals, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per:
        totals[r["class"]], distinct[r["class"]] = r.n, r.v if r.n else 0
    n, v = int(totals.sum()), int(distinct.sum())
    bias = np.log((totals + 0.5) / (n + 0.5 * CLASSES)).astype(np.float32)
    w, cells = train(texts, F.col("part"), bias, tree := tree_of(counts, n, v), n)
    return Model(w, bias, totals, distinct, cells, tree, int(totals[END])), counts, n, v


def tree_of(counts: DataFrame, n: int, v: int) -> Tree:
    words, often = counts.filter("token is not null"), F.col("c") * HEAD >= n
    head = sorted(words.filter(often).select("token", "class", "c").collect()) if n else []  # HEAD at most
    # shared leaves: a power of two for each class, with FORMS_A_SPOT forms on average
    bits = min(SPOT_BITS, max(0, (v - len(head)) // (END * FORMS_A_SPOT)).bit_length())
    shared = np.full((END, 1 << bits), 0.5 / (1 << bits))
    rare = words.filter(~often).groupBy("class", F.shiftright("spot", SPOT_BITS - bits).alias("spot"))
    for r in rare.agg(F.sum(F.col("c") + 0.5).alias("mass")).collect() if n else []:  # END * 2^SPOT_BITS at most
        shared[r["class"], r.spot] += r.mass
    return Tree([bytes(r.token) for r in head], np.array([r["class"] for r in head], np.int64), np.array([r.c for r in head], np.float64), shared)


def scored(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = docs.withColumn("_out", held_out)
    model, counts, n, v = fit(docs, ~F.col("_out"), text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("_out").alias("held_out"), text_bytes(text).alias("text"))
    tail = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.IntegerType())]))
    doubles = [T.StructField(c, T.DoubleType()) for c in ("counted", "classed")]
    kind = T.StructType([rows.schema["uid"], rows.schema["doc_id"], rows.schema["held_out"], T.StructField("n_tokens", T.LongType()), T.StructField("n_head", T.LongType()), *doubles, T.StructField("tail", tail)])
    parts = written(rows.mapInArrow(_score(shared), kind), "lm-scored")
    rare = parts.select("uid", F.explode("tail").alias("t")).select("uid", F.col("t.token").alias("token"), F.col("t.n").alias("n"))
    # tokens meet by a hash, as numbers are sorted faster than bytes are; of equal hashes, equal tokens (as = would be sorted by, too)
    known = counts.filter("token is not null and c > 0").select(F.col("token").alias("own"), F.log10(F.col("c") + 0.5).alias("log"))
    same = (token_hash(F.col("token")) == token_hash(F.col("own"))) & (F.col("token") <= F.col("own")) & (F.col("token") >= F.col("own"))
    rare = rare.join(known.hint("merge"), same, "left").groupBy("uid")
    rare = rare.agg(F.sum(F.col("n") * F.coalesce("log", F.lit(math.log10(0.5)))).alias("rare"), F.sum(F.when(F.col("log").isNotNull(), F.col("n")).otherwise(0)).alias("n_rare"))
    rows = parts.drop("tail").join(rare, "uid", "left")
    counted = F.col("counted") + F.coalesce("rare", F.lit(0.0))
    n_known = F.col("n_head") + F.coalesce("n_rare", F.lit(0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        # a class's own tokens take their counts' part from the class; the end is all of its class; unknown tokens have an
        # equal part of their class's half count on each shared leaf
        (counted - math.log10(model.end_count + 0.5) + F.col("classed") - (F.col("n_tokens") - n_known) * math.log10(model.tree.spots)).alias("score"),
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    return scored(table(spark, sf_dir, "documents"), remainder() == 1)
