import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerflow.llm import language_model as L


def base(corpus):
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in corpus]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, w in words:
        if not out(i):
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), 6)) for i, w in words), key=repr)


def test_base_equals_brute_force(docs, corpus, monkeypatch):
    for head in (L.HEAD, 50):  # all tokens frequent, and most of them joined
        monkeypatch.setattr(L, "HEAD", head)
        rows = L.scored(docs, L.remainder() == 1).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr) == base(corpus)
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_probabilities_sum_to_one(docs):
    model, counts, n, _ = L.fit(docs, L.remainder() != 1)
    t = L._Tokens([b"the is", b""])
    z = L._logits(model.w, model.bias, t.rows)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    known = counts.collect()
    own = np.zeros(L.CLASSES)
    for r in known:
        own[r["class"]] += 1 if r["class"] == L.END else 10 ** (math.log10(r.c + 0.5) - model.below[r["class"]])
    own[: L.END] += 0.5 * 10 ** -model.below[: L.END]
    assert np.allclose((p * own).sum(1), 1, atol=1e-6)


def test_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in L.scored(docs, L.remainder() == 1).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.05 * sum(r.n_tokens for r in rows)


def test_two_tokens_before_are_a_feature():
    # the same token before and the same one two before, each on its own, but never together
    t = L._Tokens([b"aa cc x", b"aa dd x", b"bb cc x", b"bb dd x"])
    rows = t.rows[:, t.starts + 2]
    assert L.FEATURES == len(rows) == 4 and [len(set(r)) for r in rows[:3].tolist()] == [2, 4, 2]
    # one token gives different rows as the token before and as the one before that
    t = L._Tokens([b"aa aa x"])
    assert t.rows[0, 2] != t.rows[2, 2]


def test_nothing(no_docs):
    assert L.scored(no_docs, L.remainder() == 1).count() == 0


def within_class(model, texts):
    """Of each token, the natural log of how much likelier in its class the history makes it than the counts."""
    t = L._Tokens(texts)
    paths, gain = model.tree.paths(t), np.zeros(len(t.y))
    for k, at in L._by_class(t, paths):
        gain[at] = L._Turns(paths, t, at, len(model.cells[k])).gain(model.cells[k])
    return t, gain


def test_history_chooses_within_a_class(spark):
    assert L.class_of(b"singing") == L.class_of(b"ringing")
    texts = [f"{i} " + ("red singing blue ringing ", "blue ringing red singing ")[i % 2] * 10 for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    t, gain = within_class(L.fit(docs, F.lit(True))[0], [b"red singing", b"red ringing"])
    fit, unfit = gain[t.starts + 1]  # the words have the same class and count
    assert fit > 0.1 and unfit < -0.1


def test_probabilities_within_a_class_sum_to_one(docs, monkeypatch):
    for head, forms in ((L.HEAD, 64), (50, 1)):
        monkeypatch.setattr(L, "HEAD", head)
        monkeypatch.setattr(L, "FORMS_A_SPOT", forms)
        model, counts, *_ = L.fit(docs, L.remainder() != 1)
        tree = model.tree
        c = {bytes(r.token): r.c for r in counts.collect() if r.token is not None}
        unknown, i = {}, 0
        while len(unknown) < L.END * tree.spots:  # one for each shared leaf
            form, i = b"unknown%x" % i, i + 1
            unknown.setdefault((L.class_of(form), int(L.spots_of(L.hashes_of([form]))[0]) * tree.spots >> L.SPOT_BITS), form)
        forms = [*c, *unknown.values()]
        t, gain = within_class(model, [b"the is " + f for f in forms])
        at = t.starts + 2
        mass = np.array([c[f] + 0.5 if f in c else 0.5 / tree.spots for f in forms])
        p = mass / 10 ** model.below[t.y[at]]
        assert np.allclose(np.bincount(t.y[at], p * np.exp(gain[at]), L.END), 1, atol=1e-5)
        assert np.abs(gain[at]).max() > 0.1  # the history has a say


def test_merging_adds_what_few_know_and_averages_what_all_know():
    def merged(square, times):
        b = L._block(L.ROWS, np.full(8, round(L.OCTAVE * math.log2(square)), np.uint8), np.full(8, 0.25, np.float16))
        return np.frombuffer(next(L._averaged([b] * times)).column(1)[0].as_py(), np.float32)[0]

    assert abs(merged(1, 2) - 0.5) < 1e-6 and abs(merged(2**12, 2) - 0.25) < 1e-3


def test_words_are_those_of_split():
    texts = [b"", b" \t\r\n", b"  The\x0bcat\x0c\x0c the CAT\n", "Ñandú\xa0É x\x85 Y\x1cz".encode(), b"\xff\xfe A\x00b \xc3", b"end"]
    all_of = pa.array([b"not this", *texts, b"nor this"], pa.binary())
    for part in (all_of.slice(1, len(texts)), all_of.slice(1, 2), all_of.slice(0, 0)):
        codes, words, counts = L.tokenized(part)
        want = [t.lower().split() for t in part.to_pylist()]
        forms = L.listed(words)
        assert forms == words.to_pylist() == list(dict.fromkeys(w for t in want for w in t))
        assert [forms[c] for c in codes] == [w for t in want for w in t] and counts.tolist() == [len(t) for t in want]
    assert L.listed(pa.array([b"a", b"", b"bc", b"d"], pa.binary()).slice(1, 2)) == [b"", b"bc"]


def test_a_form_is_looked_up_once_a_chunk(docs):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    class Shared:
        value = L.fit(docs, L.remainder() != 1)[0]

    leaf = Shared.value.tree.leaf = Counted(Shared.value.tree.leaf)
    rows = [pa.array([1], pa.int64())] * 2 + [pa.array([False]), pa.array([b"the is on the unheard-of"], pa.binary())]
    list(L._score(Shared)([pa.RecordBatch.from_arrays(rows, names=["uid", "doc_id", "held_out", "text"])]))
    assert leaf.asked == 4


def test_a_form_is_counted_once_for_some_chunks(monkeypatch):
    monkeypatch.setattr(L, "CHUNK_BYTES", 10)
    texts = pa.RecordBatch.from_arrays([pa.array([b"the cat the", b"", b"The dog", b"a cat"], pa.binary())], names=["text"])
    for held, n_rows in ((1 << 20, 5), (1, 8)):
        monkeypatch.setattr(L, "HELD_FORMS", held)
        rows = [r for b in L._count([texts]) for r in b.to_pylist()]
        total = Counter()
        for r in rows:
            total[r["token"]] += r["n"]
            assert r["class"] == (L.END if r["token"] is None else L.class_of(r["token"]))
        assert total == {b"the": 3, b"cat": 2, b"dog": 1, b"a": 1, None: 4}
        assert len(rows) == n_rows if held > 1 else len(rows) >= n_rows


def test_tokens_of_equal_hashes_are_told_apart(docs, corpus, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 50)
    monkeypatch.setattr(L, "token_hash", F.length)
    rows = L.scored(docs, L.remainder() == 1).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr) == base(corpus)


def test_sums_of_rows_and_logits():
    rng = np.random.default_rng(1)
    err, places = rng.normal(size=(50, L.CLASSES)).astype(np.float32), rng.integers(0, 7, (L.FEATURES, 50))
    want = np.zeros((7, L.CLASSES))
    for row in places:
        for i, k in enumerate(row):
            want[k] += err[i]
    assert np.allclose(L._sums_by_row(err, places, 7), want, atol=1e-4)
    w, rows = rng.normal(size=(16, L.CLASSES)).astype(np.float32), rng.integers(0, 16, (L.FEATURES, 50))
    for scale in (1, 1000):  # beyond what exp() can take
        z = L._logits(w * np.float32(scale), np.zeros(L.CLASSES, np.float32), rows).astype(float)
        plain = w[rows].sum(0).astype(float) * scale
        assert np.isfinite(np.exp(z.astype(np.float32))).all() and np.allclose(z - z.max(1, keepdims=True), plain - plain.max(1, keepdims=True), rtol=1e-4, atol=1e-2 * scale)


def test_score_is_what_weights_and_turns_say(spark):
    """The model's log10 probability of texts, class and turns, by a plain reading of its definition."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}ing" for k in range(1, 40))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    model, counts, *_ = L.fit(docs, docs.doc_id < 50)
    c = {bytes(r.token): r.c for r in counts.collect() if r.token is not None}
    tree, low = model.tree, (1 << 32) - 1
    log = lambda z: -math.log1p(math.exp(-z)) if z > 0 else z - math.log1p(math.exp(z))

    def score(text):
        own, t, out = [*text.encode().lower().split(), None], L._Tokens([text.encode()]), 0.0
        for k, x in enumerate(own):
            z = model.bias.astype(float) + sum(model.w[r].astype(float) for r in t.rows[:, k])
            y = L.END if x is None else L.class_of(x)
            out += z[y] - z.max() - math.log(np.exp(z - z.max()).sum())
            if x is None:
                continue
            spot = int(L.spots_of(L.hashes_of([x]))[0]) * tree.spots >> L.SPOT_BITS
            at = tree.leaf[x] if x in tree.leaf else len(tree.leaf) + y * tree.spots + spot
            mass = (c.get(x, 0) + 0.5) if x in c else 0.5 / tree.spots
            prior, cells = math.log(mass) - math.log(10) * model.below[y], model.cells[y]
            bits = (len(cells) // L.FEATURES).bit_length() - 1
            while tree.parent[at] >= 0:
                node, sign = int(tree.parent[at]), 1 if tree.right[at] else -1
                places = [((((int(key) ^ (node * int(L._ODD_NODE) & low)) * int(L._ODD_CELL)) & low) >> (32 - bits)) + (i << bits) for i, key in enumerate(t.keys[:, k])]
                bias = float(tree.bias[node])
                prior += log(sign * (bias + sum(float(cells[p]) for p in places))) - log(sign * bias)
                at = node
            out += prior
        return out / math.log(10)

    got = {r.doc_id: r.score for r in L.scored(docs, F.col("doc_id") >= 50).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - score(r.text or "")) < 1e-3 * abs(got[r.doc_id])


def test_keys_are_those_of_the_tokens_before():
    t = L._Tokens([b"aa bb cc dd", b"", b"bb aa"])
    h = {w: int(x) for w, x in zip(t.forms, t.hashes)}
    for text, start in ((b"aa bb cc dd", 0), (b"", 5), (b"bb aa", 6)):
        w = text.split()
        for k in range(len(w) + 1):
            h1, h2 = (h[w[k - i]] if k >= i else L._NONE for i in (1, 2))
            c = [L.class_of(w[k - i]) if k >= i else L.END for i in (1, 2, 3)]
            xs = [h1, h1 * int(L._ODD) + h2, h2, (c[0] * L.CLASSES + c[1]) * L.CLASSES + c[2]]
            want = [int(L.mix64(np.array([(x + (i << 56)) % 2**64], np.uint64))[0]) >> 32 for i, x in enumerate(xs)]
            assert t.keys[:, start + k].tolist() == want
