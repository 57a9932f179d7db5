"""Every opN_ query over whole tables of the smallest scale, all columns against brute force or its SQL."""

import math
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from ledgerflow.llm import language_model, mixing, quality, queries, token_counts, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def texts(base):
    return {i: t or "" for i, t in base.sql("select doc_id, text from documents").fetchall()}


def run(spark, number):
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    return name, queries.QUERIES[name](spark, SF)


def words(text):
    return text.encode().split()


@pytest.mark.parametrize("number", [1, 2, 7])
def test_queries_with_sql(spark, base, number):
    name, df = run(spark, number)
    want = base.sql(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(map(str, want.fetchall()))


def test_op3(spark, texts):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in run(spark, 3)[1].collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        ids = s.encode(t)
        assert list(rows[i].ids) == ids and rows[i].n_tokens == len(ids) and rows[i].round_trip == (s.decode(ids) == t or "▁" not in t)


def test_op4(spark, texts):
    def fingerprint(t):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.decode()).encode() for x in words(t)]
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fingerprint(t) for i, t in texts.items()}
    up = {i: i for i in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, 4)[1].collect()}
    assert got == {i: (f"{fps[i]:016x}", top(i)) for i in fps}


def test_op5(spark, texts):
    tokens = {i: [x.lower() for x in words(t)] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(x for i in texts if not held[i] for x in [*tokens[i], None])
    n, v = sum(c.values()), len(c)
    rows = run(spark, 5)[1].collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = [*tokens[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), abs=1e-6)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op6(spark, texts):
    import public_tokenizers

    enc = token_counts._encoder(token_counts.vocabulary(), public_tokenizers.PATTERN)
    n = np.array([len(enc.encode_ordinary(t)) for t in texts.values()])
    for r in (rows := run(spark, 6)[1].collect()):
        want = (n == r.tokens).sum(), (n <= r.tokens).sum(), (n > r.tokens).sum(), n[n <= r.tokens].sum(), np.minimum(n, r.tokens).sum(), n.sum()
        assert (r.n_docs, r.docs_le, r.docs_gt, r.tokens_le, r.truncated_tokens, r.total_tokens) == want and r["quantile"] == pytest.approx(want[1] / len(n))
    assert sorted(r.tokens for r in rows) == sorted(set(n.tolist()))


def test_op8(spark, base):
    from test_urls import plain

    pages = dict(base.sql("select page_id, url from pages").fetchall())
    rows = run(spark, 8)[1].collect()
    verdict = {r: v for v, r in urls.RULES}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert (r.host, r.path, r.rule) == plain(pages[r.page_id]) and r.verdict == (verdict[r.rule] if r.rule else "block" if r.block_score > 0.5 else "allow")


def test_op9(spark, texts):
    from test_quality import plain

    rows = run(spark, 9)[1].collect()
    stats = {i: quality.rule_statistics([t.encode()]) for i, t in texts.items()}
    forest, most = quality.fit(quality.statistics(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        counts = tuple(plain(texts[r.doc_id]))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        score = float(forest.score(stats[r.doc_id][1])[0])
        assert tuple(r[c] for c in quality.COUNTS) == counts and r.base_failed == failed and r.anomaly == pytest.approx(score) and r.kept == (not failed and r.anomaly < most)


def test_op10(spark, base, texts):
    source = dict(base.sql("select doc_id, source from documents").fetchall())
    size = {i: len(words(t)) for i, t in texts.items()}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda x: (x is None, x or ""))
    target = dict(zip(names, mixing.targets_for([total[x] for x in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(total.values()))))
    rows, again = (sorted(map(tuple, run(spark, 10)[1].collect())) for _ in range(2))
    assert rows == again and [r[0] for r in rows] == sorted(texts)
    taken = Counter()
    for i, n, of, t, k in rows:
        assert (n, of) == (size[i], total[source[i]]) and t == pytest.approx(target[source[i]]) and 0 <= k <= 2 * n
        taken[source[i]] += k
    assert {x: taken[x] for x in names} == {x: round(target[x]) for x in names}


def test_score_is_what_its_weights_say(spark):
    """The model's log10 probability of texts, by a plain reading of its definition."""
    lm = language_model
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}ing" for k in range(1, 40))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    model, counts, n, v = lm.fit(docs, docs.doc_id < 50)
    c = {None if r.token is None else bytes(r.token): r.c for r in counts.collect()}
    totals, distinct = Counter(), Counter()
    for x, k in c.items():
        totals[lm.END if x is None else lm.class_of(x)] += k
        distinct[lm.END if x is None else lm.class_of(x)] += 1

    def score(text):
        own = [x.lower() for x in words(text or "")] + [None]
        t = lm._Tokens([(text or "").encode()])
        out = 0.0
        for k, x in enumerate(own):
            z = model.bias.astype(float) + sum(model.w[r].astype(float) for r in t.rows[:, k])
            y = lm.END if x is None else lm.class_of(x)
            out += (z[y] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
            if x is not None:
                out += math.log10((c.get(x, 0) + 0.5) / (totals[y] + 0.5 * (distinct[y] + 1)))
        return out

    from pyspark.sql import functions as F

    got = {r.doc_id: r.score for r in lm.scored(docs, F.col("doc_id") >= 50).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(score(r.text), rel=1e-3)
