import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import substrings as S


def brute(rows):
    """(doc_id, text) -> words, removed and digest, by a walk in order of ids."""
    seen, out = set(), {}
    key = lambda r: (-(2**63) if r[0] is None else r[0])
    for i, t in sorted({(r[0], r[1] or "") for r in rows}, key=key):
        w = t.encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - S.SPAN + 1):
            k = tuple(w[a : a + S.SPAN])
            if k in seen:
                gone[a : a + S.SPAN] = [True] * S.SPAN
            seen.add(k)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [400_000, 150, 151])
def test_equals_a_walk(spark, docs, corpus, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_WORDS", chunk)
    if chunk == 151:  # sequences that go on over many batches
        monkeypatch.setattr("ledgerflow.llm.common.BATCH_BYTES", ("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    want = brute(corpus)
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.judged(docs).collect()), key=repr)
    assert rows == sorted(((r[0], *want[r[0], r[1] or ""]) for r in corpus), key=repr)
    assert sum(r[2] for r in rows) > 1000


def test_texts_lose_their_repeats(docs, corpus):
    want = brute(corpus)
    got = S.deduplicated(docs)
    assert got.columns == docs.columns and got.count() == len(corpus)
    for r in got.select("doc_id", "text", "n_chars").collect():
        if r.doc_id is not None:
            old = next(c[1] for c in corpus if c[0] == r.doc_id)
            n, gone, sha = want[r.doc_id, old or ""]
            assert r.text == old if not gone else hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == sha
            assert r.n_chars == (None if old is None else len(r.text))


def test_nothing(no_docs):
    assert S.judged(no_docs).count() == 0 and S.deduplicated(no_docs).count() == 0


def test_clashing_names_and_refused_ids(docs):
    odd = docs.select("*", *[F.lit(7).alias(c) for c in ("_k1", "_k2", "_l1", "_l2", "_lost", "a.b")])
    got, want = S.deduplicated(odd), S.deduplicated(docs)
    assert got.columns == odd.columns and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, want.select("doc_id", "text").collect()))
    with pytest.raises(TypeError, match="whole numbers"):
        S.drawn(docs.withColumn("doc_id", F.lit("x")))
