from ledgerflow.llm import token_counts as C


def test_equals_brute_force(docs, corpus, monkeypatch):
    import public_tokenizers

    enc = C._encoder(C.vocabulary(), public_tokenizers.PATTERN)
    lengths = sorted(len(enc.encode_ordinary(r[1] or "")) for r in corpus)
    hist = C.histogram(C.encoded_lengths(docs))
    monkeypatch.setattr(C, "BLOCK", 16)
    rows = C.context_limits(hist).orderBy("tokens").collect()
    assert [r.tokens for r in rows] == sorted(set(lengths))
    for r in rows:
        below = [x for x in lengths if x <= r.tokens]
        assert (r.n_docs, r.docs_le, r.docs_gt) == (lengths.count(r.tokens), len(below), len(lengths) - len(below))
        assert (r.tokens_le, r.total_tokens, r.truncated_tokens) == (sum(below), sum(lengths), sum(min(x, r.tokens) for x in lengths)) and r.quantile == len(below) / len(lengths)
    assert tuple(C.at_limit(hist, 33).first()) == (33, len(lengths), sum(lengths), sum(x > 33 for x in lengths), sum(min(x, 33) for x in lengths))


def test_groups(docs, corpus):
    rows = C.context_limits(C.histogram(C.encoded_lengths(docs, keep=("source",)), ("source",)), ("source",)).collect()
    for s in ("s0", "s1", None):
        assert sum(r.n_docs for r in rows if r.source == s) == sum(c[3] == s for c in corpus)


def test_nothing(no_docs):
    hist = C.histogram(C.encoded_lengths(no_docs))
    assert C.context_limits(hist).count() == 0 and tuple(C.at_limit(hist, 5).first()) == (5, 0, 0, 0, 0)
