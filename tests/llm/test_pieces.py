import random

import pytest

from ledgerflow.llm import pieces as P
from ledgerflow.llm.token_counts import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_the_librarys(docs, corpus, library):
    got = sorted(((r.doc_id, tuple(r.ids), r.n_tokens) for r in P.encoded(docs, PATH).collect()), key=repr)
    want = [(r[0], tuple(library.encode(r[1] or ""))) for r in corpus]
    assert got == sorted(((i, ids, len(ids)) for i, ids in want), key=repr)


def test_rare_units_fold_alike(docs, corpus, monkeypatch):
    whole = sorted((tuple(r) for r in P.encoded(docs, PATH).collect()), key=repr)
    monkeypatch.setattr(P, "HEAD", 20)
    assert sorted((tuple(r) for r in P.encoded(docs, PATH).collect()), key=repr) == whole


def test_random_texts(library):
    rng, p = random.Random(5), P.pieces_at(PATH)
    for _ in range(2000):
        t = "".join(rng.choices("ab the▁ \n\tñ日本0", k=rng.randint(0, 150)))
        assert [i for u in p.units(t) for i in p.fold(u)] == library.encode(t)


def test_round_trip(spark, docs, corpus):
    rows = P.encoded(docs, PATH)
    assert all(r.round_trip for r in rows.collect())
    texts = sorted(r.text for r in P.decoded(rows, PATH).collect())
    assert texts == sorted(r[1] or "" for r in corpus)


def test_viterbi_fold(spark, monkeypatch):
    p = P.Pieces(PATH)
    p.bpe = False
    monkeypatch.setitem(P._loaded, PATH, p)
    units = ["▁there", "▁ñan.", "日", "xyzzy", "▁", "1234"]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    assert {r.unit: r.ids for r in P.folded(P.lattice(df, PATH), PATH).collect()} == {u: p.fold(u) for u in units}


def test_nothing(no_docs):
    assert P.encoded(no_docs, PATH).count() == 0
