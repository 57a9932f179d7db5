from collections import Counter

import numpy as np
import pytest

from ledgerflow.llm import quality as Q


def plain(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(docs, corpus):
    texts = [r[1] for r in corpus] + ["a\nb\na\n\n \n \nb", "# * a|b <p> & $ %"]
    got, _ = Q.rule_statistics([(t or "").encode() for t in texts])
    assert [tuple(map(int, r)) for r in got] == [plain(t) for t in texts]


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, len(Q.FEATURES)))
    f = Q.IsolationForest(x, np.full(len(Q.FEATURES), 20.0))
    assert f.score(x + 12).min() > np.quantile(f.score(x), 0.99) and (f.score(x) == Q.IsolationForest(x, np.full(len(Q.FEATURES), 20.0)).score(x)).all()


def test_threshold():
    assert Q.threshold([(100, True, 1000), (1500, False, 10), (1600, True, 1)]) == 101 / Q.BINS
    assert Q.threshold([]) == float("inf") == Q.threshold([(5, True, 3)])


@pytest.fixture(scope="module")
def sf(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels")]


def test_labelled_documents(spark, sf):
    docs, labels = sf
    rows = Q.judged(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1
    kept = {r.doc_id for r in Q.filtered(docs, labels).collect()}
    assert kept == {r.doc_id for r in Q.judged(docs, labels).filter("kept").collect()} and Q.filtered(docs, labels).columns == docs.columns


def test_edges(spark, docs, corpus, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = Q.judged(docs, labels).collect()
        assert len(rows) == len(corpus) and all(not r.kept for r in rows if r.n_words < Q.MIN_WORDS)
    assert Q.judged(no_docs, none).count() == 0 and Q.filtered(no_docs, none).count() == 0


def test_more_words_than_21_bits_number():
    n = (1 << 21) + 20
    text = b" ".join(b"%d" % i for i in range(n))
    counts, _ = Q.rule_statistics([text, b"a b c a b c"])
    assert counts[0].tolist()[0] == n and counts[0, 4] == 0 and counts[1, 4] == 6
