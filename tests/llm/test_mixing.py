from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import mixing as M


def test_targets():
    assert M.targets_for([100, 100, 100], [5, 2, 1], 450) == [200, 500 / 3, 250 / 3]
    assert M.targets_for([10, 1000], [5, 2], 1515) == [20, 1495] and M.targets_for([], [], 0) == [] and M.targets_for([0, 10], [1, 1], 15) == [0, 15]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    there = M.permuted(np.arange(n), n, 99)
    assert sorted(there) == list(range(n)) and (M.permuted(there, n, 99, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("size", [1, 10, 63, 64, 65, 1000])
def test_slots_take_the_target(spark, size):
    for target in {1, size // 2, size - 1, size, size + 1, 2 * size - 1, 2 * size} - {0}:
        n, cut = M.slots_of(0, size, target)
        blocks = -(-size // M.BLOCK)
        rows = M.slots(spark, [{"size": size, "target": target, "blocks": blocks, "slots": n, "cut": cut}]).collect()
        assert sum(r.upto for r in rows) == target and all(r.upto > 0 for r in rows) and len(rows) == n <= 2 * blocks


def test_hypergeometric_law():
    import math

    good, bad, take = 7, 5, 6
    p = [math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) for k in range(7)] + [0.0]
    u = (np.arange(100_000) + 0.5) / 100_000
    got = np.bincount([M.hypergeometric(x, good, bad, take) for x in u[::10]], minlength=8) / 10_000
    assert np.abs(got - p).max() < 1e-3 and M.hypergeometric(0.3, 5, 0, 3) == 3 and M.hypergeometric(0.3, 0, 5, 3) == 0
    rng = np.random.default_rng(1)  # the same law for any size: mean and deviation
    x = np.array([M.hypergeometric(rng.random(), 3 * 10**10, 7 * 10**10, 10**10) for _ in range(200)])
    assert abs(x.mean() - 3e9) < 5 * 43474 / 200**0.5 and 0.8 < x.std() / 43474 < 1.2


def test_clashing_names_and_refused_ids(spark, docs):
    odd = docs.select("*", *[F.lit(7).alias(c) for c in ("_d1", "_d2", "_k1", "_k2", "_parts", "a.b", "piece", "no", "size")])
    assert M.mixed_documents(odd).columns == odd.columns and M.mixed_documents(odd).count() == M.mixed_documents(docs).count()
    with pytest.raises(TypeError, match="whole numbers"):
        M.plan(docs.withColumn("doc_id", F.lit("x")))


def test_shards_add_up():
    counts = [1000, 0, 37, 5]
    parts = [M.shard_counts(s, 9, counts) for s in range(9)]
    assert sum(p[0] for p in parts).tolist() == counts and all((parts[i][1] + parts[i][0] == parts[i + 1][1]).all() for i in range(8))
    assert max(p[0].sum() for p in parts) - min(p[0].sum() for p in parts) <= 1


def spread(docs):
    placed, sources = M.plan(docs)
    rows = M.mixed(placed, sources).collect()
    return sorted((r.k1, r.start, r.epoch, r.first, r.length) for r in rows), sources


def test_mix(docs, corpus):
    a, sources = spread(docs)
    b, _ = spread(docs.repartition(3))
    assert a == b, "reruns agree, however the rows are dealt"
    size = Counter()
    for r in corpus:
        size[r[3]] += len((r[1] or "").encode().split())
    assert [s["source"] for s in sources] == ["s0", "s1", None] and {s["source"]: s["size"] for s in sources} == dict(size)
    assert sum(s["target"] for s in sources) == pytest.approx(1.5 * sum(size.values()))
    taken = M.mixed(*M.plan(docs)).groupBy("no").sum("length").collect()
    for r in taken:
        assert r[1] == round(sources[r.no]["target"])


def test_documents_take_what_the_plan_says(docs, corpus):
    words = Counter()
    for r in M.mixed_documents(docs).collect():
        n = len(r.text.encode().split())
        assert r.n_chars == len(r.text) and n
        words[r.doc_id] += n
    most = Counter()
    for r in corpus:
        most[r[0]] += 2 * len((r[1] or "").encode().split())
    assert all(words[k] <= most[k] for k in words) and M.mixed_documents(docs).columns == docs.columns
    want = M.mixed(*M.plan(docs)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in want} == dict(words)


def test_excerpts():
    assert M.excerpt(" a b\n c d ", [(0, 2), (2, 2)]) == " a b\n c d " and M.excerpt("a b\nc d", [(3, 1), (0, 2)]) == "a b\nd"


def test_nothing(no_docs):
    assert M.mixed_documents(no_docs).count() == 0
