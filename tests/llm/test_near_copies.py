import random
from itertools import combinations

from ledgerflow.llm import near_copies as N
from ledgerflow.llm import simhash as S
from ledgerflow.llm.components import components


def words(rng, n):
    return ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n)]


def brute(texts):
    """Texts by component of all pairs with four fifths of their shingles in common."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    return {frozenset(t for i, t in enumerate(texts) if top(i) == k) for k in {top(i) for i in range(len(texts))}}


def linked(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    name = {r.t: r.text for r in docs.select(S.text_hash("text").alias("t"), "text").collect()}
    roots = {r.u: r.v for r in components(N.near_links(N.sketches(docs, S.fingerprint))).collect()}
    groups = {}
    for t in name:
        groups.setdefault(roots.get(t, t), set()).add(name[t])
    return {frozenset(g) for g in groups.values()}


def test_shared_passage_hides_no_pair(spark):
    rng = random.Random(5)
    passage, texts = words(rng, 260), []
    for _ in range(500):  # strangers have 0.72 of their shingles in common
        own = words(rng, 50)
        other = list(own)
        other[10], other[40] = words(rng, 2)
        texts += [" ".join(passage + own), " ".join(passage + other)]
    want = brute(texts)
    assert len(want) == 500 and linked(spark, texts) == want


def test_repeated_line_hides_no_pair(spark):
    rng, texts = random.Random(6), []
    for _ in range(50):
        own, line = words(rng, 300), words(rng, 10)
        texts += [" ".join(own + line * 25), " ".join(own + line * 2)]
    want = brute(texts)
    assert len(want) == 50 and linked(spark, texts) == want


def test_passages_of_several_lengths_and_edits(spark, monkeypatch):
    rng, texts = random.Random(9), [None, "", " \n", "three words only", "one two three four five", "one two three four five"]
    passages = [words(rng, k) for k in (260, 120, 60)]
    for _ in range(150):
        own = words(rng, rng.choice([50, 70, 100]))
        base = own + words(rng, 200) if rng.random() < 0.2 else rng.choice(passages) + own
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 1, 5])):
            other = list(base)
            for _ in range(rng.randrange(1, 14)):
                k = rng.randrange(len(other))
                other[k : k + rng.randrange(2)] = words(rng, rng.randrange(3))
            texts.append(" ".join(other))
    want = {g for g in brute([t for t in texts if t]) if len(g) > 1}
    assert len(want) > 20
    for rows in (N.CELL_ROWS, 40):  # frequent keys in one cell, and dealt over many
        monkeypatch.setattr(N, "CELL_ROWS", rows)
        assert {g for g in linked(spark, texts) if len(g) > 1} == want


def test_no_documents(spark, no_docs):
    assert N.near_links(N.sketches(no_docs, S.fingerprint)).count() == 0
