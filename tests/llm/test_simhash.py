import random
from itertools import combinations

import pytest
import xxhash

from ledgerflow.llm import simhash as S
from ledgerflow.llm.components import components


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_query_equals_brute_force(docs, corpus):
    fps = {plain(r[1]) for r in corpus}
    root = roots([(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2], fps)
    least = {}
    for r in corpus:
        if r[0] is not None:
            k = root[plain(r[1])]
            least[k] = min(r[0], least.get(k, r[0]))
    want = sorted(((r[0], plain(r[1]), least.get(root[plain(r[1])])) for r in corpus), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.grouped(docs).collect()), key=repr) == want


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("radius", [1, 2])
def test_links_lose_no_pair(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    fps |= {0, 2**64 - 1, 2**63, 2**63 | 1}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = roots([(r.u, r.v) for r in S.links(df, radius).collect()], {signed(x) for x in fps})
    want = roots([(signed(a), signed(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= radius], {signed(x) for x in fps})
    same = lambda r: {frozenset(n for n in r if r[n] == k) for k in set(r.values())}
    assert same(got) == same(want)


def test_masks_cover_every_pair():
    m = [x % 2**64 for x in S.masks(2)]
    assert len(m) == 7 and all(any(not x >> a & 1 and not x >> b & 1 for x in m) for a, b in combinations(range(64), 2))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5001), (-3, -2), (7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    want = {k: v for k, v in roots(edges, {x for e in edges for x in e}).items() if k != v}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    monkeypatch.setattr("ledgerflow.llm.components.FEW", few)
    rng = random.Random(few)
    edges = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1500)] + [(3000 + i, 3001 + i) for i in range(300)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {k: v for k, v in roots(edges, {x for e in edges for x in e}).items() if k != v}


def test_few_edges_cost_the_driver_few_jobs(spark):
    # each round is planned, and its small tables broadcast, by the driver
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long").repartition(5)
    spark.sparkContext.setJobGroup("few-edges", "")
    try:
        components(edges)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 6
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(40):
        w = [word() for _ in range(rng.randint(60, 300))] + passage
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for at in rng.sample(range(len(v)), int(len(v) * rng.choice([0, 0.005, 0.015, 0.05]))):
                v[at] = word()
            rows.append((len(rows), " ".join(v)))
    rng.shuffle(rows)
    cut = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}, plain(t)) for i, t in rows]
    near = [(a[0], b[0]) for a, b in combinations(cut, 2) if len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]) or (a[2] ^ b[2]).bit_count() <= 2]
    want = roots(near, [i for i, _ in rows])
    got = {r.doc_id: r.component_id for r in S.near_grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and 40 <= len(set(want.values())) < len(rows)


def test_one_of_each_group_stays(docs):
    got = S.deduplicated(docs)
    kept = [r.doc_id for r in got.collect()]
    groups = {(r.doc_id, r.component_id) for r in S.near_grouped(docs).collect() if r.doc_id is not None}
    assert got.columns == docs.columns and sorted(k for k in kept if k is not None) == sorted({c for _, c in groups}) and kept.count(None) == 2


def test_nothing(no_docs):
    assert S.grouped(no_docs).count() == 0 and S.deduplicated(no_docs).count() == 0
