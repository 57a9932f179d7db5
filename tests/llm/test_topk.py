import math
import random

from ledgerflow.llm import topk as K

VEC = "vec_id long, embedding array<float>, label int, dim int"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        best = {}
        for i, v in ok:
            for j, u in ok:
                if i == q and j != q and len(u) == len(v):
                    s = sum(a * b for a, b in zip(u, v))
                    best[j] = max(s, best.get(j, s))
        out += [(q, r, j, s) for r, (s, j) in enumerate(sorted(((s, j) for j, s in best.items()), key=lambda t: (-t[0], t[1]))[:k], 1)]
    return out


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda n=8: [round(rng.gauss(0, 1), 2) for _ in range(n)]
    rows = [(i, vec(), 0, 0) for i in range(300)]
    rows += [(400 + i, rows[5][1], 0, 0) for i in range(30)] + [rows[7], (50, vec(), 0, 0), (900, None, 0, 0), (950, [None] * 8, 0, 0), (1000, [float("nan")] * 8, 0, 0), (1050, [float("inf")] * 8, 0, 0), (None, vec(), 0, 0)]
    rows += [(1100, vec(3), 0, 0), (1101, vec(3), 0, 0), (1150, [], 0, 0), (1151, [], 0, 0)]
    df = spark.createDataFrame(rows, VEC).repartition(6)
    monkeypatch.setattr(K, "BLOCK_ROWS", 37)
    monkeypatch.setattr(K, "QUERY_ROWS", 3)
    monkeypatch.setattr(K, "CELL_ROWS", 50)
    got = sorted(tuple(r) for r in K.top_k(df.filter("vec_id % 50 = 0"), df).collect())
    assert got == sorted(brute(rows))


def test_nothing(spark):
    df = spark.createDataFrame([], VEC)
    assert K.top_k(df, df).count() == 0
