from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerflow.llm import mixing, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"
STAGE = dict(P.STAGES)


def words(text):
    return (text or "").encode().split()


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of the one before."""
    out, now = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = rows_of(now)
    for name, stage in P.STAGES:
        now = P.written(stage(spark, now, SF), "stage-brute")
        out[name] = rows_of(now) if name in ("quality_rules", "near_dedup", "substring_dedup") else now.collect()
    return out


def test_quality_against_the_query(spark, stages):
    kept = {r.doc_id for r in queries.QUERIES["op9_quality_rules"](spark, SF).collect() if r.kept}
    assert set(stages["quality_rules"]) == kept


def test_near_dedup_against_all_pairs(stages):
    texts = {i: r.text for i, r in stages["quality_rules"].items()}
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    low = {i: [bytes(w).lower() for w in words(t)] for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in low.items()}
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(texts, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2 or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    assert set(stages["near_dedup"]) == {top(i) for i in texts}


def test_substring_dedup_against_all_windows(stages):
    seen, before = set(), stages["near_dedup"]
    for i in sorted(before):
        w = words(before[i].text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        assert words(stages["substring_dedup"][i].text) == [x for x, g in zip(w, gone) if not g]


def test_mix_and_codes_against_plain_ones(stages):
    import sentencepiece

    before, mix = stages["substring_dedup"], stages["mix_sources"]
    size = Counter()
    for r in before.values():
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    target = mixing.targets_for([size[x] for x in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()))
    taken = Counter()
    for r in mix:
        own, part = words(before[r.doc_id].text), words(r.text)
        taken[r.source] += len(part)
        assert part and not Counter(part) - Counter(own)
    assert [taken[x] for x in names] == [round(t) for t in target]
    s = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary("piece_bpe_32k.model"))
    assert sorted((r.doc_id, list(r.ids)) for r in stages["sentencepiece"]) == sorted((r.doc_id, s.encode(r.text)) for r in mix)


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables_and_odd_columns(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in ("a.b", "_keep", "_k1", "_t", "_lost", "_parts", "_quality", "t", "u", "v", "root", "features")})
    got = STAGE[name](spark, docs.limit(0), SF)
    assert got.count() == 0 and (name == "sentencepiece" or got.columns == docs.columns)
    got = STAGE[name](spark, docs, SF)
    assert got.count() > 0 and (name == "sentencepiece" or got.columns == docs.columns)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, now = docs.columns, docs
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "sentencepiece"]
    for _, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, sf), "stage-test")
        assert now.columns == before and 0 < now.count() and {r.doc_id for r in now.collect()} <= {r.doc_id for r in docs.collect()}
    last = P.STAGES[-1][1](spark, now, sf)
    run = P.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert key(run) == key(last) and all(r.round_trip for r in run.collect())


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
