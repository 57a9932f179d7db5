import numpy as np

from ledgerflow.llm import urls as U


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s] or [len(s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for _, r in U.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fit, key=len, default=None)


def test_rules(spark):
    urls = ["http://Example.COM/en/x?q", "https://www.example.com/en/1", "http://a.net/fr/", "http://a.net/fr", "http://com", "http://com/", "http://x.com?y/", "no scheme", None, "", "://", "a://b://c/d#e", "http://notcom/", "http://ÄB.net/es/ü", "http://u@h.example.com:80/en/", "http://www.example.com/en"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host int")
    rows = U.judged(df).orderBy("page_id").collect()
    verdict = {r: v for v, r in U.RULES}
    for r, u in zip(rows, [*urls, urls[0]]):
        assert (r.host, r.path, r.rule) == plain(u) and r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdict[r.rule])


def test_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.random((2000, len(U.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    t = U.BoostedTrees(x[:1000], y[:1000])
    assert ((t.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert (U.BoostedTrees(x, np.ones(2000)).score(x) < 0.5).all()


def test_held_out_urls(spark):
    rows = U.parsed(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).filter("_given is not null").collect()
    x = lambda part: np.array([[*U.lexical(r.url, r.host, r.path), 0.0] for r in part])
    y = np.array([float(r._given == "block") for r in rows])
    half = len(rows) // 2
    t = U.BoostedTrees(x(rows[:half]), y[:half])
    assert ((t.score(x(rows[half:])) > 0.5) == y[half:]).mean() > max(y.mean(), 1 - y.mean())


def test_nothing(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_one_url_often_and_many_suffixes(spark):
    """A URL that repeats counts once in the sample; every suffix has its share."""
    rows = [(i, "http://a.com/x") for i in range(3000)] + [(i, f"http://h{i}.com/{i}") for i in range(50)] + [(i, f"http://h{i}.net/fr/{i}") for i in range(50)] + [(0, None)]
    known = U.parsed(spark.createDataFrame(rows, "page_id long, url string"))
    shares = {r._s: r._share for r in U.with_shares(known).selectExpr("substring_index(host, '.', -1) as _s", "_share").distinct().collect()}
    overall = 51 / 3102
    assert abs(shares["com"] - 10 * overall / 3060) < 1e-12 and abs(shares["net"] - (50 + 10 * overall) / 60) < 1e-12 and shares[""] == overall
    assert U.fit(U.with_shares(known)).trees
