from brute import url
from conftest import FOLDER

from emberlog.llm import queries, urls

RULES = [r for r, _ in urls.RULES]
URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "ftp://u@b.net:80/",
    "https://www.Example.net/en/1?x=/#y", "https://example.net/EN/1", "https://example.com/de/", "https://a.org/fr/x\ny",
    "https://a.org?x=/fr/", "x://y://net/z", "http://example.net/en", "http://org/fr/#a", "http://é.org/fr/", "http://a.b/" + "c" * 20_000,
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, rule string")
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == url(URLS[r["page_id"]], RULES), URLS[r["page_id"]]
        if r["rule"]:
            assert r["verdict"] == dict(urls.RULES)[r["rule"]]
        assert r["verdict"] in ("allow", "block")


def test_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op3_url_filter(spark, FOLDER).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows} == {i: url(u, RULES) for i, u in pages.items()}


def test_model_separates(spark):
    """Addresses no rule fits follow the side whose addresses they resemble."""
    good = [f"http://news.org/fr/story-{i}" for i in range(200)]
    bad = [f"http://cheap-pills{i}.net/buy-now" for i in range(200)]
    new = [(f"http://news.info/story-{i}", "allow") for i in range(20)] + [(f"http://cheap-pills{i}.biz/buy-now", "block") for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(good + bad + [u for u, _ in new])), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages).collect()}
    hits = sum(got[400 + i] == v for i, (_, v) in enumerate(new))
    assert hits >= 38


def test_model_sums_to_the_backed_off_probability(spark):
    """The differences of the model add up to the log ratio of the longest
    contexts, as a plain recursion computes it."""
    import math
    from collections import Counter

    rows = [("http://abab.net/", True)] * 5 + [("http://abba.net/", False)] * 4 + [("http://baba.net/x", True)] * 3
    data = spark.createDataFrame(rows, "url string, accepted boolean")
    model = urls.train(data)

    order = urls.ORDER

    def codes(u):
        return [0] * order + [ord(c) for c in u.split("://", 1)[1]]

    counts = {True: Counter(), False: Counter()}
    for u, side in rows:
        c = codes(u)
        for i in range(order, len(c)):
            for k in range(order + 1):
                counts[side][tuple(c[i - k : i + 1])] += 1
    kinds = len({g for s in counts for g in counts[s] if len(g) == 1})
    ctx = {s: Counter() for s in counts}
    for s in counts:
        for g, n in counts[s].items():
            ctx[s][(len(g), g[:-1])] += n

    def prob(s, gram):
        k = len(gram) - 1
        if not k:
            return (counts[s][gram] + 1) / (ctx[s][(1, ())] + kinds + 1)
        lower = prob(s, gram[1:])
        if ctx[True][(k + 1, gram[:-1])] + ctx[False][(k + 1, gram[:-1])] < urls.MIN_CONTEXT:
            return lower
        return (counts[s][gram] + urls.BETA * lower) / (ctx[s][(k + 1, gram[:-1])] + urls.BETA)

    for u in ("http://abab.net/x", "http://bbab.net/", "http://abba.net/x"):
        c = codes(u)
        want = sum(math.log(prob(True, tuple(c[i - order : i + 1])) / prob(False, tuple(c[i - order : i + 1])))
                   for i in range(order, len(c)))
        got = urls.scored(spark.createDataFrame([(u,)], "url string"), model).first()["score"]
        assert abs(got - want / (len(c) - order)) < 1e-9


def test_digits_and_signs_count(spark):
    """Addresses that differ in digits or query signs only."""
    rows = [(f"http://a.org/v{i % 7}?k=1", True) for i in range(70)] + [(f"http://a.org/v9{i % 7}&k:2", False) for i in range(70)]
    model = urls.train(spark.createDataFrame(rows, "url string, accepted boolean"))
    new = spark.createDataFrame([("http://a.org/v3?k=1",), ("http://a.org/v93&k:2",)], "url string")
    got = {r["url"]: r["score"] for r in urls.scored(new, model).collect()}
    assert got["http://a.org/v3?k=1"] > 0 > got["http://a.org/v93&k:2"]


def test_shuffled_model_gives_the_same(spark):
    rows = [(f"http://n{i}.org/fr/é{i}", i % 3 == 0) for i in range(60)]
    data = spark.createDataFrame(rows, "url string, accepted boolean")
    model = urls.train(data)
    want = {r["url"]: r["score"] for r in urls.scored(data, model).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["url"]: r["score"] for r in urls.scored(data, model).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
