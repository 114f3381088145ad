from pyspark.sql import functions as F

from tidewatch.llm import urlfilter as K

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en/", "https://a.example.com/EN/", "https://a.example.com/en", "http://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://x.org/en/",
    "http://ex://ample.com/en/", "http://É.com/é?x", "http://a.com?x/en/", "http://a.com#/en/", "http://.com/", "http://com./", "http://" + "a." * 3000 + "net/es/" + "b" * 9000, "http://x.net/es/1", "http://com/\nen/",
]


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def check(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit("clash"), "key": F.lit("clash")})
    got = {r.page_id: tuple(r)[1:] for r in K.judge(df, rules).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}


def test_rules(spark):
    check(spark, URLS, K.RULES)


def test_many_rules(spark):
    rules = [K.Rule("block" if k % 3 else "allow", f"h{k}.org", "/" if k % 2 else "/p") for k in range(150)]
    check(spark, [f"http://{s}h{k}.org/{p}" for k in range(0, 200, 3) for s in ("", "w.") for p in ("", "page", "x")], rules)


def test_cascade_is_exact(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{k}" for k in range(0, 30_000, 61)]
    levels = K.build_cascade(universe, listed, 30_000)
    assert len(levels) > 1
    assert sorted(r.key for r in universe.where(K.contains(F.col("key"), levels)).collect()) == sorted(listed)
    assert K.build_cascade(universe, [], 30_000) == []
    assert universe.where(K.contains(F.col("key"), [])).isEmpty()
    # an estimate that is far too low costs bits and not exactness
    assert sorted(r.key for r in universe.where(K.contains(F.col("key"), K.build_cascade(universe, listed, 1))).collect()) == sorted(listed)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id bigint, url string")
    assert K.judge(df).isEmpty()
    assert "Python" not in K.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string").limit(1))._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
