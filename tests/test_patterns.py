import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import patterns as P
from tidewatch.functions.intel import IntelGroups


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("evil\\.com", "evil.com"), ("a[bc]defg?h", "def"), ("(abc|abd)x", None), ("x(?:abc)y", "xabcy"), ("(abcd)+z", "abcd"), ("(abc)?defg", "defg"), ("ab", None), ("(?i)abcdef", None), ("[a-z&&[^b]]abcdef", None), ("abc\\Qd.e\\E", None), ("abc\\101def", None), ("abc{2}", None), ("*bad", None), ("^abc$", "abc"), ("abc|", None), ("été.*ß12", "été")],
)
def test_what_a_match_must_contain(pattern, want):
    assert P.required(pattern) == want


def groups(spark, contents, kind):
    rows = [("g", "g", "string", kind, c) for c in contents]
    return IntelGroups(spark.createDataFrame(rows, "group_id string, name string, type string, intelligence_type string, content string"), patterns=True, literal_limit=0)


CONTENTS = ["evil\\.com", "www\\.[a-z]+\\.net", "(?i)upper", "x+", "a.c", "abc(def)?", "\\d{3}-long-literal-\\d", "été", "long literal here", "same gram 1", "same gram 2"]
VALUES = ["http://evil.com/a", "evil.com", "evilxcom", "www.abc.net", "www.1.net", "UPPER", "xx", "abc", "abcdef", "123-long-literal-4", "", None, "l'été", "a long literal here.", "same gram 2", "same gram 3", "x" * 5000 + "evil.com"]


@pytest.mark.parametrize("kind", ["url", "hash"])
def test_same_as_trying_every_pattern(spark, kind):
    df = spark.createDataFrame(list(enumerate(VALUES)) + [(1, "evil.com")], "id int, v string").withColumns({c: F.lit("clash") for c in ("text", "gram", "pattern", "n")})
    hit = lambda v: v is not None and any((re.fullmatch if kind == "url" else re.search)(c, v) for c in CONTENTS)
    got = groups(spark, CONTENTS, kind).mark(df, "v", "g", "hit")
    assert sorted((r.id, r.hit) for r in got.collect()) == sorted([(i, hit(v)) for i, v in enumerate(VALUES)] + [(1, hit("evil.com"))])
    assert got.count() == len(VALUES) + 1 and got.columns == [*df.columns, "hit"]


def test_plan_doesnt_grow(spark):
    """A hundred thousand patterns have the plan of a hundred."""
    df = spark.range(20_000).select(F.col("id"), F.concat(F.lit("host"), "id", F.lit(".example.org/x")).alias("v"))

    def marked(n):
        table = spark.range(n).select(F.lit("g").alias("group_id"), F.lit("g").alias("name"), F.lit("string").alias("type"), F.lit("hash").alias("intelligence_type"), F.concat(F.lit("host"), F.col("id") * 3, F.lit("\\.example\\.(org|net)/[x-z]")).alias("content"))
        return IntelGroups(table, patterns=True).mark(df, "v", "g", "hit")

    size = lambda x: len(re.sub(r"[0-9]+", "", x._jdf.queryExecution().optimizedPlan().toString()))
    large = marked(100_000)
    assert abs(size(large) - size(marked(1000))) < 20
    assert large.where("hit").count() == 20_000 // 3 + 1


def test_index_asks_for_rare_grams_once(spark):
    """The gram is chosen where patterns are read, without dealing out all their grams; one pattern in a hundred shares a gram at most."""
    contents = spark.range(20_000).select(F.concat(F.lit("https?://shop\\.example/o"), F.col("id") + 1_000_000, F.lit("/u[0-9]{1,2}")).alias("pattern"))
    by_gram, rest = P.index(contents)
    plan = by_gram._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and rest.count() == 0
    assert by_gram.count() == 20_000 and by_gram.groupBy("gram").count().agg(F.max("count")).first()[0] <= 200


def test_each_number_is_looked_up_whole(spark):
    """A number between other characters is looked up as a whole, so no two orders share what is looked up, and the group's table isn't dealt out to count it."""
    ids = spark.range(1_000_000, 1_600_000, 30)
    table = ids.select(F.lit("g").alias("group_id"), F.lit("g").alias("name"), F.lit("string").alias("type"), F.lit("hash").alias("intelligence_type"), F.concat(F.lit("https?://shop\\.example/o"), "id", F.lit("/u[0-9]{1,2}")).alias("content"))
    by_gram, rest = P.index(table.select(F.col("content").alias("pattern")))
    assert rest.isEmpty() and by_gram.count() == 20_000 and by_gram.select("gram").distinct().count() == 20_000
    g = IntelGroups(table, patterns=True, literal_limit=0)
    assert not re.search("Exchange|Aggregate", g.table._jdf.queryExecution().executedPlan().toString())
    values = spark.range(1_000_000, 1_001_000).select(F.concat(F.lit("see http://shop.example/o"), "id", F.lit("/u7 now")).alias("v"))
    assert g.mark(values, "v", "g", "hit").where("hit").count() == 34


def test_sizes_count_repeated_contents_once(spark):
    rows = [("g", "n", "string", "hash", f"x{k % 600}y") for k in range(5000)] + [("h", "m", "string", "hash", f"x{k % 9}y") for k in range(5000)]
    table = spark.createDataFrame(rows, "group_id string, name string, type string, intelligence_type string, content string")
    g = IntelGroups(table, patterns=True)
    assert g.sizes["g"] == g.sizes["n"] == 600 and g.sizes["h"] == 9 and not g.is_small("n") and g.is_small("m")
    assert [r.id for r in g.mark(spark.createDataFrame([(1, "x8y"), (2, "x9y")], "id int, v string"), "v", "m", "hit").where("hit").collect()] == [1]


SHAPES = ["https?://shop\\.example/o%d/u[0-9]{1,2}", "o%d/u[0-9]*%d$", "evil%d\\.com", "(?:a%dbc|x)y%d", "(?i)up%d", "a{%d}bcde%d", "[a-z%d]+foo%dbar\\.", "\\d%dabc.%d-x", "été%d.x", "\\x41%dz.", "a\\.b%dc(de%d)+f", "%d", "[]a%d]zz%dzz.", "\\u0041%dq.", "abc|d%d", "(x%dy)?.w%dz.v", "b%d-\\{c%d\\}.e", "[\\]%d]qq%dq!", "/ab%d\\", "a{%d", "k%d#été.v", "\\ue005abc%d.q", "(?<n>a%d)b", "a%d++b"]


def test_patterns_of_one_shape_are_parsed_once(monkeypatch):
    """The same is asked as pattern by pattern, words that many share or of lengths that say little aside."""
    contents = [re.sub("%d", lambda m: str((k * 7919 + m.start()) % 10 ** (k % 4 + 1)), s) for s in SHAPES for k in range(40)] + ["", "a", "evil\\.com"]
    for common in (P.Common({}, {}), P.Common({".example/": 90, "/o": 90, "a1b": 2}, {"sho": 9, "hop": 7, "évé": 3}, 50), P.Common({}, {"abc": 5}, 1, [3, 4, 5, 9])):
        got = P.all_asked(P.pa.array(["skipped", *contents])[1:], common).to_pylist()
        assert sorted(map(str, got)) == sorted(str({"pattern": p, "gram": g, "size": n}) for p in contents for g, n in [P.asked(p, common)])
    P._template.cache_clear()
    calls, parse = [], P._parser.parse
    monkeypatch.setattr(P._parser, "parse", lambda *a: calls.append(a) or parse(*a))
    got = P.all_asked(P.pa.array([f"https?://shop\\.example/o{k}/u[0-9]{{1,2}}" for k in range(1000, 11_000)]), P.Common({".example/": 100, "/shop.": 100}, {}))
    assert len(calls) <= 4 and len(set(got["gram"].to_pylist())) == 10_000


def test_keys_of_texts():
    """All words between other characters and all grams, whatever the length of a character's code."""
    texts = ["http://shop.example/o123/u4", "", "é12é3", "12", "a1b", "1a1", "漢字abc漢1字", "x\n12\ny", "a" * 5, "😀9😀 ab 😀", "/a/b/1/", "1", "a", "."]
    one = lambda t: int(P._hashes(*(lambda b: (P.np.frombuffer(b, P.np.uint8), P.np.array([0]), P.np.array([len(b)])))(t.encode()))[0])
    for skip in (0, 2):
        got = P.keys(P.pa.array(["b2c"] * skip + texts)[skip:], [0, 3, 8]).to_pylist()
        assert [sorted(g) for g in got] == [sorted(map(one, P._WORDS.findall(t) + [t[k : k + n] for n in (3, 8) for k in range(len(t) - n + 1)])) for t in texts]
    assert P.keys(P.pa.array(["ab", ""]), []).to_pylist() == [[], []] and P.keys(P.pa.array([], P.pa.string()), [0]).to_pylist() == []


@pytest.mark.parametrize("kind", ["url", "hash"])
def test_numbers_and_words_at_borders(spark, kind):
    """A number may go on where the pattern's own text ends, and only there."""
    contents = [f"o{k}/u[0-9]*" for k in range(0, 60, 7)] + [f"/o{k}" for k in range(5, 60, 9)] + [f"é{k}é" for k in range(3)] + ["x1y2z", "(?:a1b|c)d2e", "w7\\.7w", "-q(?:r5s)+t-", "a\nb1c"]
    values = [f"{a}o{k}{b}" for k in range(60) for a, b in (("", "/u3"), ("/", ""), ("/", "1/u"), ("x", "/u"))] + [f"é{k}é" for k in range(12)] + ["x1y2z", "xx1y2zz", "x11y2z", "a1bd2e", "cd2e", "w7.7w", "w77.7w", "-qr5sr5st-", "-qr5t-", "a\nb1c", "a\nb1"]
    hit = lambda v: any((re.fullmatch if kind == "url" else re.search)(c, v) for c in contents)
    got = groups(spark, contents, kind).mark(spark.createDataFrame([(v,) for v in values], "v string"), "v", "g", "hit").collect()
    assert {r.v: r.hit for r in got} == {v: hit(v) for v in values} and len(got) == len(values)
