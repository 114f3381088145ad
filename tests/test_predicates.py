import pytest
from pyspark.sql import functions as F

from tidewatch.functions import predicates as P
from tidewatch.functions import scalars as S
from tidewatch.functions.intel import IntelGroups

SCHEMA = "id int, name string, n int, amount string, tags array<int>, ip string, flag boolean, inner struct<x: string>"
ROWS = [
    (1, "Alpha", 5, "1200", [1, 2], "10.0.0.7", True, ("in",)),
    (2, "alpha\n", -1, "abc", [3], "192.168.1.5", False, (None,)),
    (3, None, None, None, None, None, None, None),
    (4, "a.b", 5, "7", [], "garbage", True, ("x",)),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


CASES = [
    ("name = Alpha", [1]),
    ("name != Alpha", [2, 3, 4]),
    ("not name = Alpha", [2, 3, 4]),
    ("flag = true", [1, 4]),
    ("tags = 1", []),
    ("n > 4", [1, 4]),
    ("n >= 5 and n <= 5", [1, 4]),
    ("n < 0", [2]),
    ("not n < 0", [1, 3, 4]),
    ("amount > 100", [1]),
    ("amount > abc", []),
    ("name exist", [1, 2, 4]),
    ("exist name", [1, 2, 4]),
    ("not_exist name", [3]),
    ("other not_exist", [1, 2, 3, 4]),
    ("name like lph", [1, 2]),
    ('name like "%"', []),
    ('name rlike "[Aa]lpha"', [1]),
    ('name rlike "a|a.b"', [4]),
    ("ip in 10.0.0.0/8", [1]),
    ("ip in 192.168.1.10-192.168.1.1", [2]),
    ("ip in 0.0.0.0-0.0.0.1", [4]),
    ("ip in 10.0.0.7", [1]),
    ("not ip in 10.0.0.0/8", [2, 3, 4]),
    ("tags contain 3", [2]),
    ("not tags contain 3", [1, 3, 4]),
    ("inner.x = in", [1]),
    ("n = 5 or name = nobody and n = -1", [1, 4]),
    ("(n = 5 or n = -1) and not flag = true", [2]),
    ("not (n = 5 and flag = true)", [2, 3]),
    ("n = 5 and not name like Al", [4]),
    ("NOT not n = 5", [1, 4]),
]


@pytest.mark.parametrize(("text", "ids"), CASES)
def test_operators(df, text, ids):
    assert sorted(r.id for r in df.where(P.where(df, text)).collect()) == ids
    assert sorted(r.id for r in df.where(P.condition(df, text)).collect()) == ids


def test_filters_reach_the_files(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for text, part in (("event_type = purchase", "EqualTo(event_type,purchase)"), ("value > 50", "GreaterThan(value,50.0)"), ("user_id = 3", "EqualTo(user_id,3)")):
        assert part in df.where(P.condition(df, text)).select("event_id")._jdf.queryExecution().toString()


def test_never_null(df):
    shown = df.select(*[P.where(df, t).alias(f"c{k}") for k, (t, _) in enumerate(CASES)])
    assert all(v is not None for r in shown.collect() for v in r)


@pytest.mark.parametrize("text", ["", "a =", "a ? b", "(a = 1", "a = 1)", "and", "a = 1 b = 2", "= 3"])
def test_refused(text):
    with pytest.raises(P.PredicateError):
        P.parse(text)


def test_fields_of_two_events(spark):
    df = spark.createDataFrame([("X", "x", 1, 2), ("X", None, 1, 1)], "a string, b string, m int, n int").select(F.struct("a", "m").alias("A"), F.struct("b", "n").alias("B"))
    tree = P.parse("A.a = B.b and A.m < B.n", ("A", "B"))
    assert P.fields(tree) == {"A.a", "B.b", "A.m", "B.n"}
    assert [r.t for r in df.select(P.compile_predicate(tree, P.resolver(df)).alias("t")).collect()] == [True, False]


def test_undeclared_json_field(spark):
    df = spark.createDataFrame([('{"deep": {"k": 7}}',), ("{}",), (None,)], "raw string")
    assert [r.t for r in df.select(P.where(df, "deep.k = 7", raw="raw").alias("t")).collect()] == [True, False, False]


def test_groups(spark):
    rows = [("g", "hosts", "ip", "", c) for c in ("10.0.0.0/8", "192.168.1.9-192.168.1.1", "8.8.4.4", "1.0.0.0-3.255.255.255")] + [("h", "hashes", "string", "hash", "ab+"), ("u", "urls", "string", "url", "a.*z")]
    t = spark.createDataFrame(rows, "group_id string, name string, type string, intelligence_type string, content string")
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["10.9.9.9", "192.168.1.4", "192.168.1.10", "8.8.4.4", "2.2.2.2", "x", None, "abbb", "a-z"])], "id int, v string")
    for limit in (512, 0):
        marked = IntelGroups(t, literal_limit=limit).mark(df, "v", "hosts", "hit")
        assert sorted(r.id for r in marked.where("hit").collect()) == [0, 1, 3, 4]
        assert marked.where("hit IS NULL").isEmpty()
    g = IntelGroups(t)
    assert df.where(P.where(df, "v belong nobody", member=g.member)).isEmpty()
    assert df.where(P.where(df, "v belong hashes", member=g.member)).isEmpty()
    patterns = IntelGroups(t, patterns=True)
    assert [r.id for r in df.where(patterns.member(F.col("v"), "h")).collect()] == [7]
    assert [r.id for r in df.where(patterns.member(F.col("v"), "urls")).collect()] == [8]
    with pytest.raises(ValueError, match="unknown type"):
        IntelGroups(t.withColumn("type", F.lit("what")))


def test_groups_of_any_size_in_sql(spark):
    rows = [("g", "hosts", "ip", "", c) for c in ("10.0.0.0/8", "192.168.1.9-192.168.1.1", "8.8.4.4", "1.0.0.0-3.255.255.255")] + [("h", "words", "string", "", "it's"), ("h", "words", "string", "", "a\\b")]
    t = spark.createDataFrame(rows, "group_id string, name string, type string, intelligence_type string, content string")
    values = ["10.9.9.9", "192.168.1.4", "192.168.1.10", "8.8.4.4", "2.2.2.2", "x", None, "it's", "a\\b"]
    spark.createDataFrame([(k, v, "hosts" if k % 2 else "h") for k, v in enumerate(values)], "id int, v string, g string").createOrReplaceTempView("tw_values")
    ids = lambda test: sorted(r.id for r in spark.sql(f"SELECT id FROM tw_values WHERE {test}").collect())
    for limit in (512, 0):
        IntelGroups(t, literal_limit=limit).register_sql("belong_any")
        assert ids("belong_any(v, 'hosts')") == [0, 1, 3, 4]
        assert ids("NOT belong_any(v, 'g')") == [2, 5, 6, 7, 8]
        assert ids("belong_any(v, 'words') OR belong_any(v, 'nobody')") == [7, 8]
        assert ids("belong_any(v, g)") == [1, 3, 8]
        shown = spark.sql("SELECT id, belong_any(v, 'hosts') AND NOT belong_any(v, 'words') AS hit FROM tw_values").collect()
        assert sorted((r.id, r.hit) for r in shown) == [(k, k in (0, 1, 3, 4)) for k in range(9)]


def test_patterns_of_groups_of_any_size(spark):
    rows = [("h", "hashes", "string", "hash", c) for c in ("ab+", r"\d'x")] + [("u", "urls", "string", "url", f"site{k}/.*z") for k in range(1100)]
    t = spark.createDataFrame(rows, "group_id string, name string, type string, intelligence_type string, content string")
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["xabbb", "ab+", "a", None, "site7/az", "site1099/z", "site7/a", "3'x"])], "id int, v string")
    df.createOrReplaceTempView("tw_texts")
    for limit in (512, 0):
        groups = IntelGroups(t, patterns=True, literal_limit=limit)
        groups.register_sql("belong_like")
        for group, want in (("h", [0, 1, 7]), ("urls", [4, 5])):
            marked = groups.mark(df, "v", group, "hit")
            assert sorted(r.id for r in marked.where("hit").collect()) == want
            assert marked.where("hit IS NULL").isEmpty()
            assert sorted(r.id for r in spark.sql(f"SELECT id FROM tw_texts WHERE belong_like(v, '{group}')").collect()) == want


def test_scalars(spark):
    assert S.ip_bounds("192.168.1.1/24") == (3232235776, 3232236031)
    assert S.ip_bounds("10.0.0.1/99") == (0, 4294967295)
    r = spark.range(1).select(
        S.parse_time(F.lit("2019-09-09T08:00:39.959UTC")).alias("ms"), S.parse_time(F.lit("?")).alias("bad"), S.time_format(F.timestamp_millis(F.lit(1568016039959))).alias("iso"), S.group_signature([F.lit(None), F.lit(3)]).alias("sig"), S.group_signature([]).alias("all"),
        S.equals_ignoring_case_and_empty(F.lit(None), F.lit("")).alias("same"), S.ip_number(F.lit("x.y")).alias("ip"), S.md5_text(F.lit("a"), upper=True).alias("md5"),
    ).first()
    assert tuple(r) == (1568016039959, None, "2019-09-09T08:00:39.959+0000", "None,3", "All", True, 0, "0CC175B9C0F1B6A831C399E269772661")
    S.register_sql(spark)
    assert spark.sql("SELECT time_parse(timestamp_millis(5)), parse_time('2019-09-09T08:00:39.959UTC'), equals_ignoring_case_and_empty('A', 'a')").first()[:] == (5, 1568016039959, True)
