import json

import pytest
from pyspark.sql import functions as F

from tidewatch import queries
from tidewatch.plans.compiler import FAMILIES, Job, compile_rule, one_pass
from tidewatch.plans.matchsql import parse_match
from tidewatch.plans.rules import Attribute, Category, Rule, Select, TimeWindow
from tidewatch.sources import sinks

DIR = "/root/testdata/sf0.001"


def rule(family, **more):
    d = {"name": family, "family": family, "groupBy": ["user_id"], "window": {"value": 24, "unit": "hour"}, "slide": {"value": 8, "unit": "hour"}, "events": [{"as": "A", "filter": "event_type = view"}, {"as": "B", "filter": "event_type = purchase"}], "patternRepeat": {"low": 2}}
    return Rule.from_json(json.dumps(d | more))


@pytest.mark.parametrize("family", FAMILIES)
def test_every_family_compiles(spark, family):
    having = {"total" if family == "having_sum" else "cnt": {"fn": "x", "field": "value", "op": ">", "value": 1}} if family.startswith("having_") and family != "having_any" else {}
    out = compile_rule(rule(family, having=having), queries.events(spark, DIR))
    assert not any("__tw_" in c for c in out.columns)
    assert out.count() > 0


def test_unknown_family(spark):
    with pytest.raises(ValueError, match="unknown family"):
        compile_rule(rule("what"), queries.events(spark, DIR))


def test_rendering():
    attr = Attribute("A", "src")
    assert Select("s", attr).text() == "A.`src` AS `s`"
    assert Select("n", attr, fn="count").text() == "count(A.`src`) AS `n`"
    assert Select("", attr, fn="count").text() == ""
    assert [Select("c", None, "", v, t).text() for v, t in ((5, "long"), (1.5, "double"), (True, "boolean"), ("x'y", "string"))] == ["5L AS `c`", "1.5F AS `c`", "true AS `c`", "'x''y' AS `c`"]
    with pytest.raises(ValueError, match="reserved"):
        Select("alarm_level", attr).text()
    w = TimeWindow(10, "second", "time", attr)
    assert [w.text(), w.text(alias=True), w.text(repeated=True)] == [".win:time(src,10 second)", ".win:time(A.src,10 second)", ".win:time(A[0].src,10 second)"]


def test_definition():
    r = Rule.from_json({"name": "n", "ruleCategory": "sae", "unknown": 1})
    assert (r.category, r.builtin, r.key) == (Category.SAE, False, "7b8b965ad4bca0e41ab51de7b31363a1")
    assert r.alert.alarmKey == ("src_address", "dst_address", "alarm_content")
    assert Category.of("?") is Category.UNKNOWN


def test_job(spark):
    got = {}
    job = Job().source("events", lambda s: queries.events(s, DIR)).rule("events", rule("having_any"), "keep").sink("keep", lambda df, k: got.setdefault(k, df.count()))
    out = job.run(spark)
    assert list(out) == list(got) and next(iter(got.values())) > 0
    with pytest.raises(ValueError, match="no source"):
        Job().rule("nothing", rule("having_any"), "keep").build(spark)


def test_match_sql_text():
    q = parse_match(queries.match_sql_repeat.__doc__ or "SELECT * FROM t MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES FIRST(A.x) AS ax, B.x AS bx ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW PATTERN (A{3,} B) WITHIN INTERVAL '1' MINUTE DEFINE A AS A.e = 'p, q', B AS B.e = 'r')")
    assert (q.table, q.keys, q.order, q.pattern, q.skip, q.within) == ("t", ("k",), "ts", (("A", 3, None), ("B", 1, 1)), "past_last", "1 minute")
    assert q.measures == (("FIRST(A.x)", "ax"), ("B.x", "bx")) and q.defines == {"A": "A.e = 'p, q'", "B": "B.e = 'r'"}
    with pytest.raises(ValueError, match="SKIP"):
        parse_match("SELECT * FROM t MATCH_RECOGNIZE (ORDER BY ts MEASURES A.x AS y AFTER MATCH SKIP TO LAST B PATTERN (A B) DEFINE A AS true, B AS true)")


def test_match_sql_between_events(spark):
    from tidewatch.plans.matchsql import match_recognize

    rows = [(k, 1_700_000_000 + k, "u", c) for k, c in enumerate("xyyz")]
    spark.createDataFrame(rows, "id int, s long, k string, region string").withColumn("ts", F.timestamp_seconds("s")).createOrReplaceTempView("tw_regions")
    text = "SELECT * FROM tw_regions MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES A.id AS a, B.id AS b PATTERN (A B) WITHIN INTERVAL '3' HOUR DEFINE B AS B.region <> A.region)"
    assert sorted((r.a, r.b) for r in match_recognize(spark, text, ("id",)).collect()) == [(0, 1), (2, 3)]


@pytest.mark.parametrize(
    ("letters", "pattern", "measures", "want"),
    [
        ("aab", "(A{1,} B)", "FIRST(A.id) AS f, A.id AS l, B.id - LAST(A.id) AS d", [(0, 1, 1)]),
        ("abcabdabc", "(A B C)", "A.id AS a, C.id AS c, upper('A.x') AS t", [(0, 2, "A.X"), (6, 8, "A.X")]),
        ("abbbcabc", "(A B{2,} C)", "A.id AS a, FIRST(B.id) AS f, LAST(B.id) AS l", [(0, 1, 3)]),
        ("abbcabbbc", "(A B{1,2} C)", "A.id AS a, B.id AS l, C.id AS c", [(0, 2, 3)]),
        ("aabab", "(A+ B+)", "FIRST(A.id) AS f, LAST(A.id) AS l, LAST(B.id) AS b", [(0, 1, 2), (3, 3, 4)]),
    ],
)
def test_match_sql_patterns(spark, letters, pattern, measures, want):
    from tidewatch.plans.matchsql import match_recognize

    spark.createDataFrame([(k, "u", c) for k, c in enumerate(letters)], "id int, k string, e string").withColumn("ts", F.timestamp_seconds(F.col("id") + 1_700_000_000)).createOrReplaceTempView("tw_letters")
    defines = ", ".join(f"{v} AS {v}.e = '{v.lower()}'" for v in "ABC" if v in pattern)
    got = match_recognize(spark, f"SELECT * FROM tw_letters MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES {measures} PATTERN {pattern} DEFINE {defines})", ("id",))
    assert sorted(tuple(r)[1:] for r in got.collect()) == want


def test_match_sql_to_next_row(spark):
    from tidewatch.plans.matchsql import match_recognize

    spark.createDataFrame([(k, "u", c) for k, c in enumerate("aaab")], "id int, k string, e string").withColumn("ts", F.timestamp_seconds(F.col("id") + 1_700_000_000)).createOrReplaceTempView("tw_letters")
    text = "SELECT * FROM tw_letters MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES FIRST(A.id) AS f, B.id AS b AFTER MATCH SKIP TO NEXT ROW PATTERN (A{2,} B) DEFINE A AS A.e = 'a', B AS B.e = 'b')"
    assert sorted((r.f, r.b) for r in match_recognize(spark, text, ("id",)).collect()) == [(0, 3), (1, 3)]


def test_many_rules_in_one_pass(spark):
    events = queries.events(spark, DIR)
    rules = [rule("having_any", id="any", events=[{"as": "A", "filter": "value > 90"}])]
    rules += [rule("having_count", id=f"count{k}", events=[{"as": "A", "filter": f"value > {k}"}], having={"cnt": {"op": ">=", "value": 2}}) for k in (10, 50)]
    rules += [rule("having_sum", id="sum", slide=None, where="user_id > 3", having={"total": {"field": "value", "op": ">", "value": 60}})]
    got = one_pass(rules, events)
    for r in rules:
        mine = sorted((x.signature, x.window_start, float(x.value)) for x in got.where(F.col("rule") == r.key).collect())
        each = compile_rule(r, events).collect()
        want = sorted((str(x.user_id), x["window_start"] if r.family != "having_any" else None, float(x[next(iter(r.having))]) if r.having else 1.0) for x in each)
        assert [(a, b, round(c, 6)) for a, b, c in mine] == [(a, b, round(c, 6)) for a, b, c in want] and mine
    with pytest.raises(ValueError, match="share a pass"):
        one_pass([rule("followed_by")], events)


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    sinks.discard(df)
    sinks.files(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert sorted(r.value for r in sinks.as_json(df).collect()) == ['{"id":0}', '{"id":1}', '{"id":2}']
