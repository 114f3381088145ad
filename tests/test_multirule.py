"""Many rules in one scan: the same matches as each rule's own plan."""

import pytest
from pyspark.sql import functions as F

from tidewatch import queries
from tidewatch.plans import multirule
from tidewatch.plans.compiler import compile_rule
from tidewatch.plans.multirule import one_scan
from tidewatch.plans.rules import Rule

DIR = "/root/testdata/sf0.001"
BOTH = [{"as": "A", "filter": "value > 30"}, {"as": "B", "filter": "event_type = purchase"}]
RELATED = {"groupBy": [], "relation": [["src", "dst"]], "window": {"value": 48, "unit": "hour"}}


def rule(name, family, **more):
    d = {"id": name, "name": name, "family": family, "groupBy": ["user_id"], "window": {"value": 24, "unit": "hour"}, "events": [{"as": "A", "filter": "event_type = view"}, {"as": "B", "filter": "event_type = purchase"}], "patternRepeat": {"low": 2}}
    return Rule.from_json(d | more)


@pytest.fixture(scope="module")
def events(spark):
    df = queries.events(spark, DIR).drop("props")
    return df.withColumns({"src": F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("H"), F.col("user_id") % 5)), "dst": F.concat(F.lit("h"), F.col("event_id") % 5)})


SEQUENCES = [
    rule("next", "followed_by", skip="next"), rule("past", "followed_by"), rule("strict", "followed_by", contiguity="strict", skip="next"), rule("both", "followed_by", events=BOTH), rule("both next", "followed_by", events=BOTH, skip="next"),
    rule("related", "followed_by", **RELATED), rule("related next", "followed_by", skip="next", **(RELATED | {"events": BOTH})), rule("all", "followed_by", groupBy=[], window={"value": 2, "unit": "hour"}, skip="next"),
    rule("alone", "not_followed_by"), rule("alone related", "not_followed_by", **RELATED), rule("before", "not_before"), rule("before both", "not_before", events=BOTH), rule("loop", "repeat_then"), rule("loop both", "repeat_then", events=BOTH),
    rule("loop related", "repeat_then", **RELATED), rule("where", "followed_by", where="value < 60", skip="next"),
]
COUNTS = [
    rule("any", "having_any"), rule("tumble", "having_count", having={"cnt": {"op": ">=", "value": 2}}), rule("hop", "having_count", slide={"value": 8, "unit": "hour"}), rule("odd hop", "having_count", slide={"value": 7, "unit": "hour"}, groupBy=[]),
    rule("sum", "having_sum", having={"total": {"field": "value", "op": ">", "value": 60}}, slide={"value": 8, "unit": "hour"}), rule("distinct", "having_count_distinct", groupBy=["event_type"], having={"cnt": {"field": "user_id", "op": ">", "value": 1}}, slide={"value": 8, "unit": "hour"}),
]


def sides(r, out):
    """Ids of the events of a rule's own matches, as the shared scan gives them."""
    has = lambda c: F.col(c) if c in out.columns else F.lit(None).cast("bigint")
    if r.family in ("not_followed_by", "having_any"):
        return out.select(F.col("event_id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).alias("n"))
    a = F.lit(None) if r.family == "not_before" else has("a_event_id")
    return out.select(a.alias("a"), has("b_event_id").alias("b"), (F.col("times").cast("double") if "times" in out.columns and r.family == "repeat_then" else F.lit(None)).alias("n"))


def test_same_as_each_rule_alone(spark, events):
    rows = one_scan(SEQUENCES + COUNTS, events).collect()
    got = {}
    for x in rows:
        got.setdefault(x["rule"], []).append(x)
    for r in SEQUENCES + COUNTS[:1]:
        want = sorted(map(str, map(tuple, sides(r, compile_rule(r, events)).collect())))
        assert sorted(str((x["a_event_id"], x["b_event_id"], x["value"])) for x in got.get(r.key, [])) == want and want, r.name
    for r in COUNTS[1:]:
        name = next(iter(r.having), "cnt")
        signature = F.concat_ws(",", *r.groupBy) if r.groupBy else F.lit("All")
        want = compile_rule(r, events).select(signature, "window_start", "window_end", F.round(F.col(name).cast("double"), 6))
        assert sorted((x["signature"], x["window_start"], x["window_end"], round(x["value"], 6)) for x in got[r.key]) == sorted(map(tuple, want.collect())), r.name


def test_times_of_the_events(spark, events):
    rows = one_scan([SEQUENCES[0]], events).join(events.select(F.col("event_id").alias("a_event_id"), "ts"), "a_event_id")
    assert rows.where("a_ts = ts AND b_ts > a_ts").count() == rows.count() > 0


def test_equal_events_and_missing_times(spark, events):
    """Repeated events give repeated matches; events without a time none; no events, no rows."""
    twice = events.unionByName(events.withColumn("ts", F.lit(None).cast("timestamp")))
    rules = [SEQUENCES[0], COUNTS[1]]
    assert sorted(map(str, one_scan(rules, twice).collect())) == sorted(map(str, one_scan(rules, events).collect()))
    a = one_scan([SEQUENCES[8], COUNTS[1]], events.unionByName(events)).where("rule = 'alone'").count()
    assert a == 2 * one_scan([SEQUENCES[8], COUNTS[1]], events).where("rule = 'alone'").count() > 0
    assert one_scan(rules, events.limit(0)).collect() == []


def test_scans_and_shuffles_dont_grow(spark):
    """A hundred rules take one scan and as many exchanges as seven, without Python."""
    df = queries.events(spark, DIR).drop("props")

    def plan(n):
        text = one_scan([r for v in range(n) for r in queries._seven(v)], df)._jdf.queryExecution().executedPlan().toString()
        return text.count("FileScan"), text.count("Exchange hashpartitioning"), "Python" in text or "Arrow" in text

    assert plan(1) == plan(15) == (1, 4, False)


def test_hot_keys_cost_their_rows(spark, events):
    """No frame shrinks, and rows of rules without sequences are dealt evenly, whatever their key."""
    rules = [*SEQUENCES, COUNTS[5]]
    assert "RangeFrame" not in one_scan(rules, events)._jdf.queryExecution().analyzed().toString()
    got = multirule._stretched(events.limit(400).select(F.lit(None).alias("__tw_key"), F.lit("x").alias("__tw_sign"), F.lit(5).alias("__tw_t"), "event_id", F.lit(False).alias("__tw_seq")), 100, 10, ["event_id"])
    assert got.count() == 400 and got.select("__tw_s").distinct().count() > 300


@pytest.mark.parametrize("r", [rule("r", "followed_by", window=None), rule("r", "repeat_until"), rule("r", "not_before", silence="1 hour"), rule("r", "repeat_then", contiguity="strict")])
def test_what_has_a_plan_of_its_own_only(spark, events, r):
    with pytest.raises(ValueError, match="doesn't share a pass"):
        one_scan([r], events)
