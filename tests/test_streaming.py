"""A stream over the same rows gives what a batch gives, up to the watermark."""

import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import queries
from tidewatch.operators import sequences as Q
from tidewatch.functions.intel import IntelGroups
from tidewatch.operators import windows as W
from tidewatch.operators.automaton import Stage, match_pattern
from tidewatch.plans.compiler import compile_rule
from tidewatch.plans.rules import Rule
from tidewatch.sources import generators, readers, sinks
from tidewatch.streaming import joins as J
from tidewatch.streaming import stateful as S

VIEW, BUY, TIE = "event_type = 'view'", "event_type = 'purchase'", ["event_id"]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition of a stateful operator opens a store in every batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    df = queries.events(spark, "/root/testdata/sf0.001").select("event_id", "ts", "user_id", "event_type", "value").cache()
    path = str(tmp_path_factory.mktemp("events"))
    df.orderBy("ts").coalesce(1).write.mode("overwrite").option("maxRecordsPerFile", 300).parquet(path)
    def stream(timed=True):
        files = readers.files(spark, path, df.schema, "parquet", 1)
        return readers.with_event_time(files, "ts") if timed else files.drop("ts")

    return df, stream


def run(spark, df, name, mode="append"):
    sinks.memory(df, name, mode).awaitTermination()
    return spark.table(name).collect()


def ids(rows):
    return sorted(tuple(e["event"]["event_id"] for e in json.loads(r.events)) for r in rows)


def test_sequences(spark, events):
    df, stream = events
    end = df.agg(F.max("ts")).first()[0] - timedelta(seconds=3)
    got = ids(run(spark, S.followed_by_stream(stream(), F.expr(VIEW), F.expr(BUY), ["user_id"], "ts", TIE, "6 hours"), "tw_followed"))
    want = Q.followed_by(df, F.expr(VIEW), F.expr(BUY), ["user_id"], "ts", TIE, "6 hours").where(F.col("b_ts") <= end)
    assert got == sorted((r.a_event_id, r.b_event_id) for r in want.collect())
    got = ids(run(spark, S.not_followed_by_stream(stream(), F.expr(VIEW), F.expr(BUY), ["user_id"], "ts", TIE, "6 hours"), "tw_alone"))
    want = Q.not_followed_by(df, F.expr(VIEW), F.expr(BUY), ["user_id"], "ts", TIE, "6 hours").where(F.col("ts") <= end - timedelta(hours=6))
    assert got == sorted((r.event_id,) for r in want.collect())


def test_not_before(spark, events):
    df, stream = events
    end = df.agg(F.max("ts")).first()[0] - timedelta(seconds=3)
    got = run(spark, S.not_before_stream(stream(), F.expr(VIEW), F.expr(BUY), "ts", TIE, "24 hours", ["user_id"], ["user_id"], "72 hours"), "tw_unannounced")
    want = Q.not_before(df, F.expr(VIEW), F.expr(BUY), "ts", TIE, "24 hours", ["user_id"], ["user_id"], "72 hours").where(F.col("b_ts") <= end)
    assert ids(got) == sorted((r.b_event_id, r.a_event_id) if r.a_event_id is not None else (r.b_event_id,) for r in want.collect())


def rule(family, **more):
    d = {"name": family, "family": family, "groupBy": ["user_id"], "window": {"value": 24, "unit": "hour"}, "events": [{"as": "A", "filter": "event_type = view"}, {"as": "B", "filter": "event_type = purchase"}], "patternRepeat": {"low": 2}}
    return Rule.from_json(d | more)


RELATED = {"groupBy": [], "relation": [["src", "dst"]], "window": {"value": 48, "unit": "hour"}}
OVERLAP = {"events": [{"as": "A", "filter": "value > 30"}, {"as": "B", "filter": "event_type = purchase"}]}


@pytest.mark.parametrize(
    ("family", "more"),
    [
        ("followed_by", {}), ("followed_by", {"skip": "next"}), ("followed_by", {"contiguity": "strict"}), ("followed_by", RELATED), ("followed_by", RELATED | OVERLAP | {"skip": "next"}), ("not_followed_by", {}), ("not_followed_by", RELATED),
        ("not_before", {}), ("not_before", {"silence": "72 hours"}), ("repeat_then", {}), ("repeat_then", OVERLAP), ("repeat_then", {"contiguity": "strict"}), ("repeat_then", RELATED), ("repeat_until", {"window": None}), ("having_any", {}),
    ],
)
def test_rules_over_streams(spark, events, family, more):
    """A rule gives the same rows and columns over a stream as over a batch, up to the watermark."""
    df, stream = events
    add = lambda x: x.withColumns({"src": F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("H"), F.col("user_id") % 5)), "dst": F.concat(F.lit("h"), F.col("event_id") % 5)})
    r = rule(family, **more)
    end = df.agg(F.max("ts")).first()[0] - timedelta(seconds=3)
    batch, live = compile_rule(r, add(df)), compile_rule(r, add(stream()))
    assert live.columns == batch.columns
    got = sorted(map(str, run(spark, live, f"tw_rule_{abs(hash((family, str(more))))}")))
    when = {"not_followed_by": F.col("ts") + F.expr(f"INTERVAL {r.window.interval}") if r.window else None, "having_any": F.lit(end), "repeat_until": F.element_at("events", -1)["event"]["ts"]  if family == "repeat_until" else None}.get(family)
    want = batch.where((F.col("b_ts") if when is None else when) <= end)
    assert got == sorted(map(str, want.collect())) and got


def test_conditions_on_earlier_events_see_fields(spark, events):
    df, stream = events
    later = lambda e, taken: e["value"] > taken["a"][0]["value"]
    stages = [Stage("a", F.expr(VIEW)), Stage("b", F.expr(BUY), also=later)]
    end = df.agg(F.max("ts")).first()[0] - timedelta(seconds=3)
    got = ids(run(spark, S.match_stream(stream(), stages, ["user_id"], "ts", TIE, "24 hours", kinds=("match",)), "tw_also"))
    want = match_pattern(df, stages, ["user_id"], "ts", TIE, "24 hours", skip="next").collect()
    assert got == sorted(tuple(e.event.event_id for e in r.events) for r in want if r.events[-1].event.ts <= end) and got


def test_groups_are_reloaded_between_batches(spark, events, tmp_path):
    """A stateless rule in a shared stream reads its groups anew for every micro-batch."""
    _, stream = events
    path, seen = str(tmp_path / "groups"), []
    group = lambda content: spark.createDataFrame([("g", "kinds", "string", "", content)], "group_id string, name string, type string, intelligence_type string, content string")
    group("view").write.parquet(path)
    groups = IntelGroups(readers.intel_table(spark, path))
    r = Rule.from_json({"name": "r", "family": "having_any", "events": [{"as": "A", "filter": "event_type belong kinds"}]})

    def write(part, name, number):
        seen.append({x.event_type for x in part.select("event_type").distinct().collect()})
        group("purchase").write.mode("overwrite").parquet(path)

    sinks.fan_out_batches(stream(), {"r": lambda x: compile_rule(r, x, groups=groups.reloaded(readers.intel_table(spark, path)))}, write, once=True).awaitTermination()
    assert seen[0] == {"view"} and seen[1:] and all(s == {"purchase"} for s in seen[1:])


def test_only_stateless_plans_share_batches(spark, events):
    _, stream = events
    with pytest.raises(Exception, match="one micro-batch"):
        sinks.fan_out_batches(stream(), {"count": lambda x: x.groupBy("user_id").count()}, lambda *a: None, once=True).awaitTermination()


def test_tap_and_processing_time(spark, events):
    _, stream = events
    seen = []
    with readers.tapped(spark, seen.append):
        run(spark, W.having_count(stream(), ["user_id"], "ts", "24 hours"), "tw_tapped")
        spark.streams.resetTerminated()
        for _ in range(50):
            if any(x["watermark"] for x in seen):
                break
            time.sleep(0.2)
    assert sum(x["rows"] for x in seen) == 1000 and any(x["watermark"] for x in seen)
    now = readers.with_processing_time(stream(timed=False))
    assert run(spark, W.having_count(now, [], "ts", "1 day"), "tw_now", "complete")[0].cnt <= 1000


def test_scripted_events(spark, tmp_path):
    ticks = generators.scripted(spark, [("A", 1), ("B", 2), ("A", 3)], "kind string, n int", per_second=50)
    q = sinks.memory(ticks, "tw_ticks", once=False)
    try:
        for _ in range(100):
            q.processAllAvailable()
            if spark.table("tw_ticks").count() > 4:
                break
    finally:
        q.stop()
    rows = [tuple(r)[:2] for r in spark.table("tw_ticks").orderBy("number").collect()]
    assert rows[:5] == [("A", 1), ("B", 2), ("A", 3), ("A", 1), ("B", 2)]


def test_windows(spark, events):
    df, stream = events
    for name, f in (("tw_count", lambda x: W.having_count(x, ["user_id"], "ts", "24 hours", "8 hours", least=2)), ("tw_distinct", lambda x: W.having_count_distinct(x, ["event_type"], "ts", "user_id", "24 hours", "8 hours"))):
        assert sorted(map(tuple, run(spark, f(stream()), name, "complete"))) == sorted(map(tuple, f(df).collect()))


def test_many_rules_over_one_stream(spark, events):
    df, stream = events
    seen = {"views": 0, "large": 0}

    def write(part, name, number):
        seen[name] += part.count()

    sinks.fan_out_batches(stream(), {"views": lambda x: x.where(VIEW), "large": lambda x: x.where("value > 90")}, write, once=True).awaitTermination()
    assert seen == {"views": df.where(VIEW).count(), "large": df.where("value > 90").count()}


def test_restart_goes_on(spark, events, tmp_path):
    _, stream = events
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    for _ in range(2):
        sinks.files(stream(), out, kept, once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 1000


def test_readers_and_generators(spark):
    df = spark.createDataFrame([('{"key": 1, "value": {"a": "x", "t": 1700000000000, "b": 5}}',), ('{"value": {"a": null}}',), ("bad",)], "value string")
    got = readers.unwrap(df, "a string, t bigint").collect()
    assert [(r.a, r.t) for r in got] == [("x", 1700000000000), (None, None), (None, None)] and '"b":5' in got[0].raw
    timed = readers.with_event_time(spark.createDataFrame([(1700000000000,), (None,)], "t bigint"), "t")
    assert timed.where("ts IS NULL").isEmpty()
    assert generators.tuples(spark, 10, 4, 3).count() == 30
    assert sorted({r.key for r in generators.key_range(spark, 10, 4).collect()}) == [0, 1, 2, 3]
    assert len(generators.wide_events(spark, 1, 1).columns) == 39
    assert generators.parsed_events(spark, 5, 2).where("src_address IS NULL").isEmpty()
    assert generators.mini_events(spark, 5, 2).count() == 5 and generators.ticking(spark).isStreaming
    with pytest.raises(ValueError, match="topic"):
        readers.kafka(spark, "host:9092")


def test_scratch_folders_are_cleaned(spark):
    from pathlib import Path

    from tidewatch.shared import clean, scratch

    path = scratch(spark, "test")
    spark.range(1).write.parquet(path)
    assert Path(path.removeprefix("file:")).exists() or Path(path.removeprefix("file://")).exists()
    assert clean(spark) >= 1 and clean(spark) == 0
    assert not Path(path.removeprefix("file://")).exists()


@pytest.mark.parametrize("keyed", [False, True])
def test_joins_without_python(spark, events, keyed):
    """FOLLOWED BY and NOT FOLLOWED BY as interval joins, by related fields or by key."""
    df, stream = events
    add = lambda x: x.withColumns({"src": F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("H"), F.col("user_id") % 5)), "dst": F.concat(F.lit("h"), F.col("event_id") % 5)})
    how = (["user_id"], "ts", TIE, "6 hours") if keyed else ([], "ts", TIE, "6 hours", [("src", "dst")])
    relation = [] if keyed else [("src", "dst")]
    end = df.agg(F.max("ts")).first()[0] - timedelta(hours=6, seconds=3)
    live = J.followed_by_join(add(stream()), F.expr(VIEW), F.expr(BUY), *how)
    want = Q.followed_by(add(df), F.expr(VIEW), F.expr(BUY), ["user_id"] if keyed else [], "ts", TIE, "6 hours", relation=relation).where(F.col("a_ts") <= end)
    assert live.columns == want.columns
    got = [x for x in run(spark, live, f"tw_join_{keyed}") if x["a_ts"] <= end]
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and got
    live = J.not_followed_by_join(add(stream()), F.expr(VIEW), F.expr(BUY), *how)
    assert "Python" not in live._jdf.queryExecution().analyzed().toString()
    want = Q.not_followed_by(add(df), F.expr(VIEW), F.expr(BUY), ["user_id"] if keyed else [], "ts", TIE, "6 hours", relation=relation).where(F.col("ts") <= end)
    assert sorted(map(str, run(spark, live, f"tw_join_alone_{keyed}"))) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="needs a key"):
        J.followed_by_join(df, F.expr(VIEW), F.expr(BUY), [], "ts", TIE, "6 hours")


def _written(q):
    """Bytes that each batch put into the state, and its rows."""
    return [(p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"], p["numInputRows"]) for p in q.recentProgress if p["stateOperators"]]


def test_state_is_written_by_the_batch(spark, tmp_path):
    """One key: what a batch writes follows its events, however much the key has waiting and open."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    path, wide = str(tmp_path / "in"), F.lpad(F.col("id").cast("string"), 200, "x")
    rows = lambda a, b: spark.range(a, b).select(F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.lit("u").alias("key"), F.lit("a").alias("kind"), wide.alias("load"))
    sizes = [2000, 50, 50, 50, 50]
    (tmp_path / "in").mkdir()
    stream = readers.with_event_time(readers.files(spark, path, rows(0, 1).schema, "parquet", 1), "ts")
    found = S.not_followed_by_stream(stream, F.expr("kind = 'a'"), F.expr("kind = 'b'"), ["key"], "ts", ["id"], "10 hours")
    q, at = found.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "kept")).start(), 0
    try:
        for n in sizes:
            rows(at, at + n).coalesce(1).write.mode("append").parquet(path)
            at += n
            q.processAllAvailable()
        written = [(b, n) for b, n in _written(q)]
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    first = sum(b for b, n in written[:2])
    later = sum(b for b, n in written[2:])
    # two thousand open matches of the key stay as they are while two hundred more come
    assert sum(n for _, n in written) == sum(sizes) and 0 < later < first / 4


def test_sequences_go_on_after_a_restart(spark, events, tmp_path):
    """Stopped after every file and started again from its checkpoint, a rule gives what it gives in one go."""
    df, _ = events
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for lo in range(0, 1000, 250):
        days = df.orderBy("ts").offset(lo).limit(250)
        days.coalesce(1).write.mode("append").parquet(path)
        stream = readers.with_event_time(readers.files(spark, path, df.schema, "parquet", 1), "ts")
        found = S.repeated_then_stream(stream, F.expr("event_type = 'click'"), F.expr(BUY), 2, ["user_id"], "ts", TIE, "72 hours")
        sinks.files(found, out, str(tmp_path / "kept"), once=True).awaitTermination()
    end = df.agg(F.max("ts")).first()[0] - timedelta(seconds=3)
    want = Q.repeated_then(df, F.expr("event_type = 'click'"), F.expr(BUY), 2, ["user_id"], "ts", TIE, "72 hours").where(F.col("b_ts") <= end)
    got = sorted((e[0], e[-1], len(e) - 1) for e in ids(spark.read.parquet(out).collect()))
    assert got == sorted((r.a_event_id, r.b_event_id, r.times) for r in want.collect()) and got


@pytest.mark.parametrize("silence", [None, "5 hours"])
def test_not_before_without_groups(spark, events, tmp_path, silence):
    """Stretches of time as keys: what a batch gives, with more than one partition of the state in use."""
    df, stream = events
    end = df.agg(F.max("ts")).first()[0] - timedelta(seconds=3)
    found = S.not_before_stream(stream(), F.expr("event_type = 'signup'"), F.expr(BUY), "ts", TIE, "1 hour", silence=silence)
    q = found.writeStream.format("memory").queryName(f"tw_free_{silence is None}").option("checkpointLocation", str(tmp_path / "kept")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = ids(spark.table(f"tw_free_{silence is None}").collect())
    want = Q.not_before(df, F.expr("event_type = 'signup'"), F.expr(BUY), "ts", TIE, "1 hour", silence=silence).where(F.col("b_ts") <= end)
    assert got == sorted((r.b_event_id, r.a_event_id) if r.a_event_id is not None else (r.b_event_id,) for r in want.collect()) and got
    states = [p["stateOperators"] for p in q.recentProgress if p["stateOperators"]]
    assert {len(x) for x in states} == {2}
    # stretches that the watermark has passed are forgotten
    rows = [sum(o["numRowsTotal"] for o in x) for x in states]
    assert max(rows) > 20 and rows[-1] < max(rows) / 2
    kept = str(tmp_path / "kept")
    first = min(spark.read.format("state-metadata").load(kept).where("operatorProperties LIKE '%waiting%'").select("operatorId").distinct().collect())["operatorId"]
    state = lambda b: spark.read.format("statestore").option("path", kept).option("operatorId", first).option("stateVarName", "waiting").option("batchId", b).load()
    assert len({r.partition_id for b in range(len(states)) for r in state(b).select("partition_id").distinct().collect()}) > 1


def test_followed_by_join_makes_no_pairs(spark, tmp_path):
    """An A meets its first B only, however many lie in its limit; microseconds count, equal A's are one."""
    at = lambda us: F.timestamp_micros(F.lit(1_700_000_000_000_000) + us)
    many = spark.range(400).select(F.col("id"), at(F.col("id") * 1000).alias("ts"), F.lit("k").alias("key"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))
    close = spark.createDataFrame([(900, 900_700, "k", "a"), (901, 900_200, "k", "b"), (-5, 950_100, "k", "a"), (-5, 950_100, "k", "a"), (-7, 950_100, "k", "b"), (903, 990_000, "k", "b"), (904, 99_000_000_000, "k", "b")], "id long, us long, key string, kind string")
    df = many.unionByName(close.select("id", at(F.col("us")).alias("ts"), "key", "kind"))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    stream = readers.with_event_time(readers.files(spark, path, df.schema, "parquet"), "ts")
    how = (F.expr("kind = 'a'"), F.expr("kind = 'b'"), ["key"], "ts", ["id"], "1 hour")
    live = J.followed_by_join(stream, *how)
    assert "Join" not in live._jdf.queryExecution().analyzed().toString()
    want = [(2 * k, 2 * k + 1) for k in range(200)] + [(900, -7), (-5, 903)]
    assert sorted((r.a_id, r.b_id) for r in run(spark, live, "tw_no_pairs")) == sorted(want)
    assert sorted((r.a_id, r.b_id) for r in J.followed_by_join(df, *how).collect()) == sorted(want)


class _Visited:
    """A state that counts visits, for one key."""

    def __init__(self):
        self.visits, self.kept = 0, {}

    def getMapState(self, name, *_):
        return _Place(self, name)

    getValueState = getMapState

    def registerTimer(self, at):
        self.visits += 1

    deleteTimer = registerTimer


class _Place:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _all(self):
        self.handle.visits += 1
        return self.handle.kept.setdefault(self.name, {})

    def exists(self):
        return bool(self._all())

    def get(self):
        return self._all().get(())

    def update(self, value):
        self._all()[()] = value

    def clear(self):
        self._all().clear()

    def keys(self):
        return list(self._all())

    def iterator(self):
        return list(self._all().items())

    def getValue(self, key):
        return self._all()[key]

    def updateValue(self, key, value):
        self._all()[key] = value

    def removeKey(self, key):
        del self._all()[key]


@pytest.mark.parametrize("n", [20, 2000])
@pytest.mark.parametrize("family", ["followed_by", "repeat_until"])
def test_a_key_is_visited_seldom(family, n):
    """Events that wait once cost few visits to the state for each key, not several for each thing kept; nothing is left or lost, however many there are."""
    if family == "followed_by":
        rule, stages = S._Patterns([("a", 1, 1, None, True), ("b", 1, 1, None, True)], None, "next", False, ("match",)), 2
        flags, expected = lambda k: ("1000", "0100")[k % 2], n // 2
    else:
        rule, stages = S._Patterns([("a", 2, None, None, True)], None, "past_last", False, ("match",)), 1
        flags, expected = lambda k: "10", n // 2
    made = S._Sequence(rule, stages)
    made.init(handle := _Visited())
    fresh = [(5_000_000 + k, f"{k:024}", json.dumps({"id": k}), flags(k)) for k in range(n)]
    assert list(made._turn(("u", ""), fresh, 0, None)) == []
    found = list(made._turn(("u", ""), [], 9_000, 5_000))
    assert sorted(tuple(e["event"]["id"] for e in json.loads(r.events)) for r in found) == [(k, k + 1) for k in range(0, n, 2)] and len(found) == expected
    assert not any(handle.kept.values())
    if n == 20:
        assert handle.visits <= 6


def test_keys_share_the_state(spark, tmp_path):
    """Timers and clocks follow the buckets, not the keys; odd keys stay apart."""
    path = str(tmp_path / "in")
    odd = F.when(F.col("id") % 3000 < 2, F.concat(F.lit('a"\n,]é\x1f'), F.col("id") % 3000)).otherwise((F.col("id") % 3000).cast("string"))
    df = spark.range(12_000).select(F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), odd.alias("key"), F.when(F.col("id") < 9000, "a").otherwise("z").alias("kind"))
    df.coalesce(1).write.parquet(path)
    stream = readers.with_event_time(readers.files(spark, path, df.schema, "parquet"), "ts")
    found = S.match_stream(stream, [Stage("a", F.expr("kind = 'a'"), 3, None, until=F.expr("kind = 'b'"))], ["key"], "ts", ["id"], skip="past_last", kinds=("match",))
    q = found.writeStream.format("memory").queryName("tw_shared").option("checkpointLocation", str(tmp_path / "kept")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("tw_shared").collect()
    assert sorted(tuple(e["event"]["id"] for e in json.loads(r.events)) for r in got) == [(k, k + 3000, k + 6000) for k in range(3000)]
    assert {r.signature for r in got} == {r.key for r in df.select("key").distinct().collect()}
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"]]
    assert 0 < max(timers) <= S._BUCKETS < 3000


class _Mild(_Place):
    def getValue(self, key):
        return self._all().get(key)


class _Kept(_Visited):
    def getMapState(self, name, *_):
        return _Mild(self, name)

    getValueState = getMapState


RULES = [
    lambda: S._Patterns([("a", 1, 1, None, True), ("b", 1, 1, None, True)], 60, "next", False, ("match", "timeout")),
    lambda: S._Patterns([("a", 3, None, None, True)], None, "past_last", False, ("match",)),
    lambda: S._Patterns([("a", 2, None, None, True), ("b", 1, 1, None, True)], 5_000, "past_last", False, ("match",)),
    lambda: S._RepeatThen(2, 300, False, True),
    lambda: S._RepeatThen(2, None, False, True),
    lambda: S._NotBefore(4, 25_000),
]


@pytest.mark.parametrize("which", range(len(RULES)))
@pytest.mark.parametrize("keys", [3, 40])
def test_keys_of_a_bucket_stay_apart(which, keys):
    """Many keys in one bucket over many turns give what each gives alone in one turn; there are more A's than stand together."""
    import random

    draw = random.Random(which)
    stages = len(RULES[which]().args[0]) if which < 3 else 2
    events = []
    for k in range(2400):
        who = json.dumps([f"u{draw.randrange(keys) if draw.random() < 0.5 else 0}", ""])
        kind = "b" if draw.random() < 0.01 + 0.2 * (who != '["u0", ""]') else "a"
        flags = {"a": "10" if stages == 1 else "1000", "b": "01" if stages == 1 else "0100"}[kind]
        events.append((1_000_000 + k * 1000, f"{k:024}", json.dumps({"id": k}), flags, who))
    within = lambda rule: setattr(rule, "args", (rule.args[0], rule.args[1] and rule.args[1] * 1000, *rule.args[2:])) if isinstance(rule, S._Patterns) else rule.within and setattr(rule, "within", rule.within * 1000)
    shown = lambda rows: sorted((r.signature, r.kind, r.start_ms, r.end_ms, r.events) for r in rows)

    def made(shared):
        within(rule := RULES[which]())
        one = S._Sequence(rule, stages, shared=shared)
        one.init(handle := _Kept())
        return one, handle

    alone = []
    for who in sorted({e[4] for e in events}):
        one, _ = made(False)
        mine = [e[:4] for e in events if e[4] == who]
        alone += list(one._turn((json.loads(who)[0], ""), mine, 900, None)) + list(one._turn((json.loads(who)[0], ""), [], 3_000, None))
    together, handle = made(True)
    got, mark = [], 900
    for at in range(0, len(events), 300):
        got += together._turn((7,), events[at : at + 300], mark, None)
        mark = 1_000 + at + 150
    visits = handle.visits
    got += together._turn((7,), [], 3_000, None)
    assert shown(got) == shown(alone) and got
    # what the last turns passed is late now
    assert list(together._turn((7,), [events[-1]], 3_000, None)) == []
    assert keys < 40 or visits < 1.2 * len(events)


def test_packs_keep_every_event(spark):
    """Events of a bucket as few rows of bounded size, with the latest time of each."""
    import pyarrow as pa

    n = 5000
    body = [json.dumps([str(k), "x" * (k % 50), '{"a": "\\n,"}', "10", '["k"]']) for k in range(n)]
    body[77] = json.dumps(["77", "y" * 30_000])
    schema = pa.schema([("bucket", pa.int32()), ("ts", pa.timestamp("us", tz="UTC")), ("body", pa.string())])
    parts = [pa.RecordBatch.from_arrays([pa.array([k * 7 % 11 for k in r], pa.int32()), pa.array(list(r), pa.int64()).cast(schema.field("ts").type), pa.array([body[k] for k in r])], schema=schema) for r in (range(0, 3000), range(3000, 3000), range(3000, n))]
    rows = [r for b in S._packs(iter(parts)) for r in b.to_pylist()]
    seen = []
    for r in rows:
        own = [int(e[0]) for e in json.loads(f"[{r['body']}]")]
        assert {k * 7 % 11 for k in own} == {r["bucket"]} and int(r["ts"].timestamp() * 1e6 + 0.5) == max(own)
        assert len(own) == 1 or len(r["body"]) < 2 * S._PACK + 30_000 * (77 in own)
        seen += own
    assert sorted(seen) == list(range(n)) and len(rows) < n / 20
    assert list(S._packs(iter([]))) == [] and list(S._packs(iter([parts[1]]))) == []
