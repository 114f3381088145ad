"""Parts of a sequence, run apart and put together, against one automaton over the whole."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch import queries
from tidewatch.operators import composed as C
from tidewatch.operators.automaton import Automaton, Stage, match_pattern


def random_pattern(r):
    n = r.choice([1, 1, 2, 2, 3])
    stages, untils = [], []
    for k in range(n):
        low = r.choice([1, 1, 2, 3])
        high = r.choice([None, low, low + 1]) if low > 1 or r.random() < 0.4 else 1
        stages.append((f"s{k}", low, high, r.random() < 0.6))
        untils.append(high != 1 and r.random() < 0.5)
    return stages, untils


def whole(rows, stages, untils, strict):
    """rows: (key, flags, until) in order."""
    out, machines = [], {}
    for i, (key, flags, until) in enumerate(rows):
        m = machines.setdefault(key, Automaton([(s[0], s[1], s[2], None, s[3]) for s in stages], None, strict, True))
        for taken in m.step(i, {"i": i}, flags, until):
            out.append((key, sorted((e["i"], s) for s, es in taken.items() for e in es)))
    return sorted(out)


def in_parts(rows, machine, r):
    """The same through parts of random sizes, in batches of random sizes."""
    n = len(machine.plain)
    symbols = [sum(f << k for k, f in enumerate(flags)) | sum(until[k] << (n + at) for at, k in enumerate(machine.untils)) for _, flags, until in rows]
    cuts = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(r.randrange(6)))})
    parts = []
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        inner = sorted({a, b, *(r.randrange(a, b + 1) for _ in range(r.randrange(3)))})
        parts.append([pa.record_batch([pa.array([rows[i][0] for i in range(x, y)]), pa.array(symbols[x:y], pa.int32()), pa.array([3 * p] * (y - x), pa.int32()), pa.array(range(x, y), pa.int64())], ["__tw_k", "__tw_y", "__tw_p", "i"]) for x, y in zip(inner, inner[1:])])
    sums = [row for part in parts for b in C._sum_up(iter(part), machine) for row in b.to_pylist()]
    known = C._fold([(s["part"], s["first"], s["last"], *C.pickle.loads(s["data"])) for s in sums], machine)
    schema = pa.schema([("match_part", pa.int64()), ("match_event", pa.int64()), ("place", pa.int64()), ("stage", pa.int32()), ("i", pa.int64()), ("__tw_k", pa.string()), ("__tw_p", pa.int32())])
    found = {}
    for part in parts:
        for b in C._emit(iter(part), machine, known, schema):
            for e in b.to_pylist():
                found.setdefault((e["__tw_k"], e["match_part"], e["match_event"]), []).append((e["i"], machine.plain[e["stage"]][0]))
    return sorted((k[0], sorted(v)) for k, v in found.items())


@pytest.mark.parametrize("seed", range(8))
def test_random_patterns_in_random_parts(seed):
    r = random.Random(seed)
    matches = 0
    for _ in range(60):
        stages, untils = random_pattern(r)
        strict = r.random() < 0.3
        try:
            machine = C.Machine(stages, untils, strict)
        except C.TooLarge:
            continue
        keys = sorted(r.choice("uuuv") for _ in range(r.randrange(1, 80)))
        some = r.choice([0.2, 0.5, 0.8])
        rows = [(k, [r.random() < some for _ in stages], [u and r.random() < 0.15 for u in untils]) for k in keys]
        want = whole(rows, stages, untils, strict)
        assert in_parts(rows, machine, r) == want
        matches += len(want)
    assert matches > 100


def test_one_key_is_shared_out(spark):
    """No key: many parts, none with more than its share of the rows, and the matches of one automaton."""
    df = queries.events(spark, "/root/testdata/sf0.001").select("event_id", "ts", "event_type")
    stages = [Stage("a", F.expr("event_type = 'view'"), 2, None, greedy=False), Stage("b", F.expr("event_type IN ('purchase', 'click')")), Stage("c", F.expr("event_type = 'purchase'"))]
    rows = sorted((r.ts, r.event_id, r.event_type) for r in df.collect())
    flagged = [("All", [t == "view", t in ("purchase", "click"), t == "purchase"], [False] * 3) for _, _, t in rows]
    want = [[rows[i][1] for i, _ in taken] for _, taken in whole(flagged, [("a", 2, None, False), ("b", 1, 1, True), ("c", 1, 1, True)], [False] * 3, False)]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        found = match_pattern(df, stages, [], "ts", ["event_id"])
        assert sorted([e.event.event_id for e in r.events] for r in found.collect()) == sorted(want) and want
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_parts_are_even(spark, monkeypatch):
    seen = []
    real = C._fold
    monkeypatch.setattr(C, "_fold", lambda parts, machine: seen.append(parts) or real(parts, machine))
    df = spark.range(20_000).select(F.col("id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 7 == 6, "b").otherwise("a").alias("kind"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = match_pattern(df, [Stage("a", F.expr("kind = 'a'"), 4, None, until=F.expr("kind = 'b'"))], [], "ts", ["id"])
        assert found.count() == 20_000 // 7 and len(seen[0]) == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_what_has_no_finite_machine(spark):
    with pytest.raises(C.TooLarge):
        C.machine_of([Stage("a", F.lit(True), also=lambda e, taken: True)], False)
    with pytest.raises(C.TooLarge):
        C.machine_of([Stage(f"s{k}", F.lit(True)) for k in range(9)], False)
    with pytest.raises(C.TooLarge):
        C.machine_of([Stage("a", F.lit(True), 500, None), Stage("b", F.lit(True))], False)


def test_no_events(spark):
    df = queries.events(spark, "/root/testdata/sf0.001").limit(0)
    assert match_pattern(df, [Stage("a", F.lit(True), 2, None)], [], "ts", ["event_id"]).collect() == []
