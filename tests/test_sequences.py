"""Sequence rules against a plain matcher over random sequences, and hand-worked cases."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sequences as Q
from tidewatch.operators.automaton import Stage, match_pattern

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
A = B = None
TIE = ["id"]


@pytest.fixture(autouse=True)
def tests_of_events(spark):
    """Columns need a session."""
    global A, B
    A, B = F.col("kind") == "a", F.col("kind") == "b"


def rows_of(seed, n=400):
    r = random.Random(seed)
    t, out = 0, []
    for k in range(n):
        t += r.choice([0, 1, 1, 2, 5, 30])
        out.append((k, START + timedelta(seconds=t), r.choice(["u", "u", "u", "v", None]), r.choice("aabc"), r.choice(["x", "X", "y", None]), r.choice(["x", "y", None])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, ts timestamp, key string, kind string, p string, q string")


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        keys.setdefault(r[2], []).append(r)
    return keys.values()


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("within", [4, 20, None])
def test_random_sequences(spark, seed, within):
    rows = rows_of(seed)
    df, limit = frame(spark, rows), timedelta(seconds=within) if within else timedelta.max
    text = f"{within} seconds" if within else None
    ids = lambda found: sorted((r.a_id, r.b_id) for r in found.collect())
    relaxed, past, strict, run2, many2 = [], [], [], [], []
    for seq in by_key(rows):
        last_b = -1
        for i, r in enumerate(seq):
            if r[3] == "a":
                nxt = next((x for x in seq[i + 1 :] if x[3] == "b"), None)
                if nxt and nxt[1] - r[1] < limit:
                    relaxed.append((r[0], nxt[0]))
                if i + 1 < len(seq) and seq[i + 1][3] == "b" and seq[i + 1][1] - r[1] < limit:
                    strict.append((r[0], seq[i + 1][0]))
            if r[3] == "b":
                usable = [x for x in seq[last_b + 1 : i] if x[3] == "a" and r[1] - x[1] < limit]
                if usable:
                    past.append((usable[0][0], r[0]))
                if len(usable) >= 2:
                    many2.append((usable[0][0], r[0], len(usable)))
                k = i
                while k and seq[k - 1][3] == "a" and r[1] - seq[k - 1][1] < limit:
                    k -= 1
                if i - k >= 2:
                    run2.append((seq[k][0], r[0], i - k))
                last_b = i
    assert ids(Q.followed_by(df, A, B, ["key"], "ts", TIE, text)) == sorted(relaxed)
    assert ids(Q.followed_by(df, A, B, ["key"], "ts", TIE, text, skip="past_last")) == sorted(past)
    assert ids(Q.followed_by(df, A, B, ["key"], "ts", TIE, text, contiguity="strict")) == sorted(strict)
    times = lambda found: sorted((r.a_id, r.b_id, r.times) for r in found.collect())
    assert times(Q.repeated_then(df, A, B, 2, ["key"], "ts", TIE, text)) == sorted(many2)
    assert times(Q.repeated_then(df, A, B, 2, ["key"], "ts", TIE, text, contiguity="strict")) == sorted(run2)
    pairs = lambda found: sorted((r.events[0].event.id, r.events[-1].event.id) for r in found.collect())
    assert pairs(match_pattern(df, [Stage("a", A), Stage("b", B)], ["key"], "ts", TIE, text, skip="next")) == sorted(relaxed)
    assert pairs(match_pattern(df, [Stage("a", A), Stage("b", B)], ["key"], "ts", TIE, text)) == sorted(past)
    if within:
        alone = sorted(r[0] for r in rows if r[3] == "a" and r[0] not in dict(relaxed))
        assert sorted(r.id for r in Q.not_followed_by(df, A, B, ["key"], "ts", TIE, text).collect()) == alone


@pytest.mark.parametrize("silence", [None, 10])
def test_random_not_before(spark, silence):
    rows = rows_of(3)
    want, limit = [], timedelta(seconds=6)
    for seq in by_key(rows):
        a = alert = None
        for r in seq:
            if r[3] == "a":
                a = r
            elif r[3] == "b" and (a is None or r[1] - a[1] > limit) and (silence is None or alert is None or r[1] - alert > timedelta(seconds=silence)):
                want.append((r[0], a and a[0]))
                alert = r[1]
    found = Q.not_before(frame(spark, rows), A, B, "ts", TIE, "6 seconds", ["key"], ["key"], silence and f"{silence} seconds")
    assert sorted((r.b_id, r.a_id) for r in found.collect()) == sorted(want)


def test_relation_rekeys(spark):
    rows = rows_of(4)
    want = []
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, r in enumerate(order):
        if r[3] == "a" and r[4]:
            nxt = next((x for x in order[i + 1 :] if x[3] == "b" and x[5] and x[5].lower() == r[4].lower()), None)
            if nxt and nxt[1] - r[1] < timedelta(seconds=9):
                want.append((r[0], nxt[0]))
    df = frame(spark, rows)
    found = Q.followed_by(df, A, B, [], "ts", TIE, "9 seconds", relation=[("p", "q")])
    assert sorted((r.a_id, r.b_id) for r in found.collect()) == sorted(want)
    alone = Q.not_followed_by(df, A, B, [], "ts", TIE, "9 seconds", relation=[("p", "q")])
    assert sorted(r.id for r in alone.collect()) == sorted(r[0] for r in rows if r[3] == "a" and r[0] not in dict(want))


def seq(spark, text, gap=1):
    return frame(spark, [(k, START + timedelta(seconds=k * gap), "u", c, None, None) for k, c in enumerate(text)])


@pytest.mark.parametrize(
    ("text", "within", "want"),
    [("aaa", None, [(0, 1, 2)]), ("aaaaaa", None, [(0, 1, 2), (3, 4, 5)]), ("aabaaa", None, [(3, 4, 5)]), ("aacaca", None, [(0, 1, 3)]), ("aa", None, []), ("aaa", "2 seconds", []), ("aaa", "3 seconds", [(0, 1, 2)])],
)
def test_repeat_until(spark, text, within, want):
    found = match_pattern(seq(spark, text), [Stage("a", A, 3, None, until=B)], ["key"], "ts", TIE, within)
    assert sorted(tuple(e.event.id for e in r.events) for r in found.collect()) == want


def test_iterative_condition(spark):
    rising = lambda e, taken: not taken or e["id"] >= 2 * taken["a"][-1]["id"]
    found = match_pattern(seq(spark, "caaaab"), [Stage("a", A, 2, None, also=rising), Stage("b", B)], ["key"], "ts", TIE)
    assert [[e.event.id for e in r.events] for r in found.collect()] == [[1, 2, 4, 5]]


def test_pairs_that_overlap(spark):
    found = Q.followed_by(seq(spark, "aaaa"), A, A, ["key"], "ts", TIE, contiguity="strict")
    assert sorted((r.a_id, r.b_id) for r in Q.non_overlapping(found, ["key"], "ts", TIE).collect()) == [(0, 1), (2, 3)]


def test_empty_and_missing(spark):
    empty = frame(spark, [])
    assert Q.followed_by(empty, A, B, ["key"], "ts", TIE, "3 seconds").isEmpty()
    assert Q.not_followed_by(empty, A, B, ["key"], "ts", TIE, "3 seconds").isEmpty()
    assert Q.not_before(empty, A, B, "ts", TIE, "3 seconds", silence="1 second").isEmpty()
    untimed = frame(spark, [(0, None, "u", "a", None, None), (1, START, None, "b", None, None)])
    assert Q.followed_by(untimed, A, B, ["key"], "ts", TIE).isEmpty()
    assert [r.b_id for r in Q.not_before(untimed, A, B, "ts", TIE, "3 seconds", ["key"], ["key"]).collect()] == [1]
    text = Q.match_text(Q.followed_by(seq(spark, "ab").select("id", "ts", "kind"), A, B, [], "ts", TIE).select("a_id", "b_id"), "a", "b").first()[0]
    assert text == 'A: [{"id":0}] B: [{"id":1}] '


def test_a_hot_key_costs_its_number_of_rows(spark):
    """150,000 events of one key within one limit: frames that are gone through anew for every row would take minutes."""
    import time

    df = spark.range(150_000).select(F.col("id"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id")).alias("ts"), F.lit("u").alias("key"), F.when(F.col("id") % 50_000 == 49_999, "b").otherwise("a").alias("kind"))
    began = time.time()
    assert Q.followed_by(df, A, B, ["key"], "ts", TIE, "10 minutes").count() == 149_997
    assert Q.not_followed_by(df, A, B, ["key"], "ts", TIE, "10 seconds").count() == 149_997 - 3 * 9_999
    assert [r.times for r in Q.repeated_then(df, A, B, 2, ["key"], "ts", TIE, "10 minutes").collect()] == [49_999] * 3
    assert time.time() - began < 60
