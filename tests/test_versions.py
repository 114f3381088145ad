"""Groups as of an event's time, against replaying the messages one by one."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import versions as V

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "at timestamp, message string, name string, type string, intelligence_type string, contents array<string>"


def replay(log, at, value, group):
    """What a store that has seen all messages until ``at`` says."""
    info, held = {}, {}
    for when, message, name, kind, _, contents in sorted(log, key=lambda r: r[0]):
        if when > at:
            break
        module, ids, op = message.split(";")
        for i in {x.strip() for x in ids.split(",")}:
            if op == "delete":
                info.pop(i, None)
                held.pop(i, None)
            elif module == V.GROUP:
                info[i] = (name, kind)
            elif i in info:
                held[i] = contents or []
    found = False
    for i, (name, kind) in info.items():
        if group in (i, name) and i in held and value is not None:
            found |= any(_in(value, c) if kind == "ip" else c == value for c in held[i])
    return found


def _in(value, content):
    number = lambda t: sum(int(x) << s for x, s in zip(t.split("."), (24, 16, 8, 0)))
    if "-" in content:
        a, b = sorted(map(number, content.split("-")))
        return a <= number(value) <= b
    if "/" in content:
        base, bits = content.split("/")
        return number(value) >> (32 - int(bits)) == number(base) >> (32 - int(bits))
    return value == content


@pytest.mark.parametrize("seed", range(3))
def test_replayed_messages(spark, seed):
    r = random.Random(seed)
    pool = ["1.2.3.4", "1.2.0.0/16", "1.2.3.1-1.2.3.9", "9.0.0.0/8", "0.0.0.0-255.255.255.255", "7.7.7.7"]
    log, t = [], 0
    for _ in range(40):
        t += r.choice([1, 2, 5])
        module, op = r.choice([(V.CONTENTS, "edit")] * 3 + [(V.GROUP, "add"), (V.GROUP, "edit"), (V.GROUP, "delete")])
        ids = ", ".join(r.sample(["g", "h"], r.choice([1, 1, 2])))
        about = (r.choice(["x", "y"]), r.choice(["ip", "ip", "string"]), "") if module == V.GROUP and op != "delete" else (None, None, None)
        log.append((START + timedelta(hours=t), f"{module};{ids};{op}", *about, r.sample(pool, r.choice([0, 1, 3])) if module == V.CONTENTS else None))
    events = [(k, START + timedelta(hours=r.randrange(t + 5), minutes=r.choice([0, 30])), r.choice(["1.2.3.4", "1.2.9.9", "9.1.1.1", "7.7.7.7", "8.8.8.8", None])) for k in range(150)] + [(150, None, "1.2.3.4")]
    groups = V.VersionedGroups(V.parsed(spark.createDataFrame(log, LOG)))
    df = spark.createDataFrame(events, "id int, ts timestamp, v string").withColumns({c: F.lit("clash") for c in ("content", "span", "cell", "name")})
    hits = 0
    for group in ("g", "x", "nobody"):
        got = {x.id: x.hit for x in groups.mark(df, "ts", "v", group, "hit").collect()}
        want = {k: at is not None and replay(log, at, v, group) for k, at, v in events}
        assert got == want, group
        hits += sum(want.values())
    assert hits > 5


def test_messages_of_another_form(spark):
    for bad in ("reload", "intelligence;g;add", "other;g;edit", None):
        with pytest.raises(Exception, match="unexpected message"):
            V.parsed(spark.createDataFrame([(bad,)], "message string")).collect()
    assert sorted(r.group_id for r in V.parsed(spark.createDataFrame([("intelligence;a, b,a;edit",)], "message string")).collect()) == ["a", "b"]


def test_no_changes(spark):
    empty = V.parsed(spark.createDataFrame([], LOG))
    df = spark.createDataFrame([(1, START, "x")], "id int, ts timestamp, v string")
    assert [tuple(x)[-1] for x in V.VersionedGroups(empty).mark(df, "ts", "v", "g", "hit").collect()] == [False]
