from datetime import datetime, timedelta, timezone

import pytest

from tidewatch.operators import windows as W

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROWS = [(START + timedelta(seconds=s), k, v) for s, k, v in [(0, "u", "1200"), (3, "u", "1200"), (9, None, "x"), (10, "u", None), (11, "v", "5"), (15, "v", "5.5"), (25, "u", "1"), (30, "u", "1")]] + [(None, "u", "9")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "ts timestamp, key string, amount string").cache()


def brute(size, slide, agg, keep=lambda v: True):
    out = []
    for w in range(-size, 60, 1):
        if w % slide:
            continue
        keys = {}
        for t, k, v in ROWS:
            if t is not None and w <= (t - START).total_seconds() < w + size:
                keys.setdefault(k or "None", []).append(v)
        out += [(k, w, agg(v)) for k, v in keys.items() if keep(agg(v))]
    return sorted(out)


def found(df, value):
    return sorted((r.key, int((r.window_start.replace(tzinfo=timezone.utc) - START).total_seconds()), r[value]) for r in df.collect())


@pytest.mark.parametrize(("size", "slide"), [(10, 1), (10, 5), (10, 4), (10, 10)])
def test_hopping(df, size, slide):
    args = (f"{size} seconds", f"{slide} seconds")
    number = lambda v: sum(float(x) if x and x != "x" else 0.0 for x in v)
    assert found(W.having_count(df, ["key"], "ts", *args), "cnt") == brute(size, slide, len)
    assert found(W.having_count(df, ["key"], "ts", *args, least=2), "cnt") == brute(size, slide, len, lambda v: v >= 2)
    assert found(W.having_sum(df, ["key"], "ts", "amount", *args), "total") == brute(size, slide, number)
    assert found(W.having_sum(df, ["key"], "ts", "amount", *args, least=5), "total") == brute(size, slide, number, lambda v: v > 5)
    assert found(W.having_count_distinct(df, ["key"], "ts", "amount", *args), "cnt") == brute(size, slide, lambda v: len({x or "None" for x in v}))


def test_tumbling_without_keys(df):
    got = W.having_count(df, [], "ts", "10 seconds").collect()
    assert sorted(r.cnt for r in got) == [1, 1, 3, 3]


def test_sessions_merge_at_the_gap(df):
    got = sorted((r.key, r.cnt) for r in W.session_count(df, ["key"], "ts", "5 seconds").collect())
    assert got == [("None", 1), ("u", 1), ("u", 2), ("u", 2), ("v", 2)]


def test_empty(spark, df):
    none = df.limit(0)
    assert W.having_count(none, ["key"], "ts", "10 seconds", "5 seconds").isEmpty()
    assert W.having_count_distinct(none, [], "ts", "key", "10 seconds", "5 seconds").isEmpty()
    with pytest.raises(ValueError, match="no interval"):
        W.millis("soon")
