"""Definitions that read other rows of a match, against a plain search."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidewatch.plans.matchsql import match_recognize

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(seed, n=300):
    r, t, out = random.Random(seed), 0, []
    for k in range(n):
        t += r.choice([1, 1, 2, 40])
        out.append((k, START + timedelta(seconds=t), r.choice(["u", "u", "v"]), r.choice("aaab"), r.randrange(10)))
    return out


def by_key(rows):
    keys = {}
    for r in rows:
        keys.setdefault(r[2], []).append(r)
    return list(keys.values())


def ask(spark, rows, pattern, defines, skip="PAST LAST ROW", within="60"):
    spark.createDataFrame(rows, "id int, ts timestamp, key string, kind string, v int").createOrReplaceTempView("tw_plain")
    first, last = pattern[0], pattern.strip("{},+2 ")[-1]
    out = match_recognize(spark, f"SELECT * FROM tw_plain MATCH_RECOGNIZE (PARTITION BY key ORDER BY ts MEASURES FIRST({first}.id) AS f, LAST({last}.id) AS l ONE ROW PER MATCH AFTER MATCH SKIP {skip} PATTERN ({pattern}) WITHIN INTERVAL '{within}' SECOND DEFINE {defines}) AS t", ("id",))
    return sorted((r["f"], r["l"]) for r in out.collect())


@pytest.mark.parametrize("seed", range(3))
def test_a_loop_then_a_row_that_reads_it(spark, seed):
    rows, want = rows_of(seed), []
    for seq in by_key(rows):
        for j, b in enumerate(seq):
            if b[3] != "b":
                continue
            start = j
            while start and seq[start - 1][3] == "a":
                start -= 1
            ok = [s for s in range(start, j - 1) if b[4] > seq[s][4] and seq[j - 1][4] >= seq[s][4] and b[1] - seq[s][1] < timedelta(seconds=60)]
            if ok:
                want.append((seq[ok[0]][0], b[0]))
    assert ask(spark, rows, "A{2,} B", "A AS A.kind = 'a', B AS B.kind = 'b' AND B.v > FIRST(A.v) AND LAST(A.v) >= FIRST(A.v)") == sorted(want) and want


@pytest.mark.parametrize("skip", ["PAST LAST ROW", "TO NEXT ROW"])
def test_fixed_lengths_that_read_each_other(spark, skip):
    rows, want = rows_of(7, 600), []
    for seq in by_key(rows):
        at = 0
        while at + 3 < len(seq):
            a, b1, b2, c = seq[at : at + 4]
            # B's rows are at least A's, the second no less than the first; C is above B's first
            if b1[4] >= a[4] and b2[4] >= a[4] and b2[4] >= b1[4] and c[4] > b1[4] and c[1] - a[1] < timedelta(seconds=60):
                want.append((a[0], c[0]))
                at += 4 if skip == "PAST LAST ROW" else 1
            else:
                at += 1
    got = ask(spark, rows, "A B{2} C", "A AS true, B AS B.v >= A.v AND B.v >= FIRST(B.v), C AS C.v > FIRST(B.v)", skip)
    assert got == sorted(want) and want


def test_quoted_names_stay(spark):
    rows = [(0, START, "u", "A.v", 1), (1, START + timedelta(seconds=1), "u", "b", 2)]
    assert ask(spark, rows, "A B", "A AS A.kind = 'A.v', B AS B.kind <> 'FIRST(A.v)' AND B.v > FIRST(A.v)") == [(0, 1)]


def test_what_may_not_read_other_rows(spark):
    with pytest.raises(ValueError, match="fixed length"):
        ask(spark, rows_of(1, 5), "A B+ C", "A AS true, B AS B.v > A.v, C AS true")
