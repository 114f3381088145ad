import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import topk as K


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i is None or i % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), j is not None, j or 0) for j, w in ok if j != i)[:k]
        out += [(i, r + 1, j if real else None, -s) for r, (s, real, j) in enumerate(scored)]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8).round(1 if i % 3 else 4)]) for i in range(130)]
    rows += [(20, [0.5] * 8), (20, [0.5] * 8), (None, [0.1] * 8), (200, None), (220, [float("nan")] * 8), (240, [None] * 8), (260, [float("inf")]), (280, []), (300, [1.0, -1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS row", "2 AS id", "3 AS score")
    got = sorted(map(tuple, K.top_neighbours(df).collect()), key=str)
    assert got == brute(rows)
    w = K.usable(df, "vec_id", "embedding")
    blocks = K.search(w.where("pmod(id, 20) = 0"), w, 20, block_bytes=8 * 8 * 11)
    assert sorted(map(tuple, blocks.collect()), key=str) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in K.top_neighbours(df).collect()] == [(0, 1, 1, 8192)]
    assert K.top_neighbours(df.limit(0)).collect() == []
    assert K.top_neighbours(df.where("vec_id = 0")).collect() == []


def test_whatever_is_asked_of_the_result(spark):
    """Counting, adding up, filtering and joining see the rows that collecting sees."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want, got = brute(rows), K.top_neighbours(df)
    assert got.count() == len(want) and not got.isEmpty()
    assert tuple(got.agg(K.F.sum("score"), K.F.count("vec_id")).first()) == (sum(r[3] for r in want), len(want))
    assert got.where("rank = 1").count() == 4 and got.select("query_id").distinct().count() == 4
    assert got.join(df, "vec_id").count() == len(want)


def test_one_long_vector(spark, monkeypatch):
    rows = [(i, [1.0, float(i)]) for i in range(60)] + [(60, [0.5] * 20_000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    groups = []
    real = K.math.ceil
    monkeypatch.setattr(K.math, "ceil", lambda x: groups.append(real(x)) or real(x))
    got = K.top_neighbours(df)
    assert max(groups[:2]) == 1  # blocks by the bytes of all vectors, not by the longest
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_large_weights(spark):
    top = 2**63 - 1
    rows = [(0, [float(2**26), 0.0]), (20, [0.0, float(2**22)]), (1, [1.0, 1.0]), (2, [1e300, -1e300]), (40, [1e300, 1e300]), (3, [2.0**40, 2.0**40 + 1]), (60, [2.0**17, -(2.0**17)]), (4, [-1e12, 1.0]), (80, [1e12, 0.0]), (5, [1.7e308]), (6, [2.0**56, 0.0]), (7, [-1.7e308, 1.7e308]), (8, [-1.6e308, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute(rows, 20)
    clamp = lambda s: min(top, max(-top - 1, s))
    order = {}
    for q, _, v, s in want:
        order.setdefault(q, []).append((-clamp(s), v))
    expected = sorted(((q, k + 1, v, -s) for q, x in order.items() for k, (s, v) in enumerate(sorted(x))), key=str)
    assert sorted(map(tuple, K.top_neighbours(df).collect()), key=str) == expected
    assert any(r[3] == top for r in expected) and any(0 < abs(r[3]) < top for r in expected)


def test_sparse_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) if rng.random() < 0.2 else 0.0 for x in rng.normal(0, 1, 40)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, K.top_neighbours(df).collect()), key=str) == brute(rows)
    p = K.Postings(df.orderBy("vec_id").select("embedding").toArrow()["embedding"])
    assert len(p.rows) == sum(math.floor(64 * x) != 0 for _, v in rows for x in v)
