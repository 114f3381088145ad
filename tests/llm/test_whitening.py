import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import whitening as W


def brute(rows, k=16):
    """x of the rows that take part, the fit list's n and S, and eigenvalues and eigenvectors from the explicit covariance."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in ok), default=0)
    xs = [(i, [math.floor(64 * Fraction(float(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v))) for i, v in ok]
    fit = np.array(sorted({tuple(x) for _, x in xs}), object)
    sums = [sum(c) for c in fit.T]
    centred = (fit * len(fit) - np.array(sums, object)).astype(float) / len(fit)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    return xs, len(fit), sums, e[::-1][:k], u[:, ::-1][:, :k], float(e.sum())


def check(got, rows, k=16, close=1e-6):
    xs, n, sums, e, u, trace = brute(rows, k)
    count = len({r["component"] for r in got})
    assert len(got) == count * len(xs)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    signs = np.zeros(count)
    for i, x in xs:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ u[:, :count] / np.sqrt(e[:count])
        for c in range(count):
            found = by[i][c + 1]
            assert all(r["n"] == n for r in found) and dev in {r["deviation"] for r in found}
            assert all(abs(r["explained"] - e[c] / trace) <= 1e-9 for r in found) and all(r["identity_error"] <= 1e-4 for r in found)
            value = min((r["whitened"] for r in found), key=lambda v: abs(abs(v) - abs(want[c])))
            if abs(want[c]) > 1e-3:
                signs[c] = signs[c] or np.sign(value * want[c])
                assert abs(value * signs[c] - want[c]) < close
    return count


def test_against_an_explicit_covariance(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert check(W.op11_whitening(spark, "/root/testdata/sf0.01").collect(), rows) == 16


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + np.arange(7))]) for i in range(60)]
    rows += [(100, None), (101, [None] * 7), (102, [float("nan")] * 7), (103, [float("inf")]), (104, []), (105, [0.0] * 7), (106, [2.0, 1.0]), (107, [2.0, 1.0] + [0.0] * 5), (5, rows[5][1]), (5, rows[5][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS n", "2 AS x", "3 AS component", "4 AS i")
    got = W.whiten(df)
    assert got.count() == len(got.collect())
    assert check(got.collect(), rows) == 7
    assert check(W.whiten(df, k=3).collect(), rows, 3) == 3
    text = W.whiten(df.withColumn("vec_id", df.vec_id.cast("string")), k=2)
    assert dict(text.dtypes)["vec_id"] == "string" and text.count() == 2 * 67


def test_fewer_components_than_dimensions(spark):
    """Rank two in five dimensions: eigenvalues that are rounding give no component."""
    rows = [(i, [float(i), float(i % 7), float(i + i % 7), 0.0, 1.0]) for i in range(40)]
    assert check(W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect(), rows) == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_nothing_to_fit(spark, rows):
    assert W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect() == []


def test_large_components(spark):
    rows = [(i, [float(i), (-1.0) ** i * 2.0**50, float(i * i)]) for i in range(20)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=1).collect()
    assert {r["deviation"] for r in got} == {2**63 - 1} and {r["n"] for r in got} == {20}
    rows = [(0, [1e300]), (1, [-1e300]), (2, [0.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 3 and all(math.isfinite(r["whitened"]) for r in got)


def test_close_eigenvalues_need_the_shifts(spark):
    """A flat spectrum of 64 dimensions: certified in tens of passes, where unshifted iteration takes hundreds."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(0, 1, (4000, 64)))]
    fit = W.spill(W.distinct_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "embedding", 64, 1_000_000))
    centre = W.centre_of(fit, 1_000_000)
    _, n, _, e, u, trace = brute(rows)
    got, vectors, passes = W.components_of(fit, centre, trace, 16)
    assert n == centre.n and np.allclose(got, e, rtol=1e-12) and passes < 80
    assert np.allclose(np.abs((vectors * u).sum(axis=0)), 1, atol=1e-9)
