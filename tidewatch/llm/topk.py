"""Exact top-k by inner product, term at a time.

Vectors become integer weights, floor(scale * x); a zero weight has no posting. The
queries are dealt to blocks and so are the candidates, and each pair of blocks is one
unit of work: for one term after another, the postings of the candidate block (which
rows have the term, and with what weight) are scattered, times the weights of the query
rows that have it, into a dense array of scores. Each unit selects k candidates for
every query by partition, and only these meet: the last k are chosen among them. Every
query thus sees every candidate. A block holds about ``BLOCK_BYTES`` of weights: as many
blocks are made as all components together fill, so the memory of a task is bounded by
a block and its longest vector, and a vector travels once for each block of the other
side. Blocks are dealt by row number, not by
key, so repeated ids don't pile up.

Scores are exact. They are added up modulo 2**64, which is the score itself if that
fits into 64 bits; where the weights are so large that it might not, a second sum in
floating point with its error bound decides, and Python's integers the rest.

Defined results: vectors that are null or hold a null, NaN or infinite component take
no part. Missing components of a shorter vector count as zero, an empty vector has score 0 with all
others. A candidate is any other row than the query's own; rows with the query's id are
its own rows and excluded, so repeated rows each ask, and appear for others as often as
they occur. Null ids are candidates and never queries. Ties go to the smaller id, null
first. A score beyond 64 bits counts as the nearest 64-bit integer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.runtime import cut, ship, table

SCALE = 64
EVERY = 20
TOP = 20
BLOCK_BYTES = 16 << 20
#: Candidates that are worth a task of their own.
_LEAST_BLOCK = 1024
_TILE = 32
_LARGEST = 2**63 - 1


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(``id``, ``v``) of the vectors that take part; the components are scaled and rounded down where they are used."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


class Postings:
    """The weights of a block other than zero, by term: for each its rows, ascending, and their weights.

    A weight beyond the largest double is infinite in ``exact``; ``weight`` has it as a whole number.
    """

    def __init__(self, vectors: pa.ChunkedArray, scale: int = SCALE):
        arr = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        sizes = np.diff(arr.offsets.to_numpy())
        raw = arr.flatten().to_numpy()
        with np.errstate(over="ignore"):
            w = np.floor(raw * float(scale))
        self.n, self.terms = len(arr), int(sizes.max(initial=0))
        row = np.repeat(np.arange(self.n), sizes)
        term = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.flatnonzero(w)
        order = order[np.argsort(term[order], kind="stable")]
        self.rows, self.exact, self.raw, self.scale = row[order], w[order], raw[order], scale
        self.bounds = np.searchsorted(term[order], np.arange(self.terms + 1)).tolist()
        self.most = float(np.abs(self.exact).max(initial=0.0))

    def as_type(self, kind: type) -> np.ndarray:
        """The weights as integers modulo 2**64, or as floats."""
        if np.issubdtype(kind, np.floating):
            return self.exact
        # a double beyond the largest is a multiple of 2**64
        w = np.fmod(np.where(np.isinf(self.exact), 0.0, self.exact), 2.0**64)
        return (w - 2.0**64 * (w >= 2.0**63) + 2.0**64 * (w < -(2.0**63))).astype(np.int64).astype(kind)

    def weight(self, at: int) -> int:
        return int(self.exact[at]) if math.isfinite(self.exact[at]) else int(self.raw[at]) * self.scale


def accumulate(queries: Postings, qw: np.ndarray, candidates: Postings, cw: np.ndarray, first: int, last: int) -> np.ndarray:
    """Scores of the queries ``first`` … ``last - 1`` with all candidates; ``qw`` and ``cw`` are the weights of the postings.

    A candidate's scores lie side by side while they are added up. Postings of over half of the candidates are spread
    over all of them, with zeros, which adds up faster than it scatters.
    """
    n = candidates.n
    scores = np.zeros((n, last - first), cw.dtype)
    part, column = np.empty_like(scores), np.zeros(n, cw.dtype)
    for t in range(min(queries.terms, candidates.terms)):
        a, b = queries.bounds[t], queries.bounds[t + 1]
        a, b = a + np.searchsorted(queries.rows[a:b], (first, last))
        c, d = candidates.bounds[t], candidates.bounds[t + 1]
        if a == b or c == d:
            continue
        asks, has = queries.rows[a:b] - first, candidates.rows[c:d]
        if 2 * (b - a) < last - first:
            scores[has[:, None], asks[None]] += cw[c:d, None] * qw[None, a:b]
            continue
        weight = np.zeros(last - first, cw.dtype)
        weight[asks] = qw[a:b]
        if 2 * (d - c) > n:
            column[:] = 0
            column[has] = cw[c:d]
            np.multiply(column[:, None], weight[None], out=part)
            scores += part
        else:
            scores[has] += cw[c:d, None] * weight[None]
    return np.ascontiguousarray(scores.T)


def _fit(scores: np.ndarray, queries: Postings, candidates: Postings, first: int, last: int) -> None:
    """Put right what doesn't fit into 64 bits among ``scores``, which are known modulo 2**64."""
    with np.errstate(all="ignore"):
        near = accumulate(queries, queries.exact, candidates, candidates.exact, first, last)
        error = accumulate(queries, np.abs(queries.exact), candidates, np.abs(candidates.exact), first, last) * ((queries.terms + 4) * 2.0**-52)
        fits, above, below = np.abs(near) + error < 2.0**63, near - error >= 2.0**63, near + error < -(2.0**63)
    scores[above], scores[below] = _LARGEST, -_LARGEST - 1
    open_rows, open_cols = np.nonzero(~(fits | above | below))
    vectors: dict[tuple[bool, int], dict[int, int]] = {}

    def vector(p: Postings, row: int) -> dict[int, int]:
        key = (p is queries, row)
        if key not in vectors:
            at = np.flatnonzero(p.rows == row)
            vectors[key] = dict(zip((np.searchsorted(p.bounds, at, "right") - 1).tolist(), map(p.weight, at.tolist()), strict=True))
        return vectors[key]

    for i, j in zip(open_rows.tolist(), open_cols.tolist(), strict=True):
        q, c = vector(queries, first + i), vector(candidates, j)
        scores[i, j] = min(_LARGEST, max(-_LARGEST - 1, sum(x * c[t] for t, x in q.items() if t in c)))


def _best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query and their candidates, ties by the order of ``ids``, which is ascending."""
    at = np.flatnonzero(ids != own)
    s = scores[at]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        s, at = (np.r_[s[above], np.full(k - len(above), least)], np.r_[at[above], at[np.flatnonzero(s == least)[: k - len(above)]]])
    return s, at


def _score_blocks(key, left: pa.Table, right: pa.Table, k: int, scale: int) -> pa.Table:
    """left: a block of queries, right: a block of candidates."""
    if not left.num_rows or not right.num_rows:  # a side without the group has no rows
        return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    right = right.take(pc.sort_indices(right, [("cid", "ascending")], null_placement="at_start"))
    q, c = Postings(left["qv"], scale), Postings(right["cv"], scale)
    bound = q.most * c.most * max(1, min(q.terms, c.terms)) if q.most and c.most else 0.0
    kind = np.int32 if bound < 2**30 else np.int64
    qw, cw = q.as_type(kind), c.as_type(kind)
    # a null id is no query's own
    ids = pc.fill_null(right["cid"], np.iinfo(np.int64).min).to_numpy()
    qid, row = left["qid"].to_numpy(), left["row"].to_numpy()
    found = []
    for s in range(0, q.n, _TILE):
        e = min(q.n, s + _TILE)
        scores = accumulate(q, qw, c, cw, s, e)
        if not bound < 2**62:
            _fit(scores, q, c, s, e)
        found += [_best_of(scores[i], ids, qid[s + i], k) for i in range(e - s)]
    n = [len(x[0]) for x in found]
    at = np.concatenate([x[1] for x in found])
    return pa.table({"row": np.repeat(row, n), "query_id": np.repeat(qid, n), "vec_id": right["cid"].combine_chunks().take(pa.array(at)), "score": np.concatenate([x[0] for x in found]).astype(np.int64)})


def search(queries: DataFrame, candidates: DataFrame, k: int = TOP, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row of ``queries`` (``id``, ``v``) its k best rows of ``candidates``."""
    spark = queries.sparkSession
    ship(spark)
    queries, candidates = (cut(x.withColumn("row", F.monotonically_increasing_id())) for x in (queries.where("id IS NOT NULL"), candidates))
    parts = []
    for x in (queries, candidates):
        rows, size = x.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
        parts.append(max(1, math.ceil(size * 8 / block_bytes)))
    # small tables too give every core something to do; rows is now the number of candidates
    parts[1] = max(parts[1], min(math.ceil(spark.sparkContext.defaultParallelism / parts[0]), math.ceil(rows / _LEAST_BLOCK)))
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # the two sides may come from one table: without a name in common, the planner can't take a column of one for the other's
    left = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"), "row", block(parts[0], 0).alias("qg"), every(parts[1]).alias("qh"))
    right = candidates.select(F.col("id").alias("cid"), F.col("v").alias("cv"), every(parts[0]).alias("cg"), block(parts[1], 1).alias("ch"))
    best = left.groupBy("qg", "qh").cogroup(right.groupBy("cg", "ch")).applyInArrow(lambda key, a, b: _score_blocks(key, a, b, k, scale), "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_neighbours(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, every: int = EVERY, k: int = TOP) -> DataFrame:
    """The k best of all rows for each row whose id is divisible by ``every``."""
    rows = usable(vectors, vec_id, vector)
    return search(rows.where(F.pmod("id", F.lit(every)) == 0), rows, k, scale)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_neighbours(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH w AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([x[1] * x[2] FOR x IN list_zip(q.w, c.w)])::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
