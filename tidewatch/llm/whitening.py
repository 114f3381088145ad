"""Whitening of vectors by matrix-free block subspace iteration.

The covariance matrix is never formed. A block Q of orthonormal columns, twice as many
as the components asked for, is refined pass by pass: each pass is a Spark job over the
distinct vectors X, in which every partition adds up Xᵀ(XQ) of its centred rows, and
the sums of the partitions meet by dimension. Of such a pass, the Rayleigh-Ritz
procedure gives the best estimates within the block, and their residuals |Vq - eq|
certify them: the iteration ends when all components' residuals are at rounding level.
Else the next block is the orthonormal basis (QR) of (V - s)Q. The shift s is moved
about the unwanted part of the spectrum (Leja points between an estimate of its lower
end and the block's smallest Ritz value), which damps it far faster than no shift does;
if the shifts ever lose ground they go back to the bound 0, below which a covariance
has no eigenvalue.

Sums of the whole-number components are exact at any size. The rows are centred in two
steps, whole part first, so no precision goes to a large mean.

Defined results: vectors that are null or hold a null, NaN or infinite component are
dropped, all other rows are returned, repeated ones and null ids too; they enter the
fit once for each distinct vector. Missing components of a shorter vector count as
zero, so an empty vector is all zeros. A component beyond 64 bits counts as the nearest
64-bit number, and so does a deviation. There are as many components as the covariance
has positive eigenvalues (to rounding), ``k`` at most: none, and so no rows, for an
empty table, for a single distinct vector, or for empty vectors only. The sign of a
component is such that its largest entry is positive; within equal eigenvalues any
basis may come, the same for all rows. Other columns are ignored.

The driver holds the block (dimensions x 2k), the tasks that and a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.runtime import ship, spill, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: A residual of this share of the largest eigenvalue certifies a component.
TOLERANCE = 1e-13
#: Where rounding doesn't let it get so far, this will do once passes no longer help.
_SETTLED = 1e-11
_MOST_PASSES = 2000
#: Eigenvalues below this share of the largest are rounding.
_RANK = 1e-12
_TILE = 1 << 21


def whole_rows(vectors: pa.Array | pa.ChunkedArray, scale: int = SCALE, offset: int = OFFSET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, and those rows' x = floor(scale * c) + offset: lengths and components in one sequence, without trailing ``offset``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)[ends[0] : ends[-1]]
    sizes, ends = np.diff(ends), ends - ends[0]
    row = np.repeat(np.arange(len(sizes)), sizes)
    wrong = np.bincount(row, ~np.isfinite(flat), len(sizes)) > 0
    takes = ~wrong & ~vectors.is_null().to_numpy(zero_copy_only=False)
    top = np.iinfo(np.int64).max
    with np.errstate(over="ignore", invalid="ignore"):
        w = np.floor(flat * scale)
        x = np.where(w >= 2.0**63 - offset, top, np.where(w <= -(2.0**63), -top - 1, w.astype(np.int64)) + offset)
    # the length without trailing components that are zero
    filled = np.zeros(len(sizes), np.int64)
    at = np.flatnonzero(x != offset)
    np.maximum.at(filled, row[at], at + 1 - ends[row[at]])
    keep = takes[row] & (np.arange(len(x)) - ends[row] < filled[row])
    return takes, filled[takes], x[keep]


def _padded(lengths: np.ndarray, flat: np.ndarray, dims: int, offset: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of full length in tiles: the first row's number, and the tile."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    step = max(1, _TILE // max(1, dims))
    for a in range(0, len(lengths), step):
        b = min(len(lengths), a + step)
        tile = np.full((b - a, dims), offset, np.int64)
        size = lengths[a:b]
        tile[np.repeat(np.arange(b - a), size), np.arange(ends[b] - ends[a]) - np.repeat(ends[a:b] - ends[a], size)] = flat[ends[a] : ends[b]]
        yield a, tile


def _stored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x")
    ends = x.offsets.to_numpy().astype(np.int64)
    return np.diff(ends), x.values.to_numpy()[ends[0] : ends[-1]]


@dataclass
class Centre:
    """The sums of the distinct vectors by dimension, exact."""

    n: int
    sums: list[int]
    offset: int

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s - int(b) * self.n) / self.n for s, b in zip(self.sums, self.base, strict=True)])

    @property
    def dims(self) -> int:
        return len(self.sums)

    def rows(self, tile: np.ndarray) -> np.ndarray:
        small = np.abs(tile).max(initial=0) < 2**62 and np.abs(self.base).max(initial=0) < 2**62
        return (tile - self.base if small else tile.astype(np.float64) - self.base.astype(np.float64)) - self.rest

    def deviations(self, tile: np.ndarray) -> np.ndarray:
        """For each row the sum of (n * x - S)**2, in whole numbers."""
        most = self.n * float(np.abs(tile.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 2.0**62:
            d = tile * self.n - np.array(self.sums, np.int64)
            if float((d.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0**62:
                return (d * d).sum(axis=1)
        top = np.iinfo(np.int64).max
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in tile.tolist()]
        return np.array([min(top, e) for e in exact], np.int64)


def distinct_rows(vectors: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """``x``: each distinct vector of whole numbers once."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, lengths, flat = whole_rows(b.column(0), scale, offset)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))], ["x"])

    return vectors.select(F.col(vector).cast("array<double>")).mapInArrow(whole, "x array<bigint>").distinct()


def centre_of(fit: DataFrame, offset: int) -> Centre | None:
    """Sums of ``x`` by dimension; each partition sends one row for each dimension and batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, flat = _stored(b)
            dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            most = int(lengths.max(initial=0))
            # halves of 32 bits, so that no sum of a batch can overflow
            high, low, met = np.zeros(most, np.int64), np.zeros(most, np.int64), np.bincount(dim, minlength=most)
            np.add.at(high, dim, flat >> 32)
            np.add.at(low, dim, flat & 0xFFFFFFFF)
            # the row for dimension -1 counts the vectors
            yield pa.record_batch([pa.array(np.arange(-1, most)), pa.array(np.r_[0, high]), pa.array(np.r_[0, low]), pa.array(np.r_[len(lengths), met].astype(np.int64))], ["dim", "high", "low", "met"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(sums, "dim bigint, high bigint, low bigint, met bigint").groupBy("dim").agg(wide("high"), wide("low"), F.sum("met").alias("met")).orderBy("dim").collect()
    if not rows:
        return None
    n = int(rows[0]["met"])
    return Centre(n, [(int(r["high"]) << 32) + int(r["low"]) + (n - int(r["met"])) * offset for r in rows[1:]], offset)


def _by_partition(fit: DataFrame, centre: Centre, height: int, width: int, add) -> np.ndarray:
    """The sum over all rows of a ``height`` x ``width`` matrix, to which ``add`` adds a tile of centred rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((height, width)), False
        for b in batches:
            for _, tile in _padded(*_stored(b), centre.dims, centre.offset):
                add(total, centre.rows(tile))
                some = True
        if some:
            yield pa.record_batch([pa.array(np.arange(height)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["i", *(f"y{j}" for j in range(width))])

    columns = [f"y{j}" for j in range(width)]
    rows = fit.mapInArrow(parts, f"i bigint, {', '.join(f'{c} double' for c in columns)}").groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((height, width))
    out[rows["i"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], axis=1)
    return out


def multiply(fit: DataFrame, centre: Centre, q: np.ndarray) -> np.ndarray:
    """V q without V: one pass over the vectors."""

    def add(total: np.ndarray, rows: np.ndarray) -> None:
        total += rows.T @ (rows @ q)

    return _by_partition(fit, centre, centre.dims, q.shape[1], add) / centre.n


class Shifts:
    """Where to damp next: Leja points of the interval that the unwanted eigenvalues lie in."""

    def __init__(self, dims: int):
        self.dims, self.past, self.safe, self.best = dims, [], False, -np.inf

    def next(self, ritz: np.ndarray, wanted: int, trace: float) -> float:
        """``ritz``: falling Ritz values of the block."""
        gained = float(ritz[:wanted].sum())
        if gained < self.best * (1 - 1e-9):  # what lies below the interval grows faster than what is wanted
            self.safe, self.past = True, []
        self.best = max(self.best, gained)
        high = float(ritz[-1])
        left = self.dims - len(ritz)
        low = 0.0 if self.safe or not left else max(0.0, min(high, 2 * (trace - float(ritz.sum())) / left - high))
        grid = np.linspace(low, high, 257)
        if self.past:
            with np.errstate(divide="ignore"):
                height = sum(np.log(np.abs(grid - s)) for s in self.past[-24:])
            self.past.append(float(grid[int(np.argmax(height))]))
        else:
            self.past.append((low + high) / 2)
        return self.past[-1]


def components_of(fit: DataFrame, centre: Centre, trace: float, k: int, seed: int = 0, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues of the covariance, falling, their unit eigenvectors as columns, and the passes taken."""
    d = centre.dims
    width = min(d, 2 * k)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    shifts, best, stalled = Shifts(d), np.inf, 0
    for passes in range(1, _MOST_PASSES + 1):
        z = multiply(fit, centre, q)
        h = q.T @ z
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        u, vu = q @ turn, z @ turn
        count = int(min(k, (ritz > _RANK * ritz[0]).sum())) if ritz[0] > 0 else 0
        largest = max(float(ritz[0]), np.finfo(float).tiny)
        residual = float(np.linalg.norm(vu[:, : max(1, count)] - u[:, : max(1, count)] * ritz[: max(1, count)], axis=0).max()) / largest
        stalled = 0 if residual < best / 2 else stalled + 1
        best = min(best, residual)
        if residual <= tolerance or stalled >= 4 and residual <= _SETTLED:
            u = u[:, :count] * np.sign(u[np.abs(u[:, :count]).argmax(axis=0), np.arange(count)])
            return ritz[:count], u, passes
        q = np.linalg.qr(vu - shifts.next(ritz, k, trace) * u)[0]
    raise RuntimeError(f"residual {residual:.3g} of the largest eigenvalue after {_MOST_PASSES} passes")


_COLUMNS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each vector that takes part and each of the k components; see ``_COLUMNS``.

    ``deviation`` is the sum over the dimensions of (n*x - S)**2, ``whitened`` the projection of x - S/n on the component
    over the square root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` the
    largest absolute entry of the whitened fit list's covariance minus the identity, measured in a pass of its own.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, {_COLUMNS}"
    empty = spark.createDataFrame([], schema)
    fit = spill(distinct_rows(vectors, vector, scale, offset))
    centre = centre_of(fit, offset)
    if centre is None or centre.n < 2 or not centre.dims:
        return empty

    def squares(total: np.ndarray, rows: np.ndarray) -> None:
        total[0, 0] += (rows * rows).sum()

    trace = float(_by_partition(fit, centre, 1, 1, squares)[0, 0]) / centre.n
    eigenvalues, u, _ = components_of(fit, centre, trace, k)
    count = len(eigenvalues)
    if not count:
        return empty
    turn = u / np.sqrt(eigenvalues)

    def spread(total: np.ndarray, rows: np.ndarray) -> None:
        w = rows @ turn
        total[:count] += w.T @ w
        total[count] += w.sum(axis=0)

    # an overlooked error of the components would show here: the whitened rows themselves are measured
    sums = _by_partition(fit, centre, count + 1, count, spread) / centre.n
    error = float(np.abs(sums[:count] - np.outer(sums[count], sums[count]) - np.eye(count)).max())
    explained = eigenvalues / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            takes, lengths, flat = whole_rows(b.column(1), scale, offset)
            ids = b.column(0).filter(pa.array(takes))
            for first, tile in _padded(lengths, flat, centre.dims, centre.offset):
                m = len(tile)
                each = np.repeat(np.arange(m), count)
                yield pa.record_batch(
                    [
                        ids.slice(first, m).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * count, centre.n, np.int64)),
                        pa.array(centre.deviations(tile)[each]),
                        pa.array((centre.rows(tile) @ turn).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * count, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
