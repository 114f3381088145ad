"""Packing documents into sequences by the harmonic method.

A piece of length n belongs to class k if capacity / (k + 1) < n <= capacity / k,
and a sequence of class k takes exactly k pieces, so a worker needs to know nothing
but how many pieces wait in each of its classes: it fills sequences on its own, in
one pass, without a shuffle and with bounded memory.

Documents are cut so that the classes fill well: first pieces of the whole capacity,
then powers of two down to ``TAIL``, which fill their sequences exactly, and last a
tail of at most ``TAIL`` tokens, kept whole. A sequence of class k of tails wastes
less than 1 / (k + 1), and tails hold few of the tokens. What waits at the end of a
partition (fewer than k pieces of a class) is cut into powers of two, and the last
sequences have a power-of-two length, which needs no padding.

Defined results: null text counts as empty; its document is the end id alone. Each
row is a document of its own, repeated or not; null ids pass through. An empty table
gives no pieces. Sequence ids are unique in a result and not consecutive: the
partition in the high bits, a count in the low ones.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.fastencode import encoder
from tidewatch.llm.runtime import ship, table

CAPACITY = 1024
TAIL = 64
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
_SEQUENCE_BITS = 40
#: (document, start, length) of a piece; documents are numbered within the partition's open work.
Piece = tuple[int, int, int]


def cut_lengths(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > tail:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out + [n] * (n > 0)


def halves(start: int, n: int) -> Iterator[tuple[int, int]]:
    """(start, length) of power-of-two parts, the largest first."""
    while n:
        p = 1 << (n.bit_length() - 1)
        yield start, p
        start, n = start + p, n - p


class HarmonicPacker:
    """Sequences of one worker. ``add`` and ``finish`` give finished sequences as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, tail: int = TAIL):
        if capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.tail = capacity, tail
        self.even: dict[int, list[Piece]] = defaultdict(list)  # by length, a power of two
        self.tails: dict[int, list[Piece]] = defaultdict(list)  # by class

    def _put(self, classes: dict[int, list[Piece]], name: int, count: int, piece: Piece) -> Iterator[list[Piece]]:
        waiting = classes[name]
        waiting.append(piece)
        if len(waiting) == count:
            yield classes.pop(name)

    def add(self, doc: int, n: int) -> Iterator[list[Piece]]:
        start = 0
        for length in cut_lengths(n, self.capacity, self.tail):
            piece, k = (doc, start, length), self.capacity // length
            start += length
            yield from self._put(self.even, length, k, piece) if length & (length - 1) == 0 else self._put(self.tails, k, k, piece)

    def finish(self) -> Iterator[list[Piece]]:
        for waiting in self.tails.values():
            for doc, start, n in waiting:
                for s, p in halves(start, n):
                    yield from self._put(self.even, p, self.capacity // p, (doc, s, p))
        self.tails.clear()
        for _, waiting in sorted(self.even.items()):
            for s, count in halves(0, len(waiting)):
                yield waiting[s : s + count]
        self.even.clear()


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, tail: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, packer = encoder(path), HarmonicPacker(capacity, tail)
    sequence = TaskContext.get().partitionId() << _SEQUENCE_BITS
    docs: dict[int, list] = {}  # those with waiting pieces: id, ids, pieces to come
    key_type = None
    made: list[tuple] = []

    def close(pieces: list[Piece]) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, n in pieces:
            d = docs[doc]
            part = d[1][start : start + n].tobytes()
            made.append((d[0], start, n, zlib.crc32(part), len(d[1]), sequence, offset, part))
            offset += n
            d[2] -= n
            if not d[2]:
                del docs[doc]
        sequence += 1

    def flush() -> pa.RecordBatch:
        cols = list(zip(*made, strict=True)) or [()] * 8
        kinds = [key_type, *[pa.int64()] * 6, pa.binary()]
        made.clear()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 8 if with_ids else 7], names=names[: 8 if with_ids else 7])

    number, end = 0, np.array([end_id], np.uint32)
    for b in batches:
        key_type = b.schema.field(0).type
        for key, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
            ids = np.concatenate([ids, end])
            docs[number] = [key, ids, len(ids)]
            for pieces in packer.add(number, len(ids)):
                close(pieces)
            if number in docs and len(ids) >= capacity:  # pieces of the whole capacity never wait
                done = len(ids) - len(ids) % capacity
                docs[number][1] = _Rest(ids[done:].copy(), done, len(ids))
            number += 1
            if len(made) >= 8192:
                yield flush()
    for pieces in packer.finish():
        close(pieces)
    if key_type is not None:
        yield flush()


class _Rest:
    """The end of an id sequence, addressed as the whole."""

    def __init__(self, ids: np.ndarray, skipped: int, n: int):
        self.ids, self.skipped, self.n = ids, skipped, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, s: slice) -> np.ndarray:
        return self.ids[s.start - self.skipped : s.stop - self.skipped]


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tail: int = TAIL, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its place in its document and in its sequence; ``with_ids`` adds its ids (little-endian uint32)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(lambda b: _pack_batches(b, path, capacity, tail, end_id, with_ids), schema)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
