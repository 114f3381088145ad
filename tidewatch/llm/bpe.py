"""Byte-level BPE in SQL: recursive DuckDB queries inside each partition.

A vocabulary of byte strings with ranks gives a merge table: every way to put a token
together from two others, with the rank of the result. A text's words are the matches
of the split pattern. The distinct words of a batch become rows (word, position,
token, right neighbour), and one recursive query for words of every length contracts
each word's leftmost pair of minimum rank until no pair is left. Later occurrences of
that pair go in the same step if no token made from the new one has a lower rank, so
that their turn would come next anyhow. The recursion is keyed by word and position and
a step returns only the rows it changes, so the memory is one state of each word, not
one for each step. Decoding joins the ids with the vocabulary and aggregates the bytes
in the order of their positions. A word that is a token itself is not taken apart.

Pieces already met stay in a bounded table of the worker process, and each worker
encodes and decodes its partition in one pass. Texts are cut into pieces where the
pattern ``CUTTABLE`` never joins what stands on both sides; with another pattern each
text is split whole. The engine never writes to disk.

Defined results: null text counts as empty and has no ids. Rows are neither dropped
nor merged; null and repeated ids pass through, other columns are ignored. The time
for one word grows with its length times the number of different merges in it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.fastencode import Pieces
from tidewatch.llm.runtime import ship, table

RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern whose texts may be cut.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTES_A_QUERY = 300_000
_IDS_A_QUERY = 400_000
_ROWS_OUT = 2048

#: A row is a token, with the position and token of its right neighbour and the rank of the pair they make. ``live``: the
#: words that the last step changed. ``o``: the occurrences of each word's minimum pair, numbered; those that share a token
#: with the one before are chained. ``c``: those that are contracted: the first, and every other one of a chain if that is
#: safe. A step gives the rows that go, those that take the new token, and those whose neighbour has changed.
_CONTRACT = """
WITH RECURSIVE t(w, pos, tok, next, after, rank) USING KEY (w, pos) AS (
  SELECT i.w, i.pos, i.tok, i.next, i.after, m.tok
  FROM (SELECT w, pos, tok, lead(pos) OVER v AS next, lead(tok) OVER v AS after FROM initial WINDOW v AS (PARTITION BY w ORDER BY pos)) i
  LEFT JOIN merges m ON m.l = i.tok AND m.r = i.after
  UNION
  (WITH live AS MATERIALIZED (
    SELECT * FROM recurring.t s WHERE s.tok IS NOT NULL AND s.w IN (SELECT w FROM t)
  ), o AS (
    SELECT w, pos, next, rank, coalesce(lag(next) OVER v = pos, false) AS chained, row_number() OVER v AS nth
    FROM live JOIN (SELECT w, min(rank) AS best FROM live GROUP BY w) b USING (w) WHERE rank = best
    WINDOW v AS (PARTITION BY w ORDER BY pos)
  ), c AS MATERIALIZED (
    SELECT w, pos, next, rank
    FROM (SELECT *, nth - max(CASE WHEN NOT chained THEN nth END) OVER (PARTITION BY w ORDER BY pos) AS behind FROM o)
    WHERE nth = 1 OR (behind % 2 = 0 AND rank IN (SELECT tok FROM safe))
  ), n AS (
    SELECT w, next AS pos, NULL AS tok, NULL AS next, NULL AS after FROM c
    UNION ALL
    SELECT c.w, c.pos, c.rank, gone.next, CASE WHEN far.w IS NULL THEN gone.after ELSE far.rank END
    FROM c JOIN live gone ON gone.w = c.w AND gone.pos = c.next LEFT JOIN c far ON far.w = gone.w AND far.pos = gone.next
    UNION ALL
    SELECT s.w, s.pos, s.tok, s.next, c.rank
    FROM live s JOIN c ON c.w = s.w AND c.pos = s.next ANTI JOIN c gone ON gone.w = s.w AND gone.next = s.pos
  )
  SELECT n.w, n.pos, n.tok, n.next, n.after, CASE WHEN n.tok IS NOT NULL THEN m.tok END FROM n LEFT JOIN merges m ON m.l = n.tok AND m.r = n.after)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE tok IS NOT NULL GROUP BY w
"""


class SqlBpe(Pieces):
    """Encoder and decoder over one rank file; texts are cut into pieces as for other byte-level encoders."""

    def __init__(self, path: str, pattern: str):
        super().__init__(True)
        self.split = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines() if path else ())}
        self.octet = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        parts = [(self.ranks[w[:k]], self.ranks[w[k:]], t) for w, t in self.ranks.items() for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        unsafe = {x for a, b, t in parts for x in (a, b) if t < x}
        made = pa.table({k: pa.array(v, pa.int32()) for k, v in zip(("l", "r", "tok"), zip(*parts, strict=True), strict=True)})
        safe = pa.table({"tok": pa.array(sorted({t for _, _, t in parts} - unsafe), pa.int32())})
        named = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [w.hex() for w in self.ranks]})
        for name, rows in (("merges", made), ("safe", safe), ("vocabulary", named)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS FROM given")
            self.con.unregister("given")
        self.cuttable = pattern == CUTTABLE

    def _odd(self, texts: pa.Array) -> pa.Array:
        return pc.or_(super()._odd(texts), not self.cuttable)

    def whole(self, text: str) -> bytes:
        words = self.split.findall(text)
        known = self._words_of(set(words))
        return b"".join(map(known.__getitem__, words))

    def _learn(self, pieces: list[str]) -> None:
        found = list(map(self.split.findall, pieces))
        known = self._words_of({w for words in found for w in words})
        for p, words in zip(pieces, found, strict=True):
            self.kept[p] = b"".join(map(known.__getitem__, words))

    def _words_of(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian uint32."""
        out, new = {}, []
        for w in words:
            data = w.encode("utf-8")
            if (t := self.ranks.get(data)) is not None:
                out[w] = t.to_bytes(4, "little")
            else:
                new.append((w, data))
        # words of about one length take about as many steps
        new.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end][1]) <= _BYTES_A_QUERY):
                size += len(new[end][1])
                end += 1
            out |= self._contract(new[at:end])
            at = end
        return out

    def _contract(self, words: list[tuple[str, bytes]]) -> dict[str, bytes]:
        sizes = np.fromiter((len(d) for _, d in words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        rows = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32), "tok": self.octet[np.frombuffer(b"".join(d for _, d in words), np.uint8)]})
        self.con.register("initial", rows)
        try:
            got = self.con.sql(_CONTRACT).to_arrow_table()
        finally:
            self.con.unregister("initial")
        ids = got["ids"].combine_chunks()
        flat, bounds = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_pylist()
        return {words[w][0]: flat[4 * bounds[k] : 4 * bounds[k + 1]] for k, w in enumerate(got["w"].to_pylist())}

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id sequence."""
        out, at = [], 0
        while at < len(docs):
            end, n = at, 0
            while end < len(docs) and (end == at or n + len(docs[end]) <= _IDS_A_QUERY):
                n += len(docs[end])
                end += 1
            sizes = [len(x) for x in docs[at:end]]
            rows = pa.table({"d": np.repeat(np.arange(end - at, dtype=np.int32), sizes), "pos": np.arange(n, dtype=np.int32), "id": np.concatenate(docs[at:end]).astype(np.int32)})
            self.con.register("given", rows)
            got = dict(self.con.sql("SELECT d, string_agg(hex, '' ORDER BY pos) FROM given JOIN vocabulary USING (id) GROUP BY d").fetchall())
            self.con.unregister("given")
            out += [bytes.fromhex(got.get(k, "")) for k in range(end - at)]
            at = end
        return out


@cache
def engine(path: str, pattern: str) -> SqlBpe:
    """One engine in each worker process."""
    return SqlBpe(path, pattern)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    e = engine(path, pattern)
    for b in batches:
        ids = pa.array((x.astype("<u4").tobytes() for x in e.encode(b.column(1))), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    e = engine(path, pattern)
    for b in batches:
        given = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e.decode(given), pa.binary())], names=["doc_id", "ids", "decoded"])


def _round_trip_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    e = engine(path, pattern)
    for b in batches:
        for s in range(0, b.num_rows, _ROWS_OUT):
            part = b.slice(s, _ROWS_OUT)
            ids = [x.astype("<u4") for x in e.encode(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array((x.tobytes() for x in ids), pa.binary()), pa.array(e.decode(ids), pa.binary())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian uint32) of each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(lambda b: _encode_batches(b, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``decoded``, the bytes that the ids stand for; null ids count as none."""
    ship(encoded.sparkSession)
    return encoded.mapInArrow(lambda b: _decode_batches(b, path, pattern), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` with one engine instead of two in each task."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(lambda b: _round_trip_batches(b, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op6_sql_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN
    out = round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return out.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
