"""Token ids in a content-addressed store.

A document's id stream is cut into chunks where a rolling hash over its last ids meets
a mask, so equal passages give equal chunks wherever they stand. A chunk is named by
its digest and stored once, in pack files; a document is a recipe, the list of its
chunks' digests. The layout under a folder:

- ``packs/pack-NNNNNN.bin``: a header (magic, bytes an id), then the compressed
  chunks in the order of their digests;
- ``index``: where each chunk lies (Parquet);
- ``recipes``: in ascending document order, each document's recipe, its first place
  in the whole id stream, its length and its leaf, the hash of its recipe (Parquet);
- ``manifest``: a Merkle root over the leaves of each part of the recipes (Parquet).

Texts are tokenised once. Each writing task sends a chunk at most once and its
recipes beside them, through the only shuffle on the way in; chunks are dealt by
digest and recipes by row, so copies, however many, meet only as recipes. Reading
joins the recipes' digests with the index, sorts these references by place in the
packs, reads every pack front to back, and checks each chunk against its digest, each
document against its leaf and length, and the leaves against the manifest.

Defined results: null text counts as empty, a document of the end id alone. Rows with
equal ids are documents of their own, in the order of the rows; a null id comes before
all others. An empty table gives an empty store. Other columns are ignored. A very long
text is encoded in the memory of one task and stored in chunks like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.fastencode import encoder
from tidewatch.llm.files import NewFile, batch, locate
from tidewatch.llm.runtime import scratch, ship, spill, table, with_running_start

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"TWPACK1\n"
DIGEST_BYTES = 16
CHUNK_BITS = 10
LEAST, MOST = 256, 8192
_WINDOW_STEPS = 4  # a window of 2**4 ids
_SEEN = 500_000
_ROW_BITS = 33
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each id (splitmix64's finish)."""
    x = ids.astype(np.uint64) + _PRIME
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray, bits: int = CHUNK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of an id stream; they depend on the ids near each cut alone."""
    n = len(ids)
    if n <= least:
        return [n] * (n > 0)
    h, power, width = _mixed(ids), int(_PRIME), 1
    for _ in range(_WINDOW_STEPS):
        h[width:] += np.uint64(power) * h[:-width].copy()
        power, width = power * power % 2**64, width * 2
    marks = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(marks, at + least))
        end = int(marks[k]) if k < len(marks) else n
        at = min(end, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def _leaf(recipe: bytes, n: int) -> bytes:
    return hashlib.sha256(b"\0" + n.to_bytes(8, "little") + recipe).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0]


# --- writing ------------------------------------------------------------------

_SENT = (("deal", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("data", pa.binary()))
_SENT_SQL = "deal bigint, digest binary, doc_id bigint, row bigint, n bigint, data binary"
_PACKED = (("digest", pa.binary()), ("pack", pa.int32()), ("at", pa.int64()), ("size", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("recipe", pa.binary()))
_PACKED_SQL = "digest binary, pack int, at bigint, size int, doc_id bigint, row bigint, n bigint, recipe binary"
_INDEX_SQL = "digest binary, pack int, at bigint, size int, n bigint"
_RECIPES_SQL = "part int, doc_id bigint, row bigint, start bigint, n bigint, recipe binary, leaf binary"
_MANIFEST_SQL = "part int, docs bigint, tokens bigint, root binary"


def _cells(kinds: tuple, rows: list[tuple]) -> pa.RecordBatch:
    return batch({k: (list(v), t) for (k, t), v in zip(kinds, zip(*rows, strict=True) if rows else [()] * len(kinds), strict=True)})


def _chunk_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    enc, z = encoder(path), zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
    kind, end = np.dtype(f"<u{width}"), np.array([end_id], np.uint32)
    row, seen = TaskContext.get().partitionId() << _ROW_BITS, set()
    rows: list[tuple] = []
    held = 0
    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
            ids = np.concatenate([ids, end])
            if ids.max() >> (8 * width):
                raise OverflowError(f"id {ids.max()} doesn't fit into {width} bytes")
            data, recipe, at = ids.astype(kind).tobytes(), [], 0
            for stop in cuts(ids):
                part = data[at * width : stop * width]
                d = _digest(part)
                recipe.append(d)
                if d not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(d)
                    packed = z.compress(part)
                    held += len(packed)
                    rows.append((int.from_bytes(d[:8], "little", signed=True), d, None, None, stop - at, packed))
                at = stop
            rows.append((row, None, key, row, len(ids), b"".join(recipe)))
            row += 1
            held += 32 * len(recipe)
            if held > 4 << 20:
                yield _cells(_SENT, rows)
                rows, held = [], 0
    if rows:
        yield _cells(_SENT, rows)


def _pack_batches(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """Write the chunks, which come in the order of their digests, and let recipes pass."""
    pack, f, last, rows = TaskContext.get().partitionId(), None, None, []
    try:
        for b in batches:
            for _, d, key, row, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if d is None:
                    rows.append((None, None, None, None, key, row, n, data))
                elif d != last:
                    if f is None:
                        f = NewFile(f"{folder}/packs", f"pack-{pack:06d}.bin")
                        f.write(MAGIC + width.to_bytes(1, "little"))
                    rows.append((d, pack, f.write(data), len(data), None, None, n, None))
                    last = d
            if rows:
                yield _cells(_PACKED, rows)
                rows = []
        if f is not None:
            f.commit()
    except BaseException:
        if f is not None:
            f.abort()
        raise


def _manifest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A Merkle root for each part; parts arrive whole and in order."""
    part, leaves, tokens = None, [], 0
    kinds = (("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary()))
    for b in batches:
        for p, n, leaf in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if leaves and p != part:
                yield _cells(kinds, [(part, len(leaves), tokens, merkle_root(leaves))])
                leaves, tokens = [], 0
            part = p
            leaves.append(leaf)
            tokens += n
    if leaves:
        yield _cells(kinds, [(part, len(leaves), tokens, merkle_root(leaves))])


def _manifest(recipes: DataFrame) -> DataFrame:
    dealt = recipes.repartition("part").sortWithinPartitions("part", "start")
    return dealt.select("part", "n", "leaf").mapInArrow(_manifest_batches, _MANIFEST_SQL)


def _leaf_of(recipe: str, n: str):
    """``_leaf`` as an expression: the length as eight little-endian bytes, then the recipe."""
    return F.unhex(F.sha2(F.concat(F.lit(b"\0"), F.unhex(F.expr(f"concat({', '.join(f'lpad(hex(({n} >> {8 * k}) & 255), 2, {chr(39)}0{chr(39)})' for k in range(8))})")), F.col(recipe)), 256))


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenise all documents into a store under ``folder``. ``width``: bytes an id (1, 2 or 4), 2 for vocabularies up to 65,536; an id that doesn't fit is refused."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t"))
    sent = rows.mapInArrow(lambda b: _chunk_batches(b, path, end_id, width), _SENT_SQL)
    dealt = sent.repartition("deal").sortWithinPartitions("digest")
    packed = spill(dealt.mapInArrow(lambda b: _pack_batches(b, folder, width), _PACKED_SQL))
    packed.where("digest IS NOT NULL").select("digest", "pack", "at", "size", "n").write.parquet(f"{folder}/index")
    recipes = packed.where("digest IS NULL").select("doc_id", "row", "n", "recipe")
    placed = with_running_start(recipes, ["doc_id", "row"], "n", "start", keep="part")
    placed = placed.select("part", "doc_id", "row", "start", "n", "recipe", _leaf_of("recipe", "n").alias("leaf"))
    placed.sortWithinPartitions("part", "doc_id", "row").write.parquet(f"{folder}/recipes")
    _manifest(spark.read.schema(_RECIPES_SQL).parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


# --- reading ------------------------------------------------------------------

_REFS = (("row", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("total", pa.int64()), ("leaf", pa.binary()))
_REFS_SQL = "row bigint, seq int, digest binary, data binary, doc_id bigint, start bigint, total bigint, leaf binary"
_DOCS = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()))


def _fetch_batches(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """The chunk of each reference; references come sorted by place, so packs are read forward and a chunk once."""
    z, now, f, place, data = zstandard.ZstdDecompressor(), None, None, None, b""
    rows, held = [], 0
    for b in batches:
        for pack, at, size, n, row, seq, digest, doc, start, total, leaf in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if pack != now:
                if f is not None:
                    f.close()
                store, path = locate(f"{folder}/packs/pack-{pack:06d}.bin")
                f, now, place = store.open_input_file(path), pack, None
                if f.read(len(MAGIC) + 1) != MAGIC + width.to_bytes(1, "little"):
                    raise ValueError(f"{path} is not a pack of {width}-byte ids")
            if place != at:
                f.seek(at)
                raw = f.read(size)
                part = z.decompress(raw)
                if _digest(part) != digest or len(part) != n * width:
                    raise ValueError(f"damaged chunk {digest.hex()}")
                place, data = at, raw
            rows.append((row, seq, digest, data, doc, start, total, leaf))
            held += len(data)
            if held > 4 << 20:
                yield _cells(_REFS, rows)
                rows, held = [], 0
    if f is not None:
        f.close()
    if rows:
        yield _cells(_REFS, rows)


def _join_batches(batches: Iterator[pa.RecordBatch], width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents from their chunks, which come in order of row and seq; a document is never held whole unless its ids are asked for."""
    z, kind = zstandard.ZstdDecompressor(), np.dtype(f"<u{width}")
    kinds = _DOCS if with_ids else _DOCS[:4]
    rows: list[tuple] = []
    now, n, crc, recipe, parts, head = None, 0, 0, [], [], None

    def close() -> None:
        if head[2] != n or _leaf(b"".join(recipe), n) != head[3]:
            raise ValueError(f"document {head[0]} can't be put together from its recipe")
        rows.append((head[0], head[1], n, crc, b"".join(parts))[: len(kinds)])

    for b in batches:
        for row, _, digest, data, doc, start, total, leaf in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row != now:
                if now is not None:
                    close()
                now, n, crc, recipe, parts, head = row, 0, 0, [], [], (doc, start, total, leaf)
            ids = np.frombuffer(z.decompress(data), kind).astype("<u4").tobytes()
            n, crc = n + len(ids) // 4, zlib.crc32(ids, crc)
            recipe.append(digest)
            if with_ids:
                parts.append(ids)
        if len(rows) >= 4096:
            yield _cells(kinds, rows)
            rows.clear()
    if now is not None:
        close()
        yield _cells(kinds, rows)


def read(spark: SparkSession, folder: str, width: int = 2, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, put together from the files; ``with_ids`` adds its ids."""
    ship(spark)
    recipes = spark.read.schema(_RECIPES_SQL).parquet(f"{folder}/recipes")
    stated = spark.read.schema(_MANIFEST_SQL).parquet(f"{folder}/manifest")
    again = _manifest(recipes.withColumn("leaf", _leaf_of("recipe", "n")))
    if not stated.exceptAll(again).isEmpty() or not again.exceptAll(stated).isEmpty():
        raise ValueError(f"the recipes under {folder} don't match their manifest")
    index = spark.read.schema(_INDEX_SQL).parquet(f"{folder}/index")
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"cast(length(recipe) / {DIGEST_BYTES} as int) - 1")), lambda k: F.substring("recipe", k * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES))))
    refs = recipes.select("row", "doc_id", "start", F.col("n").alias("total"), "leaf", each.alias("seq", "digest"))
    first = lambda c: F.when(F.col("seq") == 0, F.col(c)).alias(c)
    refs = refs.select("row", "seq", "digest", *[first(c) for c in ("doc_id", "start", "total", "leaf")])
    placed = refs.join(index, "digest").repartitionByRange("pack", "at", "row").sortWithinPartitions("pack", "at")
    fetched = placed.select("pack", "at", "size", "n", "row", "seq", "digest", "doc_id", "start", "total", "leaf").mapInArrow(lambda b: _fetch_batches(b, folder, width), _REFS_SQL)
    whole = fetched.repartition("row").sortWithinPartitions("row", "seq")
    return whole.mapInArrow(lambda b: _join_batches(b, width, with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read(spark, folder)
