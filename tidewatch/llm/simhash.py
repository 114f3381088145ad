"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints of 64 bits are laid out as the leaves of binary tries. A pair of
trie nodes is walked together, bit by bit; the differing bits of the two paths
add up, and a pair of nodes is dropped once they exceed the error budget.

To share the walk among tasks, the bits are cut into ``budget + 1`` blocks. Two
fingerprints within the budget agree on one block at least, so the join runs
over as many tries, each with another block as its first levels and no error
allowed there; a task gets whole subtries below those levels. A subtrie with
more than ``HOT_SUBTRIE`` leaves is dealt out again by the same rule: its other
bits are cut into blocks too. No fingerprint has more than 2,080 others within
two bits, so the links grow in proportion to the input however alike the
documents are, and each task reports only a spanning forest of its links.

Defined results: null text and text without words have fingerprint zero; they
link like any other. Equal texts share a fingerprint. Rows are never dropped:
repeated rows come back as often as they came in. A null id is passed through
and takes part in the links; a component's id is its smallest non-null id. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.runtime import cut, ship, spill, table

SEED = 42
SHINGLE_WORDS = 3
ERROR_BUDGET = 2
HOT_SUBTRIE = 4096
_FRONTIER = 1 << 17
_ROWS_HELD = 1 << 19
#: Parts that the rows of one fingerprint are dealt to before they meet.
_SALTS = 32
_DIRECT = 16
_BLOCK_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x09-\x0d ]")
_PLACES = (np.arange(8) * 256).astype(np.int64)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _blocks(data: bytes) -> Iterator[bytes]:
    """Cut at blanks, so that the words of a huge text never exist all at once."""
    at = 0
    while len(data) - at > _BLOCK_BYTES:
        m = _BLANK.search(data, at + _BLOCK_BYTES)
        if m is None:
            break
        yield data[at : m.start()]
        at = m.start()
    yield data[at:] if at else data


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    votes, total = np.zeros(2048, np.int64), 0
    carried: list[bytes] = []
    any_shingle = False
    for block in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + block.split()
        if len(words) >= SHINGLE_WORDS:
            any_shingle = True
            digests = b"".join([xxhash.xxh64_digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)])
            octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
            votes += np.bincount((octets + _PLACES).ravel(), minlength=2048)
            total += len(octets)
        carried = words[-(SHINGLE_WORDS - 1) :] if len(words) >= SHINGLE_WORDS else words
    if not any_shingle:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    bits = (votes.reshape(8, 256)[:, :, None] * _BYTE_BITS).sum(axis=1).ravel()
    return int.from_bytes(np.packbits(bits * 2 > total).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """``keys`` (new name → column) and ``fp``, the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text).cast("string").alias("__tw_text"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_fingerprint_batches, f"{kinds}, fp bigint")


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of nearly equal blocks of a word of ``width`` bits, from the top."""
    at = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _rotate(v: np.ndarray, by: int, width: int) -> np.ndarray:
    """Rotate the low ``width`` bits left; the bits above stay."""
    if by == 0 or width == 0:
        return v
    low = np.uint64((1 << width) - 1)
    rest = v & low
    return (v & ~low) | (((rest << np.uint64(by)) | (rest >> np.uint64(width - by))) & low)


def trie_links(keys: np.ndarray, fixed: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted unique ``keys`` that agree on the first ``fixed`` bits and differ in at most ``budget`` others.

    A node of the trie is a range of the sorted keys. Node pairs are walked level by level;
    a frontier that gets too long is cut and walked piece by piece.
    """
    n = len(keys)
    if n < 2:
        return
    top = keys >> np.uint64(64 - fixed) if fixed else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    hi = np.r_[lo[1:], n]
    more = hi - lo > 1
    lo, hi = lo[more], hi[more]
    stack = [(fixed, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > _FRONTIER:
            stack += [(depth, tuple(x[s : s + _FRONTIER] for x in pairs)) for s in range(0, len(pairs[0]), _FRONTIER)]
            continue
        a0, a1, b0, b1, off = pairs
        few = (a1 - a0) * (b1 - b0) <= _DIRECT
        if few.any():
            yield from _pairs_of(keys, a0[few], a1[few], b0[few], b1[few], budget)
            a0, a1, b0, b1, off = (x[~few] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        zeros = np.r_[0, np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1) == 0)]
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        kids = [(a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1)]
        other = a0 != b0  # within one node the crossing pair exists once
        kids.append((am[other], a1[other], b0[other], bm[other], off[other] + 1))
        kids = [tuple(x[k] for x in kid) for kid in kids if (k := (kid[1] > kid[0]) & (kid[3] > kid[2]) & (kid[4] <= budget)).any()]
        if kids:
            stack.append((depth + 1, tuple(np.concatenate(x) for x in zip(*kids, strict=True))))


def _pairs_of(keys, a0, a1, b0, b1, budget):
    """All close pairs of small node pairs."""
    n = (a1 - a0) * (b1 - b0)
    node = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = (b1 - b0)[node]
    i, j = a0[node] + k // wide, b0[node] + k % wide
    close = (i != j) & ((a0[node] != b0[node]) | (i < j)) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
    if close.any():
        yield i[close], j[close]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link_partition(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the subtries of a partition. Rows come sorted by trie, sub and subtrie; whole subtries are walked as soon as ``_ROWS_HELD`` rows wait."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def walk(upto: int | None) -> pa.RecordBatch | None:
        """Take the first ``upto`` rows that wait."""
        nonlocal held, rows
        cols = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held = [] if upto is None else [tuple(x[upto:] for x in cols)]
        rows = 0 if upto is None else len(cols[0]) - upto
        return _links_of(*(x[:upto] for x in cols), budget)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(c.to_numpy() for c in b.columns))
        rows += b.num_rows
        if rows >= _ROWS_HELD:
            # the last subtrie may go on
            cols = [np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4)]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
            if len(last) and (got := walk(int(last[-1]) + 1)) is not None:
                yield got
    if held and (got := walk(None)) is not None:
        yield got


def _links_of(fp: np.ndarray, trie: np.ndarray, sub: np.ndarray, block: np.ndarray, subblock: np.ndarray, budget: int) -> pa.RecordBatch | None:
    fp = fp.view(np.uint64)
    nodes = np.unique(fp)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for t, (at, bits) in enumerate(_cuts(64, budget + 1)):
        rest = 64 - bits
        for s, (sub_at, sub_bits) in [(-1, (0, 0)), *enumerate(_cuts(rest, budget + 1))]:
            own = np.unique(fp[(trie == t) & (sub == s)])
            keys = np.sort(_rotate(_rotate(own, at, 64), sub_at, rest))
            for i, j in trie_links(keys, bits + sub_bits, budget):
                back = [_rotate(_rotate(keys[x], (rest - sub_at) % rest, rest), (64 - at) % 64, 64) for x in (i, j)]
                ends.append((np.searchsorted(nodes, back[0]), np.searchsorted(nodes, back[1])))
    if not ends:
        return None
    root = _forest(len(nodes), *(np.concatenate(x) for x in zip(*ends, strict=True)))
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[leaf].view(np.int64)), pa.array(nodes[root[leaf]].view(np.int64))], names=["u", "v"])


def _bits(c: Column, at: int, bits: int, width: int) -> Column:
    """Bits ``at`` … ``at + bits`` (from the top) of the low ``width`` bits of ``c``."""
    return F.shiftrightunsigned(c, width - at - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _dealt(fps: DataFrame, budget: int, hot: int) -> DataFrame:
    """Each fingerprint once for each trie, with the key of its subtrie."""
    blocks = _cuts(64, budget + 1)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), _bits(F.col("fp"), a, n, 64).alias("block")) for t, (a, n) in enumerate(blocks)])).alias("x")).select("fp", "x.trie", "x.block")
    large = rows.groupBy("trie", "block").count().where(F.col("count") > hot).select("trie", "block", F.lit(True).alias("large"))
    rows = rows.join(large, ["trie", "block"], "left")
    again = []
    for t, (at, n) in enumerate(blocks):
        rest = 64 - n
        turned = F.shiftleft(F.col("fp"), at).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 64 - at)) if at else F.col("fp")
        again.append(F.when(F.col("trie") == t, F.array(*[F.struct(F.lit(s).alias("sub"), _bits(turned, a, k, rest).alias("subblock")) for s, (a, k) in enumerate(_cuts(rest, budget + 1))])))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("subblock")))
    return rows.select("fp", "trie", "block", F.explode(F.when(F.col("large"), F.coalesce(*again)).otherwise(whole)).alias("y")).select("fp", "trie", "y.sub", "block", "y.subblock")


def links(fps: DataFrame, budget: int = ERROR_BUDGET, hot: int = HOT_SUBTRIE) -> DataFrame:
    """Links (``u``, ``v``) that join the fingerprints of column ``fp``, each given once, into their components."""
    ship(fps.sparkSession)
    place = ["trie", "sub", "block", "subblock"]
    dealt = _dealt(fps.select("fp"), budget, hot).repartition(*place).sortWithinPartitions(*place)
    return dealt.select("fp", *place).mapInArrow(lambda b: _link_partition(b, budget), "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``u``, ``v``), by rounds of random contraction.

    In a round each node moves to its neighbour of least random rank, if that is less than its own; edges
    follow, and what is left is contracted again. Neighbours are pre-aggregated, never gathered.
    """
    left = cut(edges.where("u <> v").distinct())
    ends = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    place, turn = ends.withColumn("root", F.col("node")), 0
    while not left.isEmpty():
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v"))).alias("n"))
        move = cut(least.where(F.struct(rank("u"), F.col("u")) > F.struct(F.col("n.r"), F.col("n.v"))).select(F.col("u").alias("from"), F.col("n.v").alias("to")))
        for end in ("u", "v"):
            left = left.join(move, left[end] == move["from"], "left").withColumn(end, F.coalesce("to", end)).select("u", "v")
        left = cut(left.where("u <> v").distinct())
        place = cut(place.join(move, place["root"] == move["from"], "left").select("node", F.coalesce("to", "root").alias("root")))
        turn += 1
    return place


def _classes(fps: DataFrame, least: Column, budget: int, hot: int) -> DataFrame:
    """(``fp``, ``least``): for each distinct fingerprint the least value over its component."""
    # every map task has a row of a fingerprint that all of them meet: those are combined in parts first
    part = fps.select("fp", least.alias("own"), F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt"))
    own = cut(part.groupBy("fp", "salt").agg(F.min("own").alias("own")).groupBy("fp").agg(F.min("own").alias("own")))
    linked = components(links(own, budget, hot)).withColumnRenamed("node", "fp")
    of_root = own.join(linked, "fp").groupBy("root").agg(F.min("own").alias("least"))
    found = linked.join(of_root, "root").select("fp", "least")
    return own.join(found, "fp", "left").select("fp", F.coalesce("least", "own").alias("least"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = ERROR_BUDGET, hot: int = HOT_SUBTRIE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``."""
    fps = cut(fingerprints(docs, {"__tw_id": F.col(doc_id)}, text))
    found = fps.join(spill(_classes(fps, F.col("__tw_id"), budget, hot)), "fp")
    return found.select(F.col("__tw_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Null ids come after all others, equal ids are told apart by a hash of the text, and of rows equal in both
    one stays.
    """
    key = {"__tw_none": F.col(doc_id).isNull(), "__tw_id": F.col(doc_id), "__tw_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    fps = cut(fingerprints(docs, key, text))
    first = _classes(fps, F.struct(*key), ERROR_BUDGET, HOT_SUBTRIE).select("least.*").distinct()
    rows = docs.withColumns(key)
    same = [rows[k].eqNullSafe(first[k]) for k in key]
    kept = rows.join(first, same, "left_semi")
    order = Window.partitionBy(*key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn("__tw_n", F.row_number().over(order)).where("__tw_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
