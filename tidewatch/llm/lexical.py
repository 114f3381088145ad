"""Ranked lexical search: a sharded index, document at a time.

Index. Each task deals the documents that it reads to shards of ``SHARD_BYTES``
of text. A shard numbers its documents in ascending order of their ids and has, for
each term, its postings: the gaps between document numbers and the frequencies,
as variable-length bytes. One more row holds the shard's ids and lengths. The
index is a DataFrame like any other and can be written and searched again.

Search. Terms are weighted by their document frequencies over all shards. A shard meets a
block of query items once: the postings of a term are expanded and valued once for all
items of the block. Then every item is answered document at a time: a heap holds the
cursors of its terms' posting lists by the document at which each goes on; the least is
taken, ``_RUN`` postings at a time, and what lies before the least document of the heap
is complete, so its scores are added up and compared with a heap of the best k, keyed by
score and then id. The best of all shards meet by item.

Lists are taken in runs, not one by one, only to let numpy add up a run; a document is
still scored at once and never visited again. All documents of all shards are scored:
there is no pruning by bounds, and no cap.

Defined results: null text and text without a term have none, count neither as
documents nor in the lengths, and are never found. An item without a known term, or null, has
no rows. Repeated rows are documents of their own, as repeated items are items of their
own. Equal scores go by ascending id, null ids last. Frequencies, lengths and scores are
64-bit integers; ids may be of any type that sorts. Other columns are ignored.

A task holds a shard, or a shard's postings of the terms of a block of items. A document
longer than a shard is one by itself; its text is taken apart in slices.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.runtime import cut, ship, spill, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
SHARD_BYTES = 16 << 20
ITEMS_A_BLOCK = 256
#: Weights are thousandths, contributions parts of 10**9 for each thousandth; the length norm is 50 to 100 and more.
WEIGHT, GAIN, DAMP, LEVEL, SLOPE = 1000, 1_000_000_000, 20, 100, 50
_RUN = 1024
_PENDING = 1 << 15
_SLICE = 1 << 20
#: Bytes of a term stay, with A-Z in lower case; all others are a blank. Characters beyond ASCII have only bytes of terms.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> Counter[bytes]:
    """How often each term occurs in a UTF-8 text. Long texts are taken in slices that end between terms."""
    folded = text.translate(_FOLD)
    if len(folded) <= _SLICE:
        return Counter(folded.split())
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", min(len(folded), at + _SLICE))
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def encode(values: np.ndarray) -> bytes:
    """Non-negative integers as seven bits a byte, least first; the high bit says that more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= (np.uint64(1) << np.uint64(7 * k))
    out = np.zeros(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[has] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = (np.arange(len(b)) - np.repeat(starts, ends - starts + 1)) * 7
    return np.add.reduceat((b & 127).astype(np.int64) << shift, starts)


def _shard(ids: pa.Array, counts: list[Counter[bytes]]) -> Iterator[tuple[bytes | None, int, bytes]]:
    """The shard's rows: its documents' lengths under no term, then each term's postings. ``counts`` is in the order of ``ids``."""
    yield None, len(counts), encode(np.array([c.total() for c in counts], np.int64))
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(t, len(known)) for c in counts for t in c), np.int64)
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(number))
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    order = np.argsort(number, kind="stable")
    number, tf, doc = number[order], tf[order], doc[order]
    first = np.r_[True, number[1:] != number[:-1]]
    gaps = np.where(first, doc, doc - np.r_[0, doc[:-1]])
    # one encoding for all lists, then cut: gap and frequency by turns
    pairs = np.stack([gaps, tf], axis=1).ravel()
    data = encode(pairs)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) < 128) + 1
    starts = np.flatnonzero(first)
    stops = np.r_[starts[1:], len(number)]
    for term, a, b in zip(known, starts.tolist(), stops.tolist(), strict=True):
        yield term, b - a, data[int(ends[2 * a - 1]) if a else 0 : int(ends[2 * b - 1])]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``shard``, ``term``, ``df``, ``postings``, ``ids``, ``terms``: a row for each term of a shard; the row without a term has the shard's ids and lengths."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        counts: list[Counter[bytes]] = []
        size = 0

        def flush(ids: pa.Array, counts: list[Counter[bytes]], shard: int) -> Iterator[pa.RecordBatch]:
            order = pc.sort_indices(ids, null_placement="at_end")
            counts = [counts[i] for i in order.to_pylist()]
            ids = ids.take(order)
            found: list[tuple[bytes | None, int, bytes]] = []

            def batch() -> pa.RecordBatch:
                n = len(found)
                heads = [i for i, r in enumerate(found) if r[0] is None]
                lists = pa.ListArray.from_arrays(pa.array(np.where(np.arange(n + 1) > heads[0], len(ids), 0).astype(np.int32) if heads else np.zeros(n + 1, np.int32)), ids if heads else ids[:0])
                total = sum(c.total() for c in counts)
                return pa.record_batch([pa.array(np.full(n, shard)), pa.array([r[0] for r in found], pa.binary()).cast(pa.string()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.binary()), lists, pa.array([total if r[0] is None else None for r in found], pa.int64())], ["shard", "term", "df", "postings", "ids", "terms"])

            for row in _shard(ids, counts):
                found.append(row)
                if len(found) == 20_000:
                    yield batch()
                    found.clear()
            if found:
                yield batch()

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                c = terms_of(t) if t else None
                if not c:
                    continue
                if counts and size + len(t) > shard_bytes:
                    yield from flush(pa.array(ids, b.column(0).type), counts, (task << 32) + made)
                    ids, counts, size, made = [], [], 0, made + 1
                ids.append(i)
                counts.append(c)
                size += len(t)
        if counts:
            yield from flush(pa.array(ids, b.column(0).type), counts, (task << 32) + made)

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(rows, f"shard bigint, term string, df bigint, postings binary, ids array<{kind.simpleString()}>, terms bigint")


def merge(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """The k best of (score, document), the best first, of posting lists (documents ascending, values), document at a time."""
    cursors = [(int(docs[0]), n, 0) for n, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(cursors)
    best: list[tuple[int, int]] = []  # (score, -document), the worst first
    docs, values, waiting = [], [], 0
    while cursors:
        _, n, at = cursors[0]
        d, v = lists[n]
        end = at + _RUN
        docs.append(d[at:end])
        values.append(v[at:end])
        waiting += len(docs[-1])
        if end < len(d):
            heapq.heapreplace(cursors, (int(d[end]), n, end))
        else:
            heapq.heappop(cursors)
        if cursors and waiting < _PENDING:
            continue
        got, worth = np.concatenate(docs), np.concatenate(values)
        rest = got >= cursors[0][0] if cursors else np.zeros(len(got), bool)
        if rest.all():
            docs, values = [got], [worth]
            continue
        docs, values, waiting = [got[rest]], [worth[rest]], int(rest.sum())
        got, worth = got[~rest], worth[~rest]
        low = int(got.min())
        # documents are dense in a run, so a score for each number between is no more than the postings of a frequent term
        if int(got.max()) - low < 8 * len(got):
            scores = np.zeros(int(got.max()) - low + 1, np.int64)
            np.add.at(scores, got - low, worth)
            whole = np.flatnonzero(scores) + low
            scores = scores[whole - low]
        else:
            order = np.argsort(got, kind="stable")
            got, worth = got[order], worth[order]
            starts = np.flatnonzero(np.r_[True, got[1:] != got[:-1]])
            whole, scores = got[starts], np.add.reduceat(worth, starts)
        # a later document beats none of its own score, so only higher ones are looked at once the heap is full
        better = np.flatnonzero(scores > (best[0][0] if len(best) == k else 0))
        if len(better) > k:
            least = np.partition(scores[better], len(better) - k)[len(better) - k]
            better = better[scores[better] >= least]
        for doc, score in zip(whole[better].tolist(), scores[better].tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            elif (score, -doc) > best[0]:
                heapq.heapreplace(best, (score, -doc))
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def norms_of(lens: np.ndarray, documents: int, length: int) -> np.ndarray:
    if SLOPE * int(lens.max()) * documents < 2**63:
        return LEVEL - SLOPE + (SLOPE * lens * documents) // length
    return np.array([LEVEL - SLOPE + (SLOPE * n * documents) // length for n in lens.tolist()], np.int64)


def values_of(tf: np.ndarray, norms: np.ndarray, weight: int) -> np.ndarray:
    return weight * ((GAIN * tf) // (WEIGHT * tf + DAMP * norms))


def _answer(shard: pa.Table, documents: int, length: int, k: int) -> pa.Table:
    """A shard's best for each item of a block. ``shard``: its row of ids, and its rows of the terms that the items have."""
    ids, lens, lists = None, None, {}
    for part in shard.to_batches():
        for term, postings in zip(part["term"], part["postings"], strict=True):
            if not term.is_valid:
                lens = decode(postings.as_py())
        at = np.flatnonzero(part["term"].is_null().to_numpy(zero_copy_only=False))
        if len(at):
            ids = part["ids"][int(at[0])].values
    norms = norms_of(lens, documents, length)
    for part in shard.to_batches():
        for term, postings, weight, items in zip(part["term"], part["postings"], part["weight"], part["items"], strict=True):
            if term.is_valid:
                pairs = decode(postings.as_py()).reshape(-1, 2)
                docs = np.cumsum(pairs[:, 0])
                found = (docs, values_of(pairs[:, 1], norms[docs], weight.as_py()))
                for item in items.as_py():
                    lists.setdefault(item, []).append(found)
    item, doc, score = [], [], []
    for n, found in lists.items():
        for s, d in merge(found, k):
            item.append(n)
            doc.append(d)
            score.append(s)
    return pa.table({"item": pa.array(item, pa.int64()), "doc_id": ids.take(pa.array(doc, pa.int64())), "score": pa.array(score, pa.int64())})


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of ``index`` for each row of ``items``."""
    spark = index.sparkSession
    ship(spark)
    index = spill(index)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    heads = index.where("term IS NULL")
    documents, length = heads.agg(F.sum("df"), F.sum("terms")).first()
    rows = cut(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("item")))
    if not documents:
        return rows.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    blocks = max(1, math.ceil(rows.count() / items_a_block))
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    asked = rows.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(TERM), F.lit(0)))).alias("term"))
    # bounded by the items of a block
    wanted = asked.groupBy("block", "term").agg(F.collect_list("item").alias("items"))
    lists = spill(index.where("term IS NOT NULL").join(wanted.select("term").distinct(), "term").select("shard", "term", "df", "postings"))
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1))).cast("bigint")
    wanted = wanted.join(df, "term").select("block", "term", "items", weight.alias("weight"))
    there = lists.select("shard", "term", "postings").join(wanted, "term").select("shard", "block", "term", "postings", F.lit(None).cast(f"array<{kind}>").alias("ids"), "weight", "items")
    every = heads.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "postings", "ids", F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("array<bigint>").alias("items"))
    best = there.unionByName(every).groupBy("shard", "block").applyInArrow(lambda t: _answer(t, documents, length, k), f"item bigint, doc_id {kind}, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_UPPER = "".join(map(chr, range(65, 91)))

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}') AS t FROM documents
), s AS (
  SELECT count(*) AS docs, sum(len(t))::BIGINT AS length FROM d WHERE len(t) > 0
), p AS (
  SELECT r, doc_id, len(t)::BIGINT AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL
), i AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')) AS t FROM benchmark
), q AS (
  SELECT item, item_id, unnest(t) AS term FROM i
), w AS (
  SELECT term, floor({WEIGHT} * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), f AS (
  SELECT item, item_id, r, doc_id, sum(w * (({GAIN} * tf) // ({WEIGHT} * tf + {DAMP} * ({LEVEL - SLOPE} + ({SLOPE} * n * docs) // length))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
