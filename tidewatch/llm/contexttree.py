"""A language model of bytes: context-tree weighting.

A byte is eight binary decisions, most significant bit first; a decision is known by the
bits of the byte before it. For every decision there is a tree of contexts: the root
knows no byte of the past, a node of depth j the last j bytes, a leaf the last ``DEPTH``.
A node has the counts (a, b) of zeros and ones that followed, its Krichevsky-Trofimov
probability Pe, and the weighted probability Pw = Pe at a leaf, else half Pe plus half
the product of its children's Pw. With the counts of the whole training corpus,
Pe / 2Pw of a node is the weight of the models in which the context ends there. A text's
probability mixes the estimates (b + 1/2) / (a + b + 1) of the nodes along its context
by these weights, from the leaf to the root; a node without counts passes its parent's
estimate on. A text starts in the context of ``DEPTH`` bytes 0xFF, which UTF-8 doesn't
have, and ends with one, so that the probabilities of all texts add up to one at most.

How it is spread: texts are cut into pieces and dealt to chunks of ``CHUNK_BYTES``. A
chunk asks for each of its distinct words and n-grams of DEPTH + 1 bytes once, with its
training count. The counts of an n-gram meet by the n-gram. Nodes are added up from the
leaves in groups that have the last three bytes in common, which bounds a group
whatever the corpus; above them, a group for each decision has at most 65,536 contexts. The
probabilities go back to the chunks that asked, and a chunk scores its pieces with
them. No task sees more of the model than its chunk or bucket asks for, and what is
counted is the whole training corpus.

Defined results: null text counts as empty: one end, no word. Texts are scored as their
UTF-8 bytes with A-Z in lower case. Rows are neither dropped nor merged; a null id never
trains and counts as not held out. Without any training text each bit has
probability 1/2. Texts of any length are cut at white space, or taken whole where there
is none. Other columns are ignored; ids may be of any type.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tidewatch.llm.runtime import ship, spill, table

#: Bytes of context, six at most.
DEPTH = 5
CHUNK_BYTES = 32 << 20
FOLDS, HELD_OUT = 7, 2
END = 0xFF
_PIECE = 1 << 20
_BLOB = 1 << 20
_GRAMS_A_BUCKET = 1 << 19
#: Nodes of this many bytes and more are added up by bucket; those above, by decision.
_GROUP = 3
_LN2, _LNPI = math.log(2.0), math.log(math.pi)


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of x > 0: Stirling's series, moved up by ten for small x."""
    small = x < 10
    y = np.where(small, x + 10, x)
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / y
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    if small.any():
        z = x[small]
        out[small] -= np.log(np.prod([z + k for k in range(10)], axis=0))
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones, in any order."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - _LNPI - lgamma(a + b + 1.0)


def grams_of(data: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of pieces that lie one after another, each after its ``depth`` bytes of context (six at most), and which of them lie in one piece.

    An n-gram has the last byte before first, then those further back, then the byte itself. The n-gram at k ends at byte k + depth.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # eight bytes at every place, the first lowest, so that the context's bytes already lie as they should
    eight = np.ndarray((max(0, len(data) - depth),), "<u8", padded, 0, (1,))
    low = np.uint64(8 * depth)
    keys = ((eight & ((np.uint64(1) << low) - np.uint64(1))) << np.uint64(8) | (eight >> low & np.uint64(255))).view(np.int64)
    inside = np.ones(len(keys), bool)
    for back in range(1, depth + 1):
        inside[starts[1:] - back] = False
    return keys, inside


def _decision(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the t-th decision of bytes ``x``, 1 to 255, and what is decided."""
    return (1 << t) | (x >> (8 - t)), x >> (7 - t) & 1


def _gather(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values))


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def weigh(node: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln Pw of nodes, and the weight with which a context ends there; ``children``: the sums of their children's ln Pw."""
    pe = log_kt(a.astype(float), b.astype(float))
    if children is None:
        return pe, np.ones(len(node))
    pw = np.logaddexp(pe, children) - _LN2
    return pw, np.exp(pe - _LN2 - pw)


def build(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[list[list[Level]], list[tuple[np.ndarray, ...]]]:
    """Nodes of the depths ``depth`` to ``top`` for each decision: (node, a, b, weight), and what the depth above ``top`` adds up: (node, a, b, ln Pw).

    A node's number is its context, then the decision. ``grams`` must hold whole contexts of ``top`` bytes.
    """
    levels, above = [], []
    for t in range(8):
        q, bit = _decision(grams & 255, t)
        node, a, b = _gather(grams >> 8 << 8 | q, np.where(bit == 0, counts, 0), np.where(bit == 1, counts, 0))
        pw, weight = weigh(node, a, b, None)
        own = [(node, a, b, weight)]
        for _ in range(depth - top):
            node, a, b, children = _gather(node >> 16 << 8 | node & 255, a, b, pw)
            pw, weight = weigh(node, a, b, children)
            own.append((node, a, b, weight))
        levels.append(own[::-1])
        above.append(_gather(node >> 16 << 8 | node & 255, a, b, pw))
    return levels, above


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def predict(asked: np.ndarray, levels: list[list[Level]], depth: int, top: int, above) -> np.ndarray:
    """log10 of the probability of each asked n-gram's byte in its context.

    ``above(context, q, bit)`` gives for the context of ``top - 1`` bytes and a decision what is fixed there: the
    probability if nothing deeper is known, and the share and the factor of what is deeper, if it is.
    """
    total = np.zeros(len(asked))
    for t in range(8):
        q, bit = _decision(asked & 255, t)
        alone, share, factor = above(asked >> (8 * (depth - top + 2)), q, bit)
        # from the top down: the probability is share + factor * (that of the next depth)
        done = np.zeros(len(asked), bool)
        p = alone.copy()
        share, factor = share.copy(), factor.copy()
        for j, (node, a, b, weight) in enumerate(levels[t]):
            if not len(node):
                break
            at, met = _find(node, asked >> (8 * (depth - top - j + 1)) << 8 | q)
            met &= ~done
            own = (np.where(bit == 1, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1.0)
            p = np.where(met, share + factor * own, p)
            share = np.where(met, share + factor * weight[at] * own, share)
            factor = np.where(met, factor * (1 - weight[at]), factor)
            done |= ~met
        total += np.log10(p)
    return total


def upper_nodes(context: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray, top: int) -> list[tuple[np.ndarray, ...]]:
    """One decision's nodes of the depths 0 to ``top - 1``, from those of ``top - 1``.

    For each depth: context, then for zero and one the probability if nothing deeper is known (two), the share fixed
    (two), and the factor of what is deeper.
    """
    levels = []
    for j in range(top - 1, -1, -1):
        pw, weight = weigh(context, a, b, children)
        levels.append((context, a, b, weight))
        if j:
            context, a, b, children = _gather(context >> 8, a, b, pw)
    out = []
    share, factor, above = np.zeros((2, 1)), np.ones(1), np.zeros(1, np.int64)
    for context, a, b, weight in reversed(levels):
        up = np.searchsorted(above, context >> 8) if out else np.zeros(len(context), np.int64)
        own = np.stack([a + 0.5, b + 0.5]) / (a + b + 1.0)
        alone = share[:, up] + factor[up] * own
        share, factor, above = share[:, up] + factor[up] * weight * own, factor[up] * (1 - weight), context
        out.append((context, *alone, *share, factor))
    return out


class Above:
    """Looks up what is fixed above the groups: the nearest known context of at most two bytes."""

    def __init__(self, low: list[tuple[np.ndarray, ...]], nearest: tuple[np.ndarray, ...]):
        """``low``: for each depth below the nearest, and ``nearest``: node (context, then decision) ascending, and five values."""
        self.levels = [*low, nearest]

    def __call__(self, context: np.ndarray, q: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alone, share, factor = np.full(len(q), 0.5), np.zeros(len(q)), np.ones(len(q))
        known = np.ones(len(q), bool)
        last = len(self.levels) - 1
        for j, (node, *values) in enumerate(self.levels):
            if not len(node):
                known[:] = False
                break
            at, met = _find(node, context >> (8 * (last - j)) << 8 | q)
            known &= met
            alone = np.where(known, np.where(bit == 1, values[1][at], values[0][at]), alone)
            share = np.where(known, np.where(bit == 1, values[3][at], values[2][at]), share)
            factor = np.where(known, values[4][at], factor)
        # where the nearest is unknown, nothing deeper is known either, and only ``alone`` is used
        return alone, share, factor


def _pieces(text: bytes, depth: int) -> Iterator[tuple[bytes, bool]]:
    """A text in pieces with the bytes before each, cut after white space; the last has the end."""
    past, at = bytes([END]) * depth, 0
    while len(text) - at > _PIECE:
        cut = max(text.rfind(c, at, at + _PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if cut <= at:
            ends = [e for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := text.find(c, at)) >= 0]
            if not ends:
                break
            cut = min(ends) + 1
        yield past + text[at:cut], False
        past, at = (past + text[at:cut])[-depth:] if depth else b"", cut
    yield past + text[at:] + bytes([END]), True


class _Chunk:
    """What a chunk's texts ask for, as they come."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.words: Counter[bytes] = Counter()
        self.ends = 0
        self.others: set[bytes] = set()
        self.met: list[tuple[np.ndarray, np.ndarray]] = []

    def words_of(self, piece: bytes, end: bool, trains: bool) -> None:
        found = piece[self.depth : len(piece) - end].split()
        if trains:
            self.words.update(found)
            self.ends += end
        else:
            self.others.update(found)

    def grams(self, data: np.ndarray, starts: np.ndarray, trains: np.ndarray) -> None:
        keys, inside = grams_of(data, starts, self.depth)
        learn = np.repeat(trains, np.diff(np.r_[starts, len(data)]))[self.depth :]
        for part, weight in ((keys[inside & learn], 1), (keys[inside & ~learn], 0)):
            if len(part):
                distinct, n = np.unique(part, return_counts=True)
                self.met.append((distinct, n * weight))
        if len(self.met) >= 16:
            self.met = [_gather(*(np.concatenate(x) for x in zip(*self.met, strict=True)))]


_PARTS = "kind int, chunk bigint, rows array<bigint>, ids array<{id}>, held array<boolean>, sizes array<int>, ends array<boolean>, data binary, gram bigint, word binary, n bigint"


def _parts(docs: DataFrame, depth: int, chunk_bytes: int, kind: pa.DataType, name: str) -> DataFrame:
    """Texts, packed (kind 0), and what their chunks ask for: n-grams (1) and words (2; null: the end), each once a chunk, with its training count."""
    codec = "zstd"
    fields = [("kind", pa.int32()), ("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(kind)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("ends", pa.list_(pa.bool_())), ("data", pa.binary()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())]

    def batch(kind_of: int, chunk: int, count: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array(np.full(count, kind_of, np.int32)), "chunk": pa.array(np.full(count, chunk))}
        return pa.record_batch([columns[n] if n in columns else pa.nulls(count, t) for n, t in fields], [n for n, _ in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        row, chunk, number = task, _Chunk(depth), task
        waiting: list[tuple[int, object, bool, bool, bytes, bool]] = []

        def pack() -> pa.RecordBatch:
            sizes = np.array([len(w[4]) for w in waiting], np.int32)
            joined = b"".join(w[4] for w in waiting)
            chunk.grams(np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes, np.array([w[3] for w in waiting]))
            one = lambda values, t: pa.array([values], pa.list_(t))
            out = batch(0, number, 1, rows=one([w[0] for w in waiting], pa.int64()), ids=one([w[1] for w in waiting], kind), held=one([w[2] for w in waiting], pa.bool_()), sizes=one(sizes, pa.int32()), ends=one([w[5] for w in waiting], pa.bool_()), data=pa.array([pa.compress(joined, codec, asbytes=True)], pa.binary()))
            chunk.size += len(joined)
            waiting.clear()
            return out

        def asks() -> Iterator[pa.RecordBatch]:
            keys, n = _gather(*(np.concatenate(x) for x in zip(*chunk.met, strict=True)))
            for a in range(0, len(keys), 1 << 16):
                yield batch(1, number, len(keys[a : a + (1 << 16)]), gram=pa.array(keys[a : a + (1 << 16)]), n=pa.array(n[a : a + (1 << 16)]))
            words = [*chunk.words, *(chunk.others - chunk.words.keys())]
            for a in range(0, len(words), 1 << 15):
                some = words[a : a + (1 << 15)]
                yield batch(2, number, len(some), word=pa.array(some, pa.binary()), n=pa.array([chunk.words[w] for w in some], pa.int64()))
            yield batch(2, number, 1, n=pa.array([chunk.ends], pa.int64()))

        pending = 0
        for b in batches:
            for i, t, held, trains in zip(*(b.column(k).cast(pa.binary()).to_pylist() if k == 1 else b.column(k).to_pylist() for k in range(4)), strict=True):
                for piece, end in _pieces((t or b"").lower(), depth):
                    chunk.words_of(piece, end, trains)
                    waiting.append((row, i, held, trains, piece, end))
                    pending += len(piece)
                    if pending >= _BLOB:
                        yield pack()
                        pending = 0
                    if chunk.size >= chunk_bytes:
                        yield from asks()
                        chunk, number = _Chunk(depth), number + 1
                row += 1
        if waiting:
            yield pack()
        if chunk.met:
            yield from asks()

    return docs.mapInArrow(read, _PARTS.format(id=name))


def _top(depth: int) -> int:
    return min(_GROUP, depth)


def train(grams: DataFrame, depth: int) -> DataFrame:
    """Of n-grams with their counts (``gram``, ``n``, ``bucket``): the nodes above the buckets (``level``, ``context``, ``q``, ``v0`` to ``v4``)."""
    top = _top(depth)

    def sums(t: pa.Table) -> pa.Table:
        _, above = build(t["gram"].to_numpy(), t["n"].to_numpy(), depth, top)
        node, a, b, pw = (np.concatenate(x) for x in zip(*above, strict=True))
        return pa.table({"context": node >> 8, "q": (node & 255).astype(np.int32), "a": a, "b": b, "pw": pw})

    def upper(t: pa.Table) -> pa.Table:
        t = t.sort_by("context")
        levels = upper_nodes(t["context"].to_numpy(), t["a"].to_numpy(), t["b"].to_numpy(), t["pw"].to_numpy(), top)
        q = t["q"][0].as_py()
        out = {"level": np.concatenate([np.full(len(x[0]), j, np.int32) for j, x in enumerate(levels)]), "context": np.concatenate([x[0] for x in levels])}
        out["q"] = np.full(len(out["context"]), q, np.int32)
        return pa.table(out | {f"v{k}": np.concatenate([x[k + 1] for x in levels]) for k in range(5)})

    nodes = grams.where("n > 0").groupBy("bucket").applyInArrow(sums, "context bigint, q int, a bigint, b bigint, pw double")
    nodes = nodes.groupBy("context", "q").agg(*(F.sum(c).alias(c) for c in ("a", "b", "pw")))
    return nodes.groupBy("q").applyInArrow(upper, "level int, context bigint, q int, v0 double, v1 double, v2 double, v3 double, v4 double")


def _nodes(t: pa.Table) -> tuple[np.ndarray, ...]:
    if not t.num_rows:
        return (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(5)))
    node = t["context"].to_numpy() << 8 | t["q"].to_numpy()
    order = np.argsort(node)
    return (node[order], *(t[f"v{k}"].to_numpy()[order] for k in range(5)))


def probabilities(grams: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """``asked``, ``lp``: for every n-gram, with or without a count, log10 of its last byte's probability in its context."""
    top = _top(depth)
    # at most 256**(top - 2) * 255 nodes, which is 65,280, and the decisions' own
    low = upper.where(F.col("level") < top - 1).toArrow()
    low = [_nodes(low.filter(pa.array(low["level"].to_numpy() == j))) for j in range(top - 1)]

    def ask(own: pa.Table, near: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"asked": pa.array([], pa.int64()), "lp": pa.array([], pa.float64())})
        asked, n = own["gram"].to_numpy(), own["n"].to_numpy()
        levels, _ = build(asked[n > 0], n[n > 0], depth, top)
        return pa.table({"asked": asked, "lp": predict(asked, levels, depth, top, Above(low, _nodes(near)))})

    pairs = grams.select(F.col("bucket").alias("there"), F.shiftright("gram", 8 * (depth - top + 2)).alias("context")).distinct()
    near = upper.where(F.col("level") == top - 1).join(pairs, "context").select("there", "context", "q", *(f"v{k}" for k in range(5)))
    return grams.groupBy("bucket").cogroup(near.groupBy("there")).applyInArrow(ask, "asked bigint, lp double")


_ANSWERS = "to bigint, grams binary, lps binary, words array<binary>, counts array<bigint>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (chunk, n-gram, lp) or (chunk, word, count) as a row for each chunk of a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        to = b.column(0).to_numpy()
        order = np.argsort(to, kind="stable")
        to = to[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        stops = np.r_[starts[1:], len(to)]
        n = len(starts)
        if b.schema.names[1] == "word":
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[starts, len(to)].astype(np.int32)), b.column(k).take(pa.array(order))) for k in (1, 2)]
            own = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *lists]
        else:
            gram, lp = (b.column(k).to_numpy()[order] for k in (1, 2))
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())
            own = [cut(gram), cut(lp), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.record_batch([pa.array(to[starts]), *own], ["to", "grams", "lps", "words", "counts"])


def _score(texts: pa.Table, answers: pa.Table, depth: int, kind: pa.DataType) -> pa.Table:
    """A chunk's pieces, each with its tokens, known tokens, the sum of log10(count + 1), and log10 of its probability."""
    keys, lp = (np.frombuffer(b"".join(x.as_py() for x in answers[c] if x.is_valid), t) for c, t in (("grams", np.int64), ("lps", np.float64)))
    place, lp = pd.Index(keys), np.append(lp, np.nan)  # an n-gram without an answer would show
    worth = {}
    for words, counts in zip(answers["words"], answers["counts"], strict=True):
        if words.is_valid:
            worth.update(zip(words.values.to_pylist(), np.log10(counts.values.to_numpy() + 1.0).tolist(), strict=True))
    rows, ids, held, numbers = [], [], [], []
    for at in range(texts.num_rows):
        r = {c: texts[c][at].as_py() for c in ("rows", "ids", "held", "sizes", "ends", "data")}
        data = pa.decompress(r["data"], sum(r["sizes"]), codec="zstd", asbytes=True)
        sizes = np.array(r["sizes"])
        starts = np.cumsum(sizes) - sizes
        found, inside = grams_of(np.frombuffer(data, np.uint8), starts, depth)
        each = lp[place.get_indexer(found)]
        each[~inside] = 0
        score = np.add.reduceat(each, starts)
        for k, (a, size, end) in enumerate(zip(starts.tolist(), r["sizes"], r["ends"], strict=True)):
            words = data[a + depth : a + size - end].split()
            known = np.fromiter(map(worth.__getitem__, words), float, len(words))
            more = worth[None] if end else 0.0
            numbers.append((len(words) + end, int((known > 0).sum()) + (more > 0), float(known.sum()) + more, float(score[k])))
        rows += r["rows"]
        ids += r["ids"]
        held += r["held"]
    tokens, known, plus, score = zip(*numbers, strict=True) if numbers else ((), (), (), ())
    return pa.table({"row": pa.array(rows, pa.int64()), "id": pa.array(ids, kind), "held": pa.array(held, pa.bool_()), "tokens": pa.array(tokens, pa.int64()), "known": pa.array(known, pa.int64()), "plus": pa.array(plus, pa.float64()), "lp": pa.array(score, pa.float64())})


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, folds: int = FOLDS, held_out: int = HELD_OUT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for each row."""
    spark = docs.sparkSession
    ship(spark)
    name = docs.schema[doc_id].dataType.simpleString()
    kind = to_arrow_type(docs.schema[doc_id].dataType)
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    learns, waits = F.coalesce(fold != held_out, F.lit(False)), F.coalesce(fold == held_out, F.lit(False))
    parts = spill(_parts(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), waits.alias("held"), learns.alias("trains")), depth, chunk_bytes, kind, name))
    asks = parts.where("kind = 1").select("chunk", "gram", "n")
    grams = asks.groupBy("gram").agg(F.sum("n").alias("n"))
    grams = spill(grams)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(grams.count() / _GRAMS_A_BUCKET))
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("gram", 8 * (depth - _top(depth) + 1))), F.lit(buckets)).cast("int"))
    lp = probabilities(grams, spill(train(grams, depth)), depth)
    same = Window.partitionBy("word")
    words = parts.where("kind = 2").select("chunk", "word", "n")
    words = spill(words.select("chunk", "word", "n", F.sum("n").over(same).alias("c"), (F.col("chunk") == F.min("chunk").over(same)).alias("first")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    answers = asks.join(lp, F.col("gram") == F.col("asked")).select("chunk", "gram", "lp").mapInArrow(_packed, _ANSWERS)
    answers = answers.unionByName(words.select("chunk", "word", "c").mapInArrow(_packed, _ANSWERS))
    texts = parts.where("kind = 0").select("chunk", "rows", "ids", "held", "sizes", "ends", "data")
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(lambda a, b: _score(a, b, depth, kind), f"row bigint, id {name}, held boolean, tokens bigint, known bigint, plus double, lp double")
    whole = scored.groupBy("row").agg(F.first("id").alias("doc_id"), F.first("held").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("plus").alias("plus"), F.sum("lp").alias("score"))
    base = F.col("plus") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
