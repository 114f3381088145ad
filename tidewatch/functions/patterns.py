"""Many regular expressions at once, by an index over what their matches must contain.

Most patterns can match only texts that hold a certain run of plain characters. Of such a run a whole
number or word with the characters beside it is indexed, as a text has few of those, or else one gram of
eight, five or three characters: one that few patterns are likely to share. A text's words and grams are
joined with the index, by hash, which leaves the few patterns that can match at all, and those are tried by
the pattern itself. Patterns and texts are both tables, so the plan is the same for ten patterns and for a
million, and nothing is gathered. Patterns that differ only in plain letters and digits are parsed once.

Patterns without such a run of three characters are returned apart, to be tried on every text.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from re import _constants as _c
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.shared import scratch
from tidewatch.shipping import ship

GRAMS = (8, 5, 3)
#: Patterns and texts that tell which grams are common, and of how many such texts a gram is one of many.
SOME, OFTEN = 20_000, 3
#: How many patterns may share a word that is looked up, as far as some of them tell.
SHARED = 20
#: Patterns, and bytes of them and of texts, that are read at a time.
_ROWS, _BYTES = 50_000, 1 << 22
#: A number or a word with the characters on both sides, wherever there is one.
_WORDS = re.compile("(?=([^0-9][0-9]+[^0-9]|[^A-Za-z][A-Za-z]+[^A-Za-z]))")
#: Stands for the plain letter or digit of a column, which only ASCII patterns have.
_COLUMN = 0xE000
#: Constructs that Java and Python read differently: class operations, nested classes, octal escapes, quoted runs.
_DOUBTFUL = re.compile(r"&&|\[[^\]]*\[|\\[0-9QEGRXZbhHvVpPN]|\(\?[^:<=!]|\(\?<[^=!]")


def _literals(items) -> Iterator[str]:
    """Runs of characters that stand side by side in every match."""
    run = ""
    for op, arg in items:
        if op is _c.LITERAL:
            run += chr(arg)
            continue
        if op is _c.SUBPATTERN and not arg[1] and not arg[2]:
            inner = list(arg[3])
            if all(o is _c.LITERAL for o, _ in inner):
                run += "".join(chr(a) for _, a in inner)
                continue
            yield from _literals(inner)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            yield from _literals(arg[2])
        yield run
        run = ""
    yield run


def _runs(pattern: str) -> list[str] | None:
    """Runs of characters that every text with a match must contain, as far as they are sure."""
    if _DOUBTFUL.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    if parsed.state.flags & ~re.UNICODE:
        return None
    return list(_literals(parsed))


def _longest(runs: list[str] | None) -> str | None:
    best = max(runs or [], key=len, default="")
    return best if len(best) >= min(GRAMS) else None


def required(pattern: str) -> str | None:
    """The longest run of characters that every text with a match must contain, if it has at least three that are sure."""
    return _longest(_runs(pattern))


def _trigrams(run: str) -> list[str]:
    return [run[k : k + 3] for k in range(len(run) - 2)]


class Common:
    """What some patterns, one in ``share``, have in common: words that many share, how many have each three characters, and lengths at which any two words are likely to be the same. A guide to rare ones, which decides no match."""

    def __init__(self, words: dict[str, int], threes: dict[str, int], share: int = 1, lengths: Iterable[int] = ()):
        self.words, self.threes, self.lengths = {w for w, n in words.items() if n > 1 and n * share > SHARED}, threes, frozenset(lengths)

    @cached_property
    def by_length(self) -> dict[int, pa.Array]:
        """The words that many patterns have, by their bytes."""
        out: dict[int, list[str]] = {}
        for w in sorted(self.words):
            out.setdefault(len(w.encode()), []).append(w)
        return {k: pa.array(v, pa.string()) for k, v in out.items()}

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros((128, 128, 128), np.float32)
        for t, n in self.threes.items():
            if t.isascii():
                out[tuple(t.encode())] = math.log(n + 1)
        return out


def _rarest(run: str, threes: dict[str, int]) -> str:
    """The gram of a run whose threes of characters are the rarest among patterns, as far as ``threes`` knows."""
    size = next(g for g in GRAMS if len(run) >= g)
    weight = [math.log(threes.get(t, 0) + 1) for t in _trigrams(run)]
    at = min(range(len(run) - size + 1), key=lambda k: (sum(weight[k : k + size - 2]), k))
    return run[at : at + size]


def asked(pattern: str, common: Common) -> tuple[str | None, int | None]:
    """What to look up for a pattern: a word with its neighbours and 0, or a gram and its size."""
    runs = _runs(pattern)
    for word in sorted((w for r in runs or [] for w in _WORDS.findall(r)), key=len, reverse=True):
        if word not in common.words and len(word) not in common.lengths:
            return word, 0
    run = _longest(runs)
    gram = run and _rarest(run, common.threes)
    return gram, gram and len(gram)


@lru_cache(4096)
def _plain(shape: str) -> tuple[int, ...]:
    """The columns of a pattern, its letters written a and its digits 0, that hold a plain letter or digit, if that is sure."""
    found, k = [], 0
    while k < len(shape):
        c, end = shape[k], k + 1
        if c == "\\":  # with all of a longer escape
            end += 1
            while shape[k + 1 : end].isalnum() and end < len(shape) and shape[end].isalnum():
                end += 1
        elif c in "[{":
            inside = re.compile(r"\[\^?\]?(?:[^\]\\]|\\.)*\]" if c == "[" else r"\{[^}]*\}", re.DOTALL).match(shape, k)
            if inside is None:
                return ()
            end = inside.end()
        elif shape.startswith("(?", k):
            if not shape.startswith("(?:", k):
                return ()
            end = k + 3
        elif c.isalnum():
            found.append(k)
        k = end
    return tuple(found)


@lru_cache(4096)
def _template(shape: str, pattern: str) -> tuple[list[str], str | None]:
    """Words, longest first, and the longest run of all patterns of a shape; in ``pattern`` and in the results signs for columns stand where they differ."""
    runs, words = _runs(pattern), []
    for run in runs or []:
        image = "".join(shape[ord(c) - _COLUMN] if 0 <= ord(c) - _COLUMN < len(shape) else c for c in run)
        words += [run[m.start(1) : m.end(1)] for m in _WORDS.finditer(image)]
    return sorted(words, key=len, reverse=True), _longest(runs)


def _spelled(template: str, chars: np.ndarray) -> np.ndarray:
    """The bytes that a template stands for in each row of ``chars``."""
    columns = [x for c in template for x in ([chars[:, ord(c) - _COLUMN]] if 0 <= ord(c) - _COLUMN < chars.shape[1] else c.encode())]
    out = np.empty((len(chars), len(columns)), np.uint8)
    for k, x in enumerate(columns):
        out[:, k] = x
    return out


def _strings(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows)))


#: Bytes with letters written a and digits 0.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[b for b in range(128) if chr(b).isalpha()]] = ord("a")
_SHAPE[[b for b in range(128) if chr(b).isdigit()]] = ord("0")


def _buffers(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins and the last ends."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _dealt(kind: np.ndarray, kinds: int) -> list[np.ndarray]:
    """The places of each kind."""
    return np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind, minlength=kinds))[:-1])


def all_asked(patterns: pa.StringArray, common: Common) -> pa.Table:
    """``asked`` of many patterns, in any order. Those of one shape that differ in plain letters and digits only are parsed once and go column by column."""
    data, offsets = _buffers(patterns)
    shapes = pa.StringArray.from_buffers(len(patterns), pa.py_buffer(offsets), pa.py_buffer(_SHAPE[data])).dictionary_encode()
    at, found, sizes = [], [], []

    def put(rows: np.ndarray, key: pa.Array, size: np.ndarray | int | None) -> None:
        at.append(rows)
        found.append(key)
        sizes.append(size if isinstance(size, pa.Array) else pa.array([size] * len(rows), pa.int32()) if size is None else pa.array(np.full(len(rows), size, np.int32)))

    def alone(rows: np.ndarray) -> None:
        each = [asked(p, common) for p in patterns.take(pa.array(rows)).to_pylist()]
        put(rows, pa.array([g for g, _ in each], pa.string()), pa.array([n for _, n in each], pa.int32()))

    def together(rows: np.ndarray, chars: np.ndarray, words: list[str], run: str | None) -> None:
        for word in (w for w in words if len(w) not in common.lengths):
            key = _strings(_spelled(word, chars))
            known = common.by_length.get(len(key[0].as_buffer()))
            rare = np.ones(len(rows), bool) if known is None else ~pc.is_in(key, value_set=known).to_numpy(zero_copy_only=False)
            if rare.any():
                put(rows[rare], key.filter(pa.array(rare)), 0)
                rows, chars = rows[~rare], chars[~rare]
            if not len(rows):
                return
        if run is None:
            return put(rows, pa.nulls(len(rows), pa.string()), None)
        whole = _spelled(run, chars)
        if (whole > 127).any():
            return alone(rows)
        size = next(g for g in GRAMS if len(run) >= g)
        weight = np.cumsum(common.weights[whole[:, :-2], whole[:, 1:-1], whole[:, 2:]], 1, dtype=np.float64)
        weight = weight[:, size - 3 :] - np.pad(weight, ((0, 0), (1, 0)))[:, : whole.shape[1] - size + 1]
        put(rows, _strings(whole[np.arange(len(rows))[:, None], weight.round(4).argmin(1)[:, None] + np.arange(size)]), size)

    for shape, rows in zip(shapes.dictionary.to_pylist(), _dealt(shapes.indices.to_numpy(), len(shapes.dictionary)), strict=True):
        plain = _plain(shape) if len(rows) > 3 and shape.isascii() and len(shape) < 4096 else ()
        if not plain:
            alone(rows)
            continue
        chars = data[offsets[rows][:, None] + np.arange(len(shape))]
        fixed = chars[:, sorted({k for k, c in enumerate(shape) if c.isalnum()} - set(plain))]
        group = np.zeros(len(rows), np.int64) if (fixed == fixed[0]).all() else np.unique(fixed, axis=0, return_inverse=True)[1].reshape(-1)
        for own in _dealt(group, group.max() + 1):
            text = chars[own[0]].tobytes().decode()
            if len(own) < 4 or re.search(r"\\[uUN]", text):
                alone(rows[own])
                continue
            marked = list(text)
            for k in plain:
                marked[k] = chr(_COLUMN + k)
            together(rows[own], chars[own], *_template(shape, "".join(marked)))
    return pa.table({"pattern": patterns.take(pa.array(np.concatenate(at))), "gram": pa.concat_arrays(found), "size": pa.concat_arrays(sizes)})


_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of stretches of bytes."""
    power, inverse = _powers(1 << max(20, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    return ((sums[ends] - sums[begins]) * inverse[begins]).view(np.int64)


def keys(texts: pa.StringArray, sizes: list[int]) -> pa.ListArray:
    """Hashes of what the index may have of each text: its words with their neighbours (size 0) and its grams of other ``sizes``."""
    data, offsets = _buffers(texts)
    begins = (data & 0xC0) != 0x80
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(begins)  # of each character
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, offsets)))
    begin, n = np.append(begin, len(data)), len(begin)
    rows, first, last = [row[:0]], [begin[:0]], [begin[:0]]
    for size in sizes:
        if size:
            at = np.arange(max(n - size + 1, 0))
            at = at[row[at] == row[at + size - 1]]
            stop = at + size
        else:
            kind = _SHAPE[data[begin[:-1]]]
            edge = np.append(np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (row[1:] != row[:-1]))[:n]), n)
            at, stop = edge[:-1], edge[1:]
            word = ((kind[at] == ord("a")) | (kind[at] == ord("0"))) & (at > 0) & (stop < n)
            at, stop = at[word] - 1, stop[word] + 1
            inside = (row[at] == row[at + 1]) & (row[stop - 1] == row[stop - 2])
            at, stop = at[inside], stop[inside]
        rows.append(row[at])
        first.append(begin[at])
        last.append(begin[stop])
    found = np.concatenate(rows)
    order = np.argsort(found, kind="stable")
    hashes = _hashes(data, np.concatenate(first), np.concatenate(last))[order]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(found, minlength=len(texts)))).astype(np.int32)), pa.array(hashes, pa.int64()))


def with_keys(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``text`` with each of its ``keys`` (``gram``)."""
    ship(texts.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, done = b.column(0).cast(pa.string()), 0
            while done < len(column):
                n = max(1, int(np.searchsorted(_buffers(column[done:])[1], _BYTES // 4, "right")) - 1)
                part = column[done : done + n]
                yield pa.record_batch([part, keys(part, sizes)], ["text", "grams"])
                done += n

    return texts.select("text").mapInArrow(read, "text string, grams array<bigint>").select("text", F.explode(F.array_distinct("grams")).alias("gram"))


def with_asked(patterns: DataFrame, common: Common) -> DataFrame:
    """``pattern`` with the hash of what to look up (``gram``, ``size``)."""
    ship(patterns.sparkSession)

    def found(held: list[pa.Array]) -> list[pa.RecordBatch]:
        t = all_asked(pa.concat_arrays(held), common)
        gram = t["gram"].combine_chunks()
        data, offsets = _buffers(pc.fill_null(gram, ""))
        hashes = pa.array(_hashes(data, offsets[:-1], offsets[1:]), mask=gram.is_null().to_numpy(zero_copy_only=False))
        return pa.table({"gram": hashes, "size": t["size"], "pattern": t["pattern"]}).to_batches(10_000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for b in batches:
            held.append(b.column(0).cast(pa.string()))
            if sum(map(len, held)) >= _ROWS or sum(x.nbytes for x in held) >= _BYTES:
                yield from found(held)
                held = []
        if sum(map(len, held)):
            yield from found(held)

    return patterns.select("pattern").mapInArrow(read, "gram bigint, size int, pattern string")


def _common(patterns: DataFrame, share: int) -> Common:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [_runs(p) or [] for p in b.column(0).to_pylist()]
            words = [(1, w) for rs in runs for w in {w for r in rs for w in _WORDS.findall(r)}]
            found = words + [(0, t) for rs in runs for t in set(_trigrams(_longest(rs) or ""))]
            yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], ["word", "part"])

    ship(patterns.sparkSession)
    some = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(share)) == 0).distinct().limit(SOME).mapInArrow(read, "word int, part string")
    parts = some.groupBy("word", "part").agg(F.count("*").alias("n")).persist()
    most = [parts.where((F.col("word") == w) & (F.col("n") > 1)).orderBy(F.desc("n"), "part").limit(k * SOME) for w, k in ((0, 1), (1, 5))]
    # how many of all patterns share a word of a length, on average, as pairs among some tell
    met = parts.where((F.col("word") == 1) & (F.col("n") <= SHARED)).groupBy(F.length("part").alias("length")).agg((share * F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).alias("sharing"))
    threes, words = ({r["part"]: r["n"] for r in x.collect()} for x in most)
    lengths = [r["length"] for r in met.where(F.col("sharing") > SHARED).collect()]
    parts.unpersist()
    return Common(words, threes, share, lengths)


def index(patterns: DataFrame, about: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``patterns`` (``pattern``; ``about`` so many) as an index (``gram``: the hash of a word or gram, ``size``, ``pattern``), and those that can't be indexed. Both are read once, into a table in the shared folder."""
    spark = patterns.sparkSession
    patterns = patterns.where("pattern IS NOT NULL")
    about = patterns.count() if about is None else about
    found = with_asked(patterns.distinct(), _common(patterns, max(1, about // SOME)))
    path = scratch(spark, "patterns")
    found.write.parquet(path)
    table = spark.read.schema("gram bigint, size int, pattern string").parquet(path)
    return table.where("size IS NOT NULL"), table.where("size IS NULL").select("pattern")


def matching(texts: DataFrame, text: str, by_gram: DataFrame, whole: bool) -> DataFrame:
    """The values of ``text`` that some pattern of the index matches, each once; ``whole``: as a whole, else anywhere.

    Words and grams go by their hashes, only of sizes that the index has, and without those that many texts hold and no pattern asks for.
    """
    every = texts.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    counts = {r["size"]: r["count"] for r in by_gram.groupBy("size").count().collect()}
    sizes = sorted(counts)
    often = with_keys(every.limit(SOME), sizes).groupBy("gram").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "gram").limit(10 * SOME).select("gram")
    wanted = by_gram.select("gram").join(F.broadcast(often), "gram", "left_semi").distinct()
    idle = F.broadcast(often.join(F.broadcast(wanted), "gram", "left_anti"))
    t = F.col("text")
    test = F.regexp_like(t, F.concat(F.lit(r"\A(?:"), "pattern", F.lit(r")\z")) if whole else F.col("pattern"))
    grams = with_keys(every.distinct(), sizes).join(idle, "gram", "left_anti")
    asking = by_gram.select("gram", "pattern")
    if sum(counts.values()) > 10 * SOME:  # by the size of its files alone the texts' side may look small enough to broadcast
        asking = asking.hint("merge")
    return grams.join(asking, "gram").where(test).select("text").distinct()
