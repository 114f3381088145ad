"""Personal data in text: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans, leftmost and non-overlapping for each kind:
e-mail address, IPv4 address, payment card (Luhn) and international phone number.

The field adds what they miss: numbers and addresses written in other ways, such
as ``(212) 555-0147``, ``name (at) host (dot) org`` or card numbers grouped with
points. It looks at islands, the surroundings of a digit group, a bracketed or
spaced point between digits, or an at-sign or at-word outside the base spans. An
island is a sequence of tokens; candidate segments are runs of up to
``MAX_TOKENS`` tokens, scored as wholes by features of their form (digit count,
checksum, grouping, separators, what stands next to them), and a dynamic program
over all segmentations chooses boundaries and kinds jointly. The weights are trained
in numpy by gradient ascent on the log-likelihood of generated sequences, the same
on every machine. A segment is added only if the
best segmentation contains it and its probability is ``LEAST_PROBABILITY`` at
least; base spans always stay and are never overlapped. An island is decoded
whole, however long: only the features are worked out block by block.

Defined results: null text counts as empty; no spans give zero counts, the hash
of the empty string and an empty ``spans``. Offsets are code points, the end
exclusive. Rows are neither dropped nor merged; ids, null or not, pass through.
A very long text is read in the memory of one task, its patterns in linear time and
its islands with a state of a few numbers for each token. Of equally good segmentations
the one with fewer or longer-begun entities is taken: an entity must better the
segmentation without it, and of entities that end at one token the first to begin wins.
Of equally good kinds the first in ``KINDS`` wins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.runtime import ship, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
LEAST_PROBABILITY = 0.8
ISLAND_CHARS = 48
_TOKENS_AT_ONCE = 1024
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, as a part that stops short of its last digit can't be followed by a point
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# digits, a bracketed or spaced point between digits, an at-sign or at-word
_SEED = re.compile(r"[(]?[0-9][0-9(). -]{5,}[0-9]|[0-9](?: ?[(\[] ?\. ?[)\]] ?| \. ?|\. )[0-9]|@|[(\[] ?at ?[)\]]", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern spans, by start and then kind."""
    found: list[Span] = []
    end = 0
    if "@" in text:
        for m in _HOST.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, end := m.end()))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the semi-Markov field ----------------------------------------------------

_FEATURES = ("bias", "one token", "digits 7-8", "digits 9-11", "digits 12-19", "luhn", "quads to 255", "groups of 3-3-4", "groups of 4", "points only", "dashes only", "spaces", "brackets", "plus", "at word", "dot word", "ends in letters", "letters", "odd sign", "touches letter or digit", "touches sign", "other groups", "many digits", "no digit and no at", "at word without a name before it or an ending", "at word and words in a row", "checked groups of 4", "three points between numbers to 255", "goes on after a dot word", "number with a leading zero", "number goes on before or after")
_AT, _DOT = {"at", "@"}, {"dot", "."}


def _goes_on(tokens: list[str], j: int) -> bool:
    """Whether a dot or dot word and a name follow, as in ``… example (dot) com``."""
    rest = [t.lower() for t in tokens[j : j + 8] if not t.isspace()][:4]
    while rest and rest[0] in "([":
        rest.pop(0)
    return len(rest) >= 2 and rest[0] in _DOT and (rest[0] == "dot" or not tokens[j].isspace()) and any(t.isalnum() for t in rest[1:3]) and (rest[0] == "dot" or rest[1].isalnum() and not tokens[j + 1].isspace())


def _number_beside(near: list[str]) -> bool:
    """Whether a point, or a dash with or without blanks, and a number come next."""
    rest = [t for t in near if not t.isspace()]
    return len(rest) >= 2 and rest[1].isdigit() and (rest[0] == "-" or near[0] == "." and near[1] == rest[1])


def _segment(tokens: list[str], i: int, j: int) -> np.ndarray:
    """Features of the tokens i … j - 1 as one span."""
    seg = tokens[i:j]
    groups = [t for t in seg if t.isdigit()]
    digits = "".join(groups)
    sizes = tuple(len(g) for g in groups)
    words = [t.lower() for t in seg if t.isalpha()]
    signs = {t for t in seg if not t.isalnum() and not t.isspace()}
    n = len(digits)
    before, after = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    at_word = sum(t.lower() in _AT for t in seg) == 1
    shaped = sizes[-3:] == (3, 3, 4) and len(sizes) <= 4
    quads = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    fours = len(sizes) >= 3 and set(sizes[:-1]) == {4}
    return np.array([
        1, len(seg) == 1, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, 12 <= n <= 19 and luhn(digits), quads, shaped, fours, signs == {"."}, signs == {"-"},
        any(t.isspace() for t in seg[1:-1]), {"(", ")"} <= signs and seg.count("(") == seg.count(")"), seg[0] == "+", at_word and len(words) >= 2, at_word and any(t.lower() in _DOT for t in seg[2:]),
        at_word and seg[-1].isalpha() and 2 <= len(seg[-1]) <= 6, bool(words) and not at_word, bool(signs - set(".-()[]@+_")),
        before[-1].isalnum() or after[0].isalnum(), before in {".", "-", "@", "+", "#", "/", "_", "="} or after in {"-", "@", "/", "_", "="}, bool(groups) and not (shaped or quads or fours), n > 19, not groups and not at_word, at_word and not (seg[0].isalnum() and not {seg[0].lower(), seg[-1].lower()} & (_AT | _DOT)),
        at_word and any((a.isalnum() or a == ".") and b.isspace() and c.isalnum() for a, b, c in zip(seg, seg[1:], seg[2:], strict=False)),
        fours and 12 <= n <= 19 and luhn(digits), quads and seg.count(".") == 3, at_word and _goes_on(tokens, j), any(len(g) > 1 and g[0] == "0" for g in groups),
        bool(groups) and (_number_beside(tokens[j : j + 4]) or _number_beside(tokens[max(0, i - 4) : i][::-1])),
    ], np.float64)


def _lattice(tokens: list[str], first: int = 1, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All candidate segments (start, end) that end at token ``first`` to ``last``, by end, and their features. They end in a letter or digit and start in one, a bracket or a plus sign."""
    ends = range(first, (len(tokens) if last is None else last) + 1)
    spans = [(i, j) for j in ends if tokens[j - 1].isalnum() for i in range(max(0, j - MAX_TOKENS), j) if tokens[i].isalnum() or tokens[i] in "(+"]
    return np.array(spans, np.int64).reshape(-1, 2), np.array([_segment(tokens, i, j) for i, j in spans]).reshape(-1, len(_FEATURES))


def _logsum(x: np.ndarray) -> np.ndarray:
    """Logs of the sums of the exponentials of each row."""
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _sums(merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the sums over the segmentations before and after each token; those outside entities score 0. ``merged``: scores by end and length - 1."""
    n = len(merged) - 1
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    back = np.arange(MAX_TOKENS)
    for j in range(1, n + 1):
        k = back[:j]
        alpha[j] = np.logaddexp.reduce(np.append(alpha[j - 1 - k] + merged[j, k], alpha[j - 1]))
    for i in range(n - 1, -1, -1):
        k = back[: n - i]
        beta[i] = np.logaddexp.reduce(np.append(beta[i + 1 + k] + merged[i + 1 + k, k], beta[i + 1]))
    return alpha, beta


def _examples(count: int = 480, seed: int = 3) -> Iterator[tuple[str, list[Span]]]:
    """Generated sequences with their spans: each kind in several spellings, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9)))

    def card() -> str:
        body = str(rng.integers(3, 7)) + num(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def no_card() -> str:
        c = card()
        return c[:-1] + str((int(c[-1]) + int(rng.integers(1, 10))) % 10)

    fours = lambda d, sep: sep.join(d[k : k + 4] for k in range(0, 16, 4))
    area = lambda: str(rng.integers(2, 10)) + num(2)
    real = [
        ("phone", lambda: f"({area()}) {num(3)}-{num(4)}"), ("phone", lambda: f"{area()}-{num(3)}-{num(4)}"), ("phone", lambda: f"{area()}.{num(3)}.{num(4)}"), ("phone", lambda: f"1-{area()}-{num(3)}-{num(4)}"),
        ("card", lambda: fours(card(), ".")), ("card", lambda: fours(card(), " - ")), ("email", lambda: f"{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'net'])}"), ("email", lambda: f"{word()} [at] {word()} [dot] {rng.choice(['com', 'org', 'net'])}"),
        ("email", lambda: f"{word()} @ {word()}.{rng.choice(['com', 'org', 'net'])}"), ("email", lambda: f"{word()}(at){word()}.{rng.choice(['com', 'org', 'net'])}"), ("ip", lambda: ".".join(str(x) for x in rng.integers(0, 256, 3)) + f" .{rng.integers(0, 256)}"), ("ip", lambda: "[.]".join(str(x) for x in rng.integers(0, 256, 4))),
        ("email", lambda: f"{word()} [at] {word()} [dot] {word()} [dot] {rng.choice(['com', 'org', 'net'])}"), ("email", lambda: f"{word()}.{word()} (at) {word()}.{word()}.{rng.choice(['com', 'org', 'net'])}"),
    ]
    false = [no_card, lambda: fours(no_card(), "."), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: num(8), lambda: f"{num(3)} {num(5)} {num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(5)}-{num(5)}", lambda: f"{num(4)} {num(4)}", lambda: f"{word()}{num(7)}{word()}", lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: f"({word()} at) {word()}", lambda: f"{num(6)} - {num(6)}", lambda: f"{num(12)}", lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"{num(2)} ({num(4)}), {num(3)}-{num(3)}", lambda: f"{num(20)}-{num(9)}"]
    for k in range(count):
        text, spans = word() + " ", []
        for _ in range(int(rng.integers(1, 3))):
            if rng.random() < 0.5:
                kind, make = real[int(rng.integers(len(real)))]
                value = make()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = false[int(rng.integers(len(false)))]()
            text += value + rng.choice([" ", ", ", ". ", " " + word() + " "])
        yield text + (word() if k % 3 else ""), spans


@cache
def weights(steps: int = 250, rate: float = 0.2, penalty: float = 1e-5) -> np.ndarray:
    """(kind, feature) weights of the field; trained once in a process, by Adam on all sequences at once."""
    likelihood = _Likelihood(list(_examples()))
    w = np.zeros((len(KINDS), len(_FEATURES)))
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = likelihood(w)[1] - penalty * w
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return w


class _Likelihood:
    """Mean log-likelihood of labelled sequences, and its gradient, for given weights."""

    def __init__(self, examples: list[tuple[str, list[Span]]]):
        seqs = [([m[0] for m in _TOKEN.finditer(text)], spans) for text, spans in examples]
        rows, feats, gold = [], [], []
        for s, (tokens, spans) in enumerate(seqs):
            at = np.cumsum([0, *map(len, tokens)]).tolist()
            want = {(a, b): KINDS.index(kind) for kind, a, b in spans}
            segs, f = _lattice(tokens)
            rows += [(s, i, j - i - 1) for i, j in segs.tolist()]
            gold += [want.get((at[i], at[j]), -1) for i, j in segs.tolist()]
            feats.append(f)
        self.count, self.n = len(seqs), max(len(t) for t, _ in seqs)
        self.place, self.x, self.gold = np.array(rows).T, np.concatenate(feats), np.array(gold)
        self.target = np.stack([self.x[self.gold == kind].sum(axis=0) for kind in range(len(KINDS))])

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        (s, i, k), n = self.place, self.n
        scores = self.x @ w.T
        merged = np.full((self.count, n, MAX_TOKENS), -np.inf)
        merged[s, i, k] = _logsum(scores)
        alpha, beta = np.zeros((self.count, n + 1)), np.zeros((self.count, n + 1))
        for j in range(1, n + 1):
            back = np.arange(min(j, MAX_TOKENS))
            alpha[:, j] = _logsum(np.c_[alpha[:, j - 1], alpha[:, j - 1 - back] + merged[:, j - 1 - back, back]])
        for j in range(n - 1, -1, -1):
            ahead = np.arange(min(n - j, MAX_TOKENS))
            beta[:, j] = _logsum(np.c_[beta[:, j + 1], beta[:, j + 1 + ahead] + merged[:, j, ahead]])
        prob = np.exp((alpha[s, i] + beta[s, i + k + 1] - alpha[s, -1])[:, None] + scores)
        value = ((w * self.target).sum() - alpha[:, -1].sum()) / self.count
        return value, (self.target - prob.T @ self.x) / self.count


def added_spans(text: str, base: list[Span], w: np.ndarray) -> list[Span]:
    """Spans of the field outside the base spans."""
    seeds = list(_SEED.finditer(text))
    if not seeds:
        return []
    blocked = sorted((s, e) for _, s, e in base)
    islands: list[list[int]] = []
    for m in seeds:
        lo, hi = max(0, m.start() - ISLAND_CHARS), min(len(text), m.end() + ISLAND_CHARS)
        if islands and lo <= islands[-1][1]:
            islands[-1][1] = hi
        else:
            islands.append([lo, hi])
    pieces: list[tuple[int, int]] = []
    b = 0
    for lo, hi in islands:
        at = lo
        while b < len(blocked) and blocked[b][1] <= lo:
            b += 1
        k = b
        while k < len(blocked) and blocked[k][0] < hi:
            if blocked[k][0] > at:
                pieces.append((at, blocked[k][0]))
            at = max(at, blocked[k][1])
            k += 1
        if at < hi:
            pieces.append((at, hi))
    out: list[Span] = []
    for lo, hi in pieces:
        if _SEED.search(text, lo, hi):
            out += _decode(text, lo, hi, w)
    return out


def _decode(text: str, lo: int, hi: int, w: np.ndarray) -> list[Span]:
    tokens = [m[0] for m in _TOKEN.finditer(text, lo, hi)]
    at = (lo + np.cumsum([0, *map(len, tokens)])).tolist()
    n = len(tokens)
    merged = np.full((n + 1, MAX_TOKENS), -np.inf)
    # of the best segmentation up to each token: its score, and the entity that ends there (start, kind, score)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for first in range(1, n + 1, _TOKENS_AT_ONCE):
        last = min(n, first + _TOKENS_AT_ONCE - 1)
        seg, feats = _lattice(tokens, first, last)
        scores = feats @ w.T
        merged[seg[:, 1], seg[:, 1] - seg[:, 0] - 1] = _logsum(scores) if len(scores) else 0.0
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(first, last + 1)]
        for (i, j), kind, s in zip(seg.tolist(), scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True):
            ends[j - first].append((i, kind, s))
        for j in range(first, last + 1):
            best[j] = best[j - 1]
            for x in ends[j - first]:
                if (s := best[x[0]] + x[2]) > best[j]:
                    best[j], back[j] = s, x
    entities, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            entities.append((j, *back[j]))
            j = back[j][0]
    if not entities:
        return []
    alpha, beta = _sums(merged)
    found = []
    for j, i, kind, score in reversed(entities):
        s, e = at[i], at[j]
        touches = (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
        if alpha[i] + score + beta[j] - alpha[n] >= np.log(LEAST_PROBABILITY) and not touches:
            found.append((KINDS[kind], s, e))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]`` of its first one."""
    out, at, end = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def find(text: str | None, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together."""
    base = base_spans(text or "")
    return base, base + added_spans(text or "", base, w)


def _span_batches(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [find(t.as_py(), w) for t in b.column(1)]
        counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([joined(every) for _, every in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base counts ``n_…``, ``base_sha256`` and all ``spans`` of each row."""
    ship(docs.sparkSession)
    w = weights()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(lambda b: _span_batches(b, w), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def _redact_batches(batches: Iterator[pa.RecordBatch], at: int, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pa.array([None if (t := x.as_py()) is None else redact(t, find(t, w)[1]) for x in b.column(at)], pa.string())
        yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text`` replaced by its kind, ``n_chars`` counted anew."""
    ship(docs.sparkSession)
    w, names = weights(), docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    at = names.index(text)
    out = plain.mapInArrow(lambda b: _redact_batches(b, at, w), plain.schema)

    def col(k: int, c: str) -> Column:
        return F.length(f"c{at}").cast(docs.schema[c].dataType) if c == n_chars else F.col(f"c{k}")

    return out.select(*[col(k, c).alias(c) for k, c in enumerate(names)])


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
