"""Language identification by a byte convolutional network in numpy.

The lower-cased UTF-8 bytes of a text are cut into windows of a fixed length,
all of them, the last one padded with zero bytes. Filters of several widths run
over learned byte vectors, each filter keeps its maximum over the window, and a
softmax layer gives the languages. A text's probabilities are the mean over its
windows, weighted by their bytes.

A filter's answer is a sum over its byte positions, so for prediction the net is
unfolded into tables for single bytes and byte pairs; a window then costs a few
table lookups for each byte.

Training takes a bounded sample of the labelled rows: about ``ROWS_A_LANGUAGE``
for each of the ``LANGUAGES`` most frequent languages, drawn by a hash of the id, and
``WINDOWS_A_ROW`` windows of each, spread over the whole text. Prediction reads every byte of every text.

Defined results: null text and text without a letter give ``und`` with score 0;
so does every text if there is no labelled row to learn from. Rows are neither
dropped nor merged, null ids are passed through (they never train, and count as
not held out), and equal texts get equal answers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.runtime import ship, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
BYTE_DIMS = 8
ROWS_A_LANGUAGE = 600
WINDOWS_A_ROW = 4
LANGUAGES = 256
EPOCHS = 8
FOLDS = 5
UNKNOWN = "und"
#: The pipeline rejects a document whose mean probability is no more than this above chance, which is 1/C with C languages.
REJECT_MARGIN = 0.05
_BATCH = 128


@dataclass
class ByteCNN:
    langs: list[str]
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    _tables: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"} | {"_tables": []}

    def tables(self) -> list[tuple[slice, list[tuple[int, bool, np.ndarray]]]]:
        """For each width: its features, and lookups (offset, by pair of bytes, table)."""
        if not self._tables:
            for k, w in enumerate(WIDTHS):
                one = [(self.emb @ self.conv[w][i]).astype(np.float32) for i in range(w)]
                parts = [(i, True, (one[i][:, None] + one[i + 1][None]).reshape(65536, -1)) for i in range(0, w - 1, 2)]
                if w % 2:
                    parts.append((w - 1, False, one[w - 1]))
                self._tables.append((slice(k * FILTERS, (k + 1) * FILTERS), parts))
        return self._tables

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each window."""
        got = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        single = windows.astype(np.int32)
        pair = single[:, :-1] * 256 + single[:, 1:]
        for (cols, parts), w in zip(self.tables(), WIDTHS, strict=True):
            n = WINDOW - w + 1
            total = None
            for at, pairs, values in parts:
                x = values.take((pair if pairs else single)[:, at : at + n], axis=0)
                total = x if total is None else np.add(total, x, out=total)
            got[:, cols] = total.max(axis=1)
        return got

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = np.maximum(self.features(windows) + self.bias, 0) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, WINDOW, np.int64)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return flat.reshape(n, WINDOW), sizes


def _gradient(p: dict[str, np.ndarray], b: np.ndarray, want: np.ndarray, weight: np.ndarray, kind: type = np.float32) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted loss of windows ``b`` with languages ``want``, and its gradient by each parameter."""
    vec = p["emb"].astype(kind)[b]
    tops, where = [], []
    for w in WIDTHS:
        n = WINDOW - w + 1
        cols = np.concatenate([vec[:, i : i + n] for i in range(w)], axis=2).reshape(-1, w * BYTE_DIMS)
        answer = (cols @ p[f"c{w}"].reshape(w * BYTE_DIMS, FILTERS).astype(kind)).reshape(len(b), n, FILTERS)
        at = answer.argmax(axis=1)
        where.append(at)
        tops.append(np.take_along_axis(answer, at[:, None], axis=1)[:, 0])
    pre = np.concatenate(tops, axis=1) + p["bias"]
    hidden = np.maximum(pre, 0)
    logits = hidden @ p["out"] + p["out_bias"]
    prob = np.exp(logits - logits.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    loss = -(np.log(prob[np.arange(len(b)), want]) * weight).sum()
    prob[np.arange(len(b)), want] -= 1
    d = prob * weight[:, None]
    g = {"out": hidden.T @ d, "out_bias": d.sum(axis=0)}
    back = (d @ p["out"].T) * (pre > 0)
    g["bias"], g["emb"] = back.sum(axis=0), np.zeros_like(p["emb"])
    for k, w in enumerate(WIDTHS):
        part, g[f"c{w}"] = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(p[f"c{w}"])
        for i in range(w):
            by_byte = np.zeros((256, FILTERS))
            np.add.at(by_byte, (np.take_along_axis(b, where[k] + i, axis=1), np.arange(FILTERS)[None]), part)
            g[f"c{w}"][i] = p["emb"].T @ by_byte
            g["emb"] += by_byte @ p[f"c{w}"][i].T
    g["emb"][0] = 0
    return loss, g


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> ByteCNN | None:
    """Fit the net to (language, piece of text) pairs with Adam; None without samples."""
    if not samples:
        return None
    langs = sorted({lang for lang, _ in samples})
    x = np.stack([windows_of(t.lower().encode("utf-8", "replace")[:WINDOW])[0][0] for _, t in samples])
    y = np.array([langs.index(lang) for lang, _ in samples])
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.5, (256, BYTE_DIMS)), "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))), "bias": np.zeros(len(WIDTHS) * FILTERS), "out_bias": np.zeros(len(langs))}
    p |= {f"c{w}": rng.normal(0, (w * BYTE_DIMS) ** -0.5, (w, BYTE_DIMS, FILTERS)) for w in WIDTHS}
    p["emb"][0] = 0
    mean, var = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    weight = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), _BATCH):
            pick = order[s : s + _BATCH]
            b, want = x[pick].astype(np.int64), y[pick]
            g = _gradient(p, b, want, weight[want] / len(b))[1]
            step += 1
            for name, v in g.items():
                mean[name] = 0.9 * mean[name] + 0.1 * v
                var[name] = 0.999 * var[name] + 0.001 * v * v
                p[name] -= 0.004 * (mean[name] / (1 - 0.9**step)) / (np.sqrt(var[name] / (1 - 0.999**step)) + 1e-8)
    f32 = {k: v.astype(np.float32) for k, v in p.items()}
    return ByteCNN(langs, f32["emb"], {w: f32[f"c{w}"] for w in WIDTHS}, f32["bias"], f32["out"], f32["out_bias"])


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """The bounded training sample: (language, piece) from rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where((_fold(F.col("i")) != 0) & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    if not counts:
        return []
    shares = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, ROWS_A_LANGUAGE / n))])
    share = F.coalesce(F.try_element_at(shares, F.col("l")), F.lit(0.0))
    draw = F.pmod(F.xxhash64("i"), F.lit(1_000_003)) / 1_000_003
    n = F.length("t")
    room = F.greatest(n - WINDOW, F.lit(0))
    spread = F.array(*[F.substring("t", (room * (k / max(1, WINDOWS_A_ROW - 1))).cast("int") + 1, WINDOW) for k in range(WINDOWS_A_ROW)])
    picked = rows.where(draw < share).select("i", "l", F.array_distinct(spread).alias("p"))
    # the draw keeps about ROWS_A_LANGUAGE rows of a language; the limit bounds ids that repeat
    got = picked.orderBy(F.xxhash64("i", F.lit(1)), "i", "l").limit(2 * ROWS_A_LANGUAGE * len(counts)).collect()
    return [(r["l"], piece) for r in got for piece in r["p"] if any(map(str.isalpha, piece))]


def _answers(model: ByteCNN | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    sums = np.zeros((len(texts), len(model.langs)))
    total = np.zeros(len(texts))
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []

    def run() -> None:
        if not parts:
            return
        all_windows, sizes = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        owner = np.repeat([x[0] for x in parts], [len(x[2]) for x in parts])
        for s in range(0, len(sizes), _BATCH):
            np.add.at(sums, owner[s : s + _BATCH], model.probabilities(all_windows[s : s + _BATCH]) * sizes[s : s + _BATCH, None])
        np.add.at(total, owner, sizes)
        parts.clear()

    waiting = 0
    for k, t in enumerate(texts):
        if t is None or not any(map(str.isalpha, t)):
            continue
        data = t.lower().encode("utf-8", "replace")
        for s in range(0, len(data), 1 << 20):  # a multiple of WINDOW, so the windows stay the same
            parts.append((k, *windows_of(data[s : s + (1 << 20)])))
            waiting += len(parts[-1][2])
            if waiting >= 4096:
                run()
                waiting = 0
    run()
    for k in np.flatnonzero(total):
        best = int(sums[k].argmax())
        names[k], scores[k] = model.langs[best], min(1.0, max(0.0, sums[k, best] / total[k]))
    return names, scores


def _predict_batches(batches: Iterator[pa.RecordBatch], model: ByteCNN | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, scores = _answers(model, b.column(b.num_columns - 1).to_pylist())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], names=[*b.schema.names[:-1], "__tw_lang", "__tw_score"])


def predict(docs: DataFrame, model: ByteCNN | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` (new name → column), ``__tw_lang`` and ``__tw_score``."""
    ship(docs.sparkSession)
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text).cast("string").alias("__tw_text"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(lambda x: _predict_batches(x, model), f"{kinds}, __tw_lang string, __tw_score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for each row."""
    model = train(sample(docs))
    found = predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False))})
    return found.withColumnsRenamed({"__tw_lang": "lang_pred", "__tw_score": "score"})


def reject_below(model: ByteCNN) -> float:
    return min(1.0, 1 / len(model.langs) + REJECT_MARGIN)


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is recognised, with their columns; a missing ``lang`` is filled in.

    Rejected: no letter at all, or a mean probability under ``reject_below``. A language that wasn't learned often
    scores higher than that: the net knows no others. Without any labelled row nothing is learned, and only documents
    without a letter go.
    """
    model = train(sample(docs, text=text, lang=lang))
    names = docs.columns
    found = predict(docs, model, {f"c{k}": F.col(f"`{c}`") for k, c in enumerate(names)}, text)
    if model is None:
        kept = found.where(F.col(f"c{names.index(text)}").rlike(r"\p{L}"))
    else:
        kept = found.where((F.col("__tw_lang") != UNKNOWN) & (F.col("__tw_score") >= reject_below(model)))
    filled = F.coalesce(F.col(f"c{names.index(lang)}"), F.when(F.col("__tw_lang") != UNKNOWN, F.col("__tw_lang")))
    return kept.select(*[(filled if c == lang else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
