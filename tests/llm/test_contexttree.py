import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import contexttree as C


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7


def lower(text):
    return (text or "").encode().lower()


class Brute:
    """Context-tree weighting straight from its definition: recursion over nodes, exact counts from the training texts."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for t in texts:
            data = b"\xff" * depth + t + b"\xff"
            for i in range(depth, len(data)):
                for m in range(8):
                    prefix, bit = (m, data[i] >> (8 - m)), data[i] >> (7 - m) & 1
                    for j in range(depth + 1):
                        context = data[i - j : i]
                        self.counts[context, prefix, bit] += 1
                        if j:
                            self.children.setdefault((context[1:], prefix), set()).add(context)

        @lru_cache(None)
        def weighted(context, prefix):
            pe = self.kt(context, prefix)
            if len(context) == depth:
                return pe
            product = sum(weighted(c, prefix) for c in self.children[context, prefix])
            high = max(pe, product)
            return high + math.log(math.exp(pe - high) + math.exp(product - high)) - math.log(2)

        self.weighted = weighted

    def kt(self, context, prefix):
        a, b = (self.counts[context, prefix, k] for k in (0, 1))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def bit(self, context, prefix, bit, depth=0):
        """Probability of a bit after ``context``, from its last ``depth`` bytes on."""
        own = context[len(context) - depth :]
        a, b = (self.counts[own, prefix, k] for k in (0, 1))
        if not a + b:
            return None if depth else 0.5
        p = ((b if bit else a) + 0.5) / (a + b + 1)
        if depth == self.depth:
            return p
        stop = math.exp(self.kt(own, prefix) - math.log(2) - self.weighted(own, prefix))
        deeper = self.bit(context, prefix, bit, depth + 1)
        return p if deeper is None else stop * p + (1 - stop) * deeper

    def score(self, text):
        data = b"\xff" * self.depth + text + b"\xff"
        return sum(math.log10(self.bit(data[i - self.depth : i], (m, data[i] >> (8 - m)), data[i] >> (7 - m) & 1)) for i in range(self.depth, len(data)) for m in range(8))


def check(got, docs, depth, scored=True):
    train = [lower(t) for i, t in docs if fold(i) not in (None, 2)]
    count = Counter()
    for t in train:
        count.update([*t.split(), None])
    n, v = count.total(), len(count)
    model = Brute(train, depth) if scored else None
    want = []
    for i, t in docs:
        words = [*lower(t).split(), None]
        want.append((i, fold(i) == 2, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), model.score(lower(t)) if scored else 0.0))
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), *r[2:4], round(r[5], 4))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert not scored or a[6] == pytest.approx(b[6], rel=1e-9)


SMALL = [(i, t) for i, t, _ in AWKWARD if not t or len(t) < 200] + [(i, f"some words {i % 7} and more of them \u00e9t\u00e9 {'ab' * (i % 5)}") for i in range(100, 140)]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_against_the_definition(spark, depth):
    df = spark.createDataFrame(SMALL, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("row", "n", "gram", "word", "chunk", "held", "id", "lp", "bucket")})
    check(C.score(df, depth=depth).collect(), SMALL, depth)


def test_small_chunks_and_pieces(spark, monkeypatch):
    """Cut anywhere, the numbers are the same; the functions run in this process to see the small sizes."""
    df = spark.createDataFrame(SMALL, "doc_id bigint, text string").repartition(2)
    check(C.score(df, chunk_bytes=100).collect(), SMALL, 5)
    monkeypatch.setattr(C, "_PIECE", 7)
    for text in (b"", b"one two  three\n\nfour fivesixseveneight nine", b"nothingtocut", b" \t ", b"ab " * 40):
        pieces = list(C._pieces(text, 5))
        assert [e for _, e in pieces] == [False] * (len(pieces) - 1) + [True]
        assert b"".join(p[5:] for p, _ in pieces) == text + b"\xff" and (len(pieces) > 1) == (len(text) > 7 and b" " in text)
        past = b"\xff" * 5
        for p, _ in pieces:
            assert p[:5] == past
            past = p[-5:]
        assert [w for p, e in pieces for w in p[5 : len(p) - e].split()] == text.split()


def test_probabilities_add_up(spark):
    """Over all bytes that may follow, in known and unknown contexts, the probabilities add up to one."""
    rng = np.random.default_rng(1)
    contexts = [bytes(c) for c in rng.integers(97, 101, (20, 3)).tolist()] + [b"aaz", b"zzz", b"\xff\xff\xff"]
    train = [bytes(rng.integers(97, 101, 60).tolist()) for _ in range(30)]
    known, n = np.unique(np.concatenate([C.grams_of(np.frombuffer(b"\xff" * 3 + t + b"\xff", np.uint8), np.array([0]), 3)[0] for t in train]), return_counts=True)
    asked = np.array([int.from_bytes(c[::-1], "big") << 8 | x for c in contexts for x in range(256)])
    every = np.union1d(known, asked)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, known)] = n
    grams = spark.createDataFrame([(int(g), int(k), int(g >> 8) % 5) for g, k in zip(every, count)], "gram bigint, n bigint, bucket int")
    got = {r["asked"]: r["lp"] for r in C.probabilities(grams, C.train(grams, 3), 3).collect()}
    for c in range(len(contexts)):
        assert sum(10 ** got[int(g)] for g in asked[c * 256 : c * 256 + 256]) == pytest.approx(1, abs=1e-9)


def test_awkward_documents(spark):
    got = C.score(frame(spark))
    rows = got.collect()
    check(rows, [(i, t) for i, t, _ in AWKWARD], 5, scored=False)
    assert got.count() == len(AWKWARD) and all(r["score"] < 0 for r in rows)
    assert C.score(frame(spark, [])).collect() == []
    # nothing to learn from: each bit has probability 1/2
    alone = C.score(frame(spark, [(None, "abc", "en")])).collect()
    assert alone[0]["score"] == pytest.approx(32 * math.log10(0.5)) and alone[0]["train_tokens"] == 0
    text = C.score(frame(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert text.count() == len(AWKWARD) and dict(text.dtypes)["doc_id"] == "string"


def test_better_than_words_on_texts_it_never_saw(spark):
    rows = C.op12_context_tree(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert len(rows) > 100 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lgamma():
    x = np.r_[np.arange(0.5, 40, 0.5), 1e3, 1e6 + 0.5, 1e12]
    assert np.allclose(C.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
