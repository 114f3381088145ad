import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import lexical as L

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(L.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=50):
    """docs: (id, text); items: (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = sorted(con.sql(L.OP13_SQL).fetchall())
    got = L.op13_lexical_search(spark, d)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    assert got.count() == len(want) and got.where("rank = 1").count() == len({r[0] for r in want})


def test_shards_and_blocks(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    index = L.build_index(docs.repartition(3), shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 10
    assert sorted(map(tuple, L.search(index, items, items_a_block=7).collect()), key=str) == want


def test_awkward_documents(spark):
    items = [(1, "Alpha, WORD and x"), (1, "alpha word"), (2, None), (3, ""), (4, "unheard"), (None, "beta"), (5, "ÉTÉ été \u65e5\u672c\u8a9e a\x00b tab"), (6, "word"), (7, "x" * 5000)]
    frames = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "term", "item", "rank", "block", "score")})
    want = brute([(i, t) for i, t, _ in AWKWARD], items)
    assert sorted(map(tuple, L.search(L.build_index(frame(spark)), frames).collect()), key=str) == want
    got = L.search(L.build_index(frame(spark), shard_bytes=1), frames, k=2, items_a_block=1)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, t) for i, t, _ in AWKWARD], items, 2)
    text = L.search(L.build_index(frame(spark).withColumn("doc_id", F.col("doc_id").cast("string"))), frames)
    assert text.count() == len(want) and dict(text.dtypes)["doc_id"] == "string"


def test_nothing_to_find(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    for rows in ([], [(1, None, "en"), (2, " ... ", "en")]):
        got = L.search(L.build_index(frame(spark, rows)), items)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert L.search(L.build_index(frame(spark)), items.limit(0)).collect() == []


def test_long_text_in_slices(monkeypatch):
    text = ("Ein langer Text, mit W\u00f6rtern; und 42 Zahlen. " * 50 + "y" * 300).encode()
    whole = L.terms_of(text)
    monkeypatch.setattr(L, "_SLICE", 64)
    assert L.terms_of(text) == whole == Counter(t.encode() for t in terms(text.decode()))


def test_postings_round_trip():
    v = np.array([0, 1, 127, 128, 300, 2**31, 2**62], np.int64)
    assert L.decode(L.encode(v)).tolist() == v.tolist() and L.decode(b"").tolist() == []


@pytest.mark.parametrize("run", [1, 3, 1024])
def test_merge_document_at_a_time(monkeypatch, run):
    """Against adding up all lists, with many equal scores; runs and waiting postings of any size give the same."""
    monkeypatch.setattr(L, "_RUN", run)
    monkeypatch.setattr(L, "_PENDING", run * 4)
    rng = np.random.default_rng(run)
    for _ in range(40):
        lists, scores = [], Counter()
        for _ in range(rng.integers(0, 9)):
            docs = np.sort(rng.choice(200, rng.integers(1, 150), replace=False))
            docs = docs * (1 if rng.random() < 0.5 else 1000)
            worth = rng.integers(0, 4, len(docs))
            lists.append((docs, worth))
            for d, w in zip(docs.tolist(), worth.tolist()):
                scores[d] += w
        want = sorted(((-s, d) for d, s in scores.items() if s > 0))[:10]
        assert [(-s, d) for s, d in L.merge(lists, 10)] == want
