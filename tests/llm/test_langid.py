import zlib

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import langid as K

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = {r.doc_id: r for r in K.op10_language_id(spark, DIR).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.97


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("xx")).otherwise(F.col("lang")))
    assert K.sample(changed) == K.sample(docs)
    assert "xx" not in {r.lang_pred for r in K.identify(changed).collect()}


def test_awkward_documents(spark, docs):
    model = K.train(K.sample(docs), epochs=2)
    from pyspark.sql import functions as F

    got = K.predict(frame(spark), model, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        letters = r.text is not None and any(map(str.isalpha, r.text))
        assert (r["__tw_lang"] == "und" and r["__tw_score"] == 0) != letters
    assert K.identify(frame(spark, [])).isEmpty()
    unlabelled = frame(spark, [(1, "text", None), (2, "...", None)])
    assert {(r.lang_pred, r.score) for r in K.identify(unlabelled).collect()} == {("und", 0.0)}
    assert [r.doc_id for r in K.keep_identified(unlabelled).collect()] == [1]


def test_stage_keeps_columns_and_clean_documents(spark, docs):
    kept = K.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_tables_agree_with_the_convolution(docs):
    model = K.train(K.sample(docs), epochs=1)
    x = K.windows_of("Straße école niño the end".encode() * 40)[0]
    vec = model.emb[x.astype(int)]
    want = []
    for w in K.WIDTHS:
        n = K.WINDOW - w + 1
        want.append(sum(vec[:, i : i + n] @ model.conv[w][i] for i in range(w)).max(axis=1))
    assert np.allclose(model.features(x), np.concatenate(want, axis=1), atol=1e-4)


def test_the_gradient_against_differences():
    rng = np.random.default_rng(3)
    p = {"emb": rng.normal(0, 0.5, (256, K.BYTE_DIMS)), "out": rng.normal(0, 0.2, (len(K.WIDTHS) * K.FILTERS, 3)), "bias": rng.normal(0, 0.1, len(K.WIDTHS) * K.FILTERS), "out_bias": rng.normal(0, 0.1, 3)}
    p |= {f"c{w}": rng.normal(0, 0.3, (w, K.BYTE_DIMS, K.FILTERS)) for w in K.WIDTHS}
    b, want, weight = rng.integers(97, 123, (5, K.WINDOW)), np.array([0, 1, 2, 1, 0]), rng.random(5)
    grad = K._gradient(p, b, want, weight, np.float64)[1]
    for name, v in p.items():
        for at in rng.integers(0, v.size, 6):
            if name == "emb":
                at = 97 * K.BYTE_DIMS + at % (26 * K.BYTE_DIMS)
            losses = []
            for step in (1e-6, -1e-6):
                moved = v.copy()
                moved.flat[at] += step
                losses.append(K._gradient(p | {name: moved}, b, want, weight, np.float64)[0])
            assert abs((losses[0] - losses[1]) / 2e-6 - grad[name].flat[at]) < 1e-4, name


def test_many_labels_are_bounded(spark, monkeypatch):
    rows = [(k, "some words of text", f"l{k % 40:02d}" if k % 3 else "en") for k in range(600)]
    monkeypatch.setattr(K, "LANGUAGES", 5)
    assert len({lang for lang, _ in K.sample(frame(spark, rows))}) == 5


def test_what_is_near_chance_goes(spark, docs):
    model = K.train(K.sample(docs))
    assert K.reject_below(model) == 1 / 4 + 0.05
    flat = K.ByteCNN(model.langs, model.emb, model.conv, model.bias, np.zeros_like(model.out), np.zeros_like(model.out_bias))
    names, scores = K._answers(flat, ["some text"])
    assert scores[0] < K.reject_below(flat)
