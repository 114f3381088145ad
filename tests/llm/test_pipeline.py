"""The pipeline against its stages done plainly, and its queries against their SQL."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.helpers import frame
from tests.llm.test_near_duplicates import components, plain
from tidewatch.llm import packing, pii
from tidewatch.llm.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("extra", F.lit(1))
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "simhash_neardup", "pii", "packing"]
    kept = C.identify_language(spark, docs, DIR)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    unique = C.drop_near_duplicates(spark, kept, DIR)
    rows = {r.doc_id: r.text for r in kept.collect()}
    roots = components([plain(t) for t in rows.values()], 2)
    first = {}
    for i in sorted(rows):
        first.setdefault(roots[plain(rows[i])], i)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(first.values())
    clean = C.redact_personal_data(spark, unique, DIR)
    w = pii.weights()
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {i: pii.redact(rows[i], pii.find(rows[i], w)[1]) for i in first.values()}
    packed = C.pack_sequences(spark, clean, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(first.values())


def test_run(spark):
    got = C.run(spark, DIR)
    assert got.columns == packing.pack(frame(spark), packing.tokenizer_path(), with_ids=True).columns
    rows = got.collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert C.ORACLE_SQL is None


def test_stages_take_awkward_documents(spark):
    docs = frame(spark)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert C.pack_sequences(spark, docs, DIR).count() > 0
    none = frame(spark, [])
    for _, stage in C.STAGES:
        assert stage(spark, none, DIR).isEmpty()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    df, sql = QUERIES[name](spark, DIR), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in sql.fetchall())
