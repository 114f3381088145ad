"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, contexttree, langid, lexical, packing, pii, simhash, sketches, tokenstore, topk, urlfilter, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": simhash.op1_simhash_neardup,
    "op2_harmonic_packing": packing.op2_harmonic_packing,
    "op3_lookup_sketch": sketches.op3_lookup_sketch,
    "op4_token_store": tokenstore.op4_token_store,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_sql_bpe": bpe.op6_sql_bpe,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_pii_spans": pii.op8_pii_spans,
    "op9_warc": warc.op9_warc,
    "op10_language_id": langid.op10_language_id,
    "op11_whitening": whitening.op11_whitening,
    "op12_context_tree": contexttree.op12_context_tree,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": topk.OP5_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
