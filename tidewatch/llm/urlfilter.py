"""URL rules decided by Bloom filter cascades.

A rule names a host and a path; it fits the host, its subdomains and every path that
starts with its own. A URL can only be fitted by a rule of the same shape (labels of
the host, characters of the path), so it has one candidate key for each shape among
the rules: the end of its host and the start of its path. All candidate keys of the
table are the universe.

A list of rules (one for each verdict) becomes a cascade: the first Bloom filter
holds the listed keys, the second the keys of the universe that the first lets
through by mistake, the third the listed keys that the second lets through, and so
on until nobody is mistaken. For keys of that universe the answer is exact, and it
takes no join: the filters are constants in the plan. The first filter is sized by
the estimated number of distinct keys, so that it is mistaken about as many keys as
are listed; if it is mistaken about more than a fixed multiple, it is built again
with more bits. What the driver sees is bounded by the rules, not by the table.

Defined results: null URLs and URLs without ``://`` have an empty host and path and
fit no rule. Of fitting rules the longest counts (host and path together, then the
greater text). Without a fitting rule, ``rule`` is null and the verdict ``allow``.
Rows are neither dropped nor merged; null and repeated ids pass through.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.runtime import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__tw_url, instr(__tw_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"\A[^/?#]*", ""), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> list[Column]:
    """For each shape of rule the key that would fit, or null."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    return [F.when((host != "") & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n))) for labels, n in shapes]


class Level(NamedTuple):
    """One Bloom filter: its words of 64 bits, its size and its number of hashes."""

    words: list[int]
    bits: int
    hashes: int


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    low = F.lit(0x7FFFFFFF)
    first = F.xxhash64(key, F.lit(2 * level)).bitwiseAND(low)
    step = F.xxhash64(key, F.lit(2 * level + 1)).bitwiseAND(low)
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def _holds(key: Column, level: int, f: Level) -> Column:
    # one literal for the whole filter, however many words it has
    words = F.lit(np.array(f.words, np.int64))
    test = F.lit(True)
    for p in _positions(key, level, f.bits, f.hashes):
        test = test & (F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return test


def contains(key: Column, cascade: Sequence[Level]) -> Column:
    """Exact membership, for keys of the universe that the cascade was built over."""
    out = F.lit(len(cascade) % 2 == 1)
    for k in reversed(range(len(cascade))):
        out = F.when(_holds(key, k, cascade[k]), out).otherwise(F.lit(k % 2 == 1))
    return F.coalesce(out, F.lit(False))


def _local(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _filter(spark: SparkSession, keys: Sequence[str], level: int, hashes: int) -> Level:
    bits = max(64, math.ceil(len(keys) * hashes / math.log(2)))
    pos = _local(spark, keys).select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    # at most one row for each hash of each key given
    words = pos.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).collect()
    out = [0] * -(-bits // 64)
    for r in words:
        out[r["w"]] = r["v"]
    return Level(out, bits, hashes)


def _through(spark: SparkSession, keys: Sequence[str], level: int, f: Level) -> list[str]:
    """The keys that a filter holds."""
    return [r["key"] for r in _local(spark, keys).where(_holds(F.col("key"), level, f)).collect()] if keys else []


def build_cascade(universe: DataFrame, listed: Sequence[str], size: int) -> list[Level]:
    """A cascade that tells ``listed`` from all other values of ``universe.key``; ``size`` is about their number."""
    listed = sorted(set(listed))
    if not listed:
        return []
    spark = universe.sparkSession
    bound = 16 * len(listed) + 1024
    hashes = max(1, math.ceil(math.log2(max(2.0, size / len(listed)))))
    while True:
        first = _filter(spark, listed, 0, hashes)
        mistaken = [r["key"] for r in universe.where(_holds(F.col("key"), 0, first) & ~F.array_contains(F.lit(list(listed)), F.col("key"))).distinct().limit(bound + 1).collect()]
        if len(mistaken) <= bound:
            break
        hashes += 4
    levels, held, others = [first], mistaken, listed
    while held:
        k = len(levels)
        levels.append(_filter(spark, held, k, 1 if k % 2 else 2))
        held, others = _through(spark, others, k, levels[-1]), held
    return levels


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("__tw_url"))
    host, path = host_and_path(F.col("__tw_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = rows.select(F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    verdicts = sorted({r.verdict for r in rules})
    cascades = {v: build_cascade(universe, [r.key for r in rules if r.verdict == v], size) for v in verdicts}
    fits = []
    for key in keys:
        verdict = F.lit(None).cast("string")
        for v in verdicts:
            verdict = F.when(contains(key, cascades[v]), F.lit(v)).otherwise(verdict)
        fits.append(F.when(verdict.isNotNull(), F.struct(F.length(key).alias("n"), key.alias("rule"), verdict.alias("verdict"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None)
    return rows.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP7_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r(verdict, rhost, rpath) AS (
  VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}
), fit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f ON p.page_id = f.page_id AND f.n = 1
"""
