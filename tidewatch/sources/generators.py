"""Load generators: event tables made from a range of numbers, nothing stored.

As in a job with that many sources, every one of ``parallelism`` parts makes ``events``
events, and keys run from 1 up, starting again at 0 after the last.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_A_EVENT = "web attack"


def key_range(spark: SparkSession, events: int, keys: int, parallelism: int = 1) -> DataFrame:
    """``n``, the number of an event in its part, and ``key``."""
    rows = spark.range(0, events * parallelism, 1, parallelism)
    return rows.select((F.col("id") % events).alias("n"), ((F.col("id") % events + 1) % keys).cast("int").alias("key"))


def tuples(spark: SparkSession, events: int, keys: int, parallelism: int = 1) -> DataFrame:
    return key_range(spark, events, keys, parallelism).select("key", F.lit(1).alias("one"))


def _address(n: Column) -> Column:
    return F.concat(F.lit("172.16.100."), (n % 255).cast("string"))


def slim_events(spark: SparkSession, events: int, keys: int, parallelism: int = 1, name: str = _A_EVENT) -> DataFrame:
    """Security events with two addresses and the time of making."""
    n = F.col("n")
    return key_range(spark, events, keys, parallelism).select("key", F.lit(name).alias("event_name"), _address(n).alias("src_address"), _address(n).alias("dst_address"), F.unix_millis(F.current_timestamp()).alias("occur_time"))


def mini_events(spark: SparkSession, events: int, keys: int, parallelism: int = 1, name: str = _A_EVENT) -> DataFrame:
    return key_range(spark, events, keys, parallelism).select("key", F.lit(name).alias("event_name"), F.col("n").alias("cnt"))


def parsed_events(spark: SparkSession, events: int, keys: int, parallelism: int = 1, name: str = _A_EVENT) -> DataFrame:
    """The slim events, each through JSON text and back: measures parsing."""
    text = slim_events(spark, events, keys, parallelism, name).select(F.to_json(F.struct("*")).alias("value"))
    return text.select(F.from_json("value", "key int, event_name string, src_address string, dst_address string, occur_time bigint").alias("e")).select("e.*")


#: Text fields of a wide security event (fixed names).
WIDE_TEXT = "nta app_protocol threat_rule_id collector_source threat_feature sensor_id rule_id threat_info response event_digest src_mac event_type in_iface rule_name unit log_type dev_address original_type vendor data_source dst_mac original_info protocol in_iface_2".split()
WIDE_LONG = "receive_time end_time first_time flow_id".split()
WIDE_INT = "event_level src_port dst_port tran_protocol tx_id".split()


def wide_events(spark: SparkSession, events: int, keys: int, parallelism: int = 1, name: str = _A_EVENT) -> DataFrame:
    """Security events with 38 fields."""
    n = F.col("n")
    more = [F.concat(F.lit(f"{c}-"), (n % 16).cast("string")).alias(c) for c in WIDE_TEXT] + [(n * 7 + k).alias(c) for k, c in enumerate(WIDE_LONG)] + [(n % 65536).cast("int").alias(c) for c in WIDE_INT]
    return key_range(spark, events, keys, parallelism).select("key", F.lit(name).alias("event_name"), n.cast("string").alias("id"), _address(n).alias("src_address"), _address(n).alias("dst_address"), F.unix_millis(F.current_timestamp()).alias("occur_time"), *more)


def ticking(spark: SparkSession, per_second: int = 1, keys: int = 10, name: str = _A_EVENT) -> DataFrame:
    """An endless stream of slim events."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    n = F.col("value")
    return rate.select(((n + 1) % keys).cast("int").alias("key"), F.lit(name).alias("event_name"), _address(n).alias("src_address"), _address(n).alias("dst_address"), F.unix_millis("timestamp").alias("occur_time"))


def scripted(spark: SparkSession, script: list, schema: str, per_second: int = 1) -> DataFrame:
    """An endless stream that plays the rows of ``script`` over and over: their columns, ``number`` (counted on) and ``ts``, the time of each."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    kind = T._parse_datatype_string(schema)
    rows = F.array(*[F.from_json(F.lit(json.dumps(dict(zip(kind.names, r, strict=True)))), kind) for r in script])
    return rate.withColumn("x", F.element_at(rows, (F.col("value") % len(script) + 1).cast("int"))).select("x.*", F.col("value").alias("number"), F.col("timestamp").alias("ts"))
