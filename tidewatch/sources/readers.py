"""Event sources. Kafka needs Spark's Kafka connector on the class path; files need nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Bound of lateness that all rules share.
LATENESS = "3 seconds"


def parse_json(df: DataFrame, column: str, schema: T.StructType | str, keep_raw: bool = True) -> DataFrame:
    """Declared fields of JSON text as columns, missing ones null; ``raw`` keeps the text for undeclared fields."""
    out = df.withColumn("__tw_j", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))
    return out.select("__tw_j.*", *([F.col(column).alias("raw")] if keep_raw else []))


def unwrap(df: DataFrame, schema: T.StructType | str, column: str = "value", keep_raw: bool = True) -> DataFrame:
    """Events in an envelope ``{"key": …, "value": {…}}``."""
    inner = df.select(F.get_json_object(F.col(column).cast("string"), "$.value").alias("__tw_v"))
    return parse_json(inner, "__tw_v", schema, keep_raw)


def kafka(spark: SparkSession, servers: str, topic: str | None = None, topics: str | None = None, group: str | None = None, start: str = "earliest", stream: bool = True, **options: str) -> DataFrame:
    """Records of a topic, or of all ``topics`` that match a pattern; ``key`` and ``value`` as text, and the record's time."""
    if (topic is None) == (topics is None):
        raise ValueError("name a topic or a pattern of topics")
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", start)
    reader = reader.option("subscribe", topic) if topic else reader.option("subscribePattern", topics)
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp")


def files(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "json", files_a_batch: int | None = None, stream: bool = True) -> DataFrame:
    """Events from the files of a folder, new ones as they come."""
    reader = (spark.readStream if stream else spark.read).format(form).schema(schema)
    if stream and files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.load(path)


def literals(spark: SparkSession, values: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([v if isinstance(v, (tuple, list, dict)) else (v,) for v in values], schema)


def with_event_time(df: DataFrame, column: str, into: str = "ts", form: str | None = None, lateness: str | None = LATENESS) -> DataFrame:
    """``into`` from epoch milliseconds or, with ``form``, from text; a missing time is the time of processing. Streams get their watermark."""
    c = F.col(column)
    kind = df.schema[column].dataType
    if form:
        c = F.try_to_timestamp(c, F.lit(form))
    elif not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.timestamp_millis(c.cast("bigint"))
    out = df.withColumn(into, F.coalesce(c.cast("timestamp"), F.current_timestamp()))
    return out.withWatermark(into, lateness) if df.isStreaming and lateness else out


def with_processing_time(df: DataFrame, into: str = "ts", lateness: str | None = "0 seconds") -> DataFrame:
    """``into`` is the time at which a row is read, for windows of processing time."""
    out = df.withColumn(into, F.current_timestamp())
    return out.withWatermark(into, lateness) if df.isStreaming and lateness else out


class _Tap(StreamingQueryListener):
    def __init__(self, tell: Callable[[dict], object]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "watermark": (p.eventTime or {}).get("watermark")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def tapped(spark: SparkSession, tell: Callable[[dict], object] = print) -> Iterator[None]:
    """While it lasts, ``tell`` gets the record counts and the watermark of every micro-batch of the session's streams."""
    tap = _Tap(tell)
    spark.streams.addListener(tap)
    try:
        yield
    finally:
        spark.streams.removeListener(tap)


def intel_table(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A group table: ``group_id, name, type, intelligence_type, content``. Read again, it shows the newest files."""
    return spark.read.format(form).schema("group_id string, name string, type string, intelligence_type string, content string").load(path)
