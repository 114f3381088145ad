"""Load generators as streams with offsets: Spark's Python data source.

An event is a function of its number, its part and the stream's start, so the offset of a
stream is a number, and a query that is started again from its checkpoint goes on with
the event after the last, as it would have been. The start is an option that belongs to
the stream like its path to a file stream: name it again when starting again.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.shipping import ship

_SCHEMA = "part int, n bigint, key int, event_name string, src_address string, dst_address string, occur_time bigint"
_BATCH = 50_000


class Pace:
    """When event n is due, in seconds from the start: ``rate`` a second, or ``first`` events a second apart and then one every ``every`` seconds."""

    def __init__(self, rate: float = 0.0, first: int = 0, every: float = 0.0, events: int | None = None):
        if not rate and not every:
            raise ValueError("name a rate, or a time between events")
        self.rate, self.first, self.every, self.events = rate, first, every, events

    def due(self, elapsed: float) -> int:
        """How many events are due."""
        if elapsed < 0:
            return 0
        if self.rate:
            n = math.floor(elapsed * self.rate)
        else:
            n = min(self.first, math.floor(elapsed)) + max(0, math.floor((elapsed - self.first) / self.every))
        return n if self.events is None else min(n, self.events)

    def at(self, n: np.ndarray) -> np.ndarray:
        """Milliseconds from the start at which events are due."""
        if self.rate:
            return np.ceil((n + 1) * 1000 / self.rate).astype(np.int64)
        return np.where(n < self.first, (n + 1) * 1000, self.first * 1000 + (n - self.first + 1) * int(self.every * 1000)).astype(np.int64)


class _Part(InputPartition):
    def __init__(self, part: int, start: int, end: int):
        self.part, self.start, self.end = part, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.start, self.keys, self.parts = float(options["start"]), int(options.get("keys", 10)), int(options.get("parts", 1))
        self.name = options.get("name", "web attack")
        self.pace = Pace(float(options.get("rate", 0)), int(options.get("first", 0)), float(options.get("every", 0)), int(options["events"]) if "events" in options else None)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        return {"n": self.pace.due(time.time() - self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(p, start["n"], end["n"]) for p in range(self.parts)] if end["n"] > start["n"] else []

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for a in range(partition.start, partition.end, _BATCH):
            n = np.arange(a, min(partition.end, a + _BATCH))
            address = pa.array([f"172.16.100.{x}" for x in (n % 255).tolist()])
            yield pa.record_batch([pa.array(np.full(len(n), partition.part, np.int32)), pa.array(n), pa.array(((n + 1) % self.keys).astype(np.int32)), pa.array([self.name] * len(n)), address, address, pa.array(self.pace.at(n) + int(self.start * 1000))], ["part", "n", "key", "event_name", "src_address", "dst_address", "occur_time"])


class LiveEvents(DataSource):
    """Options: ``start`` (epoch seconds), ``rate`` or ``first`` and ``every``, ``events`` (at most so many a part), ``keys``, ``parts``, ``name``."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_events"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _live(spark: SparkSession, start: float | None, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(LiveEvents)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.readStream.format("tidewatch_events").options(start=repr(time.time() if start is None else start), **given).load()


def key_range_stream(spark: SparkSession, rate: float, keys: int = 10, parallelism: int = 1, events: int | None = None, start: float | None = None, name: str = "web attack") -> DataFrame:
    """Events of ``parallelism`` parts, each ``rate`` a second from ``start`` on (now, if not given), keys in turn, ``events`` a part at most."""
    return _live(spark, start, rate=rate, keys=keys, parts=parallelism, events=events, name=name)


def periodic_stream(spark: SparkSession, first: int = 5, every: float = 10.0, keys: int = 10, events: int | None = None, start: float | None = None, name: str = "web attack") -> DataFrame:
    """``first`` events a second apart, then one every ``every`` seconds."""
    return _live(spark, start, first=first, every=every, keys=keys, events=events, name=name)
