"""HAVING ANY, COUNT, COUNT DISTINCT and SUM, and session counts.

Hopping windows are worked out in panes: events are first aggregated into tumbling
panes of one slide, and only the panes are expanded into the windows that cover them,
so an event is never copied once for every window. Where size isn't a multiple of the
slide, Spark's own ``window`` is used. Streams do the same in append mode if asked to
(``live_panes``): two aggregations one after the other, whose state has a row for each pane and
one for each open window, and no more. All results have the window's bounds as plain
columns and the keys as text, a missing key as the text ``None``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import as_number, key_text

_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def millis(interval: str | int) -> int:
    """Milliseconds of ``'10 seconds'``-like text or of a number of them."""
    if isinstance(interval, int):
        return interval
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", interval.lower())
    if not m or m[2] not in _UNITS:
        raise ValueError(f"{interval!r} is no interval")
    return int(m[1]) * _UNITS[m[2]]


def _keys(keys: Sequence[str]) -> list[Column]:
    return [key_text(F.col(k)).alias(k) for k in keys]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def panes(df: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, first: Sequence[Column], then: Sequence[Column]) -> DataFrame:
    """``first`` aggregated over panes, ``then`` over the windows of panes. Without keys there is one group."""
    width, step = millis(size) * 1000, millis(slide) * 1000
    at = _micros(F.col(ts))
    at = df.where(F.col(ts).isNotNull()).select(*_keys(keys), (at - F.pmod(at, F.lit(step))).alias("__tw_pane"), *[c for c in df.columns if c not in keys])
    inner = at.groupBy(*keys, "__tw_pane").agg(*first)
    starts = F.transform(F.sequence(F.lit(0), F.lit(width // step - 1)), lambda k: F.col("__tw_pane") - k * F.lit(step))
    spread = inner.withColumn("__tw_start", F.explode(starts)).groupBy(*keys, "__tw_start").agg(*then)
    return spread.select(*keys, F.timestamp_micros("__tw_start").alias("window_start"), F.timestamp_micros(F.col("__tw_start") + width).alias("window_end"), *[c for c in spread.columns if c not in (*keys, "__tw_start")])


def _windowed(df: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str | None, agg: Column) -> DataFrame:
    """One-step aggregation over Spark's windows; also what streams use."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    out = df.groupBy(w.alias("__tw_w"), *_keys(keys)).agg(agg)
    return out.select(*keys, F.col("__tw_w.start").cast("timestamp").alias("window_start"), F.col("__tw_w.end").cast("timestamp").alias("window_end"), *[c for c in out.columns if c not in (*keys, "__tw_w")])


def _in_live_panes(df: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, first: Column, then: Column) -> DataFrame:
    """``first`` over the panes of a stream, ``then`` over the windows of closed panes."""
    pane = df.groupBy(F.window(F.col(ts), slide).alias("__tw_p"), *_keys(keys)).agg(first)
    out = pane.groupBy(F.window("__tw_p", size, slide).alias("__tw_w"), *keys).agg(then)
    return out.select(*keys, F.col("__tw_w.start").cast("timestamp").alias("window_start"), F.col("__tw_w.end").cast("timestamp").alias("window_end"), *[c for c in out.columns if c not in (*keys, "__tw_w")])


def _covers(size: str, slide: str | None) -> bool:
    return slide is not None and millis(size) % millis(slide) == 0 and millis(size) > millis(slide)


def _in_panes(df: DataFrame, size: str, slide: str | None) -> bool:
    return not df.isStreaming and _covers(size, slide)


def _at_least(df: DataFrame, value: str, least: float | None, strict: bool) -> DataFrame:
    return df if least is None else df.where(F.col(value) > least if strict else F.col(value) >= least)


def having_any(df: DataFrame, test: Column) -> DataFrame:
    """Each event that satisfies the test."""
    return df.where(test)


def having_count(df: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str | None = None, least: int | None = None, strict: bool = False, value: str = "cnt", live_panes: bool = False) -> DataFrame:
    """Events for each key and window; ``least`` is a threshold, met or (``strict``) exceeded."""
    if live_panes and df.isStreaming and _covers(size, slide):
        out = _in_live_panes(df, keys, ts, size, slide, F.count("*").alias("__tw_n"), F.sum("__tw_n").cast("bigint").alias(value))
    elif _in_panes(df, size, slide):
        out = panes(df, keys, ts, size, slide, [F.count("*").alias("__tw_n")], [F.sum("__tw_n").cast("bigint").alias(value)])
    else:
        out = _windowed(df, keys, ts, size, slide, F.count("*").alias(value))
    return _at_least(out, value, least, strict)


def having_sum(df: DataFrame, keys: Sequence[str], ts: str, field: str, size: str, slide: str | None = None, least: float | None = None, strict: bool = True, value: str = "total", live_panes: bool = False) -> DataFrame:
    """Sum of a field, numeric text included, missing values as 0."""
    number = F.coalesce(as_number(F.col(field)), F.lit(0.0))
    if live_panes and df.isStreaming and _covers(size, slide):
        out = _in_live_panes(df, keys, ts, size, slide, F.sum(number).alias("__tw_s"), F.sum("__tw_s").alias(value))
    elif _in_panes(df, size, slide):
        out = panes(df.withColumn("__tw_v", number), keys, ts, size, slide, [F.sum("__tw_v").alias("__tw_s")], [F.sum("__tw_s").alias(value)])
    else:
        out = _windowed(df, keys, ts, size, slide, F.sum(number).alias(value))
    return _at_least(out, value, least, strict)


def _distinct_in_stream(df: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str | None, text: Column, value: str) -> DataFrame:
    """Each value of a key and window is kept once, as a small row of state of its own, and counted; both go when the watermark has passed the window."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    once = df.select(w.alias("__tw_w"), *_keys(keys), text.alias("__tw_v")).dropDuplicates(["__tw_w", *keys, "__tw_v"])
    out = once.groupBy("__tw_w", *keys).agg(F.count("*").alias(value))
    return out.select(*keys, F.col("__tw_w.start").cast("timestamp").alias("window_start"), F.col("__tw_w.end").cast("timestamp").alias("window_end"), value)


def having_count_distinct(df: DataFrame, keys: Sequence[str], ts: str, field: str, size: str, slide: str | None = None, least: int | None = None, value: str = "cnt", approximate: bool = False) -> DataFrame:
    """Exact number of different values; a missing one counts as the text ``None``. Streams may ask for an approximation instead of a state with all values."""
    text = key_text(F.col(field))
    if approximate:
        out = _windowed(df, keys, ts, size, slide, F.approx_count_distinct(text).alias(value))
    elif df.isStreaming:
        out = _distinct_in_stream(df, keys, ts, size, slide, text, value)
    elif _in_panes(df, size, slide):
        # distinct values of each pane, then of each window, then their number: no set is gathered
        seen = panes(df.withColumn("__tw_v", text), [*keys, "__tw_v"], ts, size, slide, [F.count("*").alias("__tw_n")], [F.count("*").alias("__tw_n")])
        out = seen.groupBy(*keys, "window_start", "window_end").agg(F.count("*").alias(value))
    else:
        out = _windowed(df, keys, ts, size, slide, F.count_distinct(text).alias(value))
    return _at_least(out, value, least, False)


def session_count(df: DataFrame, keys: Sequence[str], ts: str, gap: str, least: int | None = None, value: str = "cnt") -> DataFrame:
    """Events for each key and session; events exactly one gap apart are one session."""
    # Spark's sessions end one gap after their last event and merge at that instant too
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    out = df.groupBy(w.alias("__tw_w"), *_keys(keys)).agg(F.count("*").alias(value))
    out = out.select(*keys, F.col("__tw_w.start").alias("window_start"), F.col("__tw_w.end").alias("window_end"), value)
    return _at_least(out, value, least, False)
