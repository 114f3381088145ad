"""Sequences of events: FOLLOWED BY, NOT FOLLOWED BY, NOT BEFORE, REPEAT UNTIL.

Order is event time, then the tie columns. A match is valid if its last event comes
less than ``within`` after its first.

A rule with a time limit looks no further than that limit, so the rows of a key are cut
into stretches of time and those near a border are copied to the neighbouring stretch
as context. A window then runs over (key, stretch): a key that holds a third of all
events is shared by many tasks. Rules without a limit run over the whole key.

Rules that relate fields of A and B are re-keyed: A rows by their field, B rows by
theirs, so that no rule needs all events in one task. An event that can be both A and B
comes before itself as B, so it never follows itself.

NOT BEFORE looks back without a limit. What a stretch needs of those before it is the
last A alone, so one A of each stretch is carried on to the next ones of its group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewatch.functions.scalars import group_signature, total
from tidewatch.operators.windows import millis
from tidewatch.shipping import ship

#: Length of a stretch in multiples of the time limit; about 1 / STRETCH of the rows are copied.
STRETCH = 4
#: NOT BEFORE without groups has so many stretches in a time limit.
NARROW = 16


def roles(rows: DataFrame, keys: Sequence[str], relation: Sequence[tuple[str, str]], ignore_case: bool = True, lonely: bool = False) -> DataFrame:
    """Each event once for each part that it can play, A (``__tw_a``) or B (``__tw_b``), with the key ``__tw_k`` it has in that part; without a value it relates to nothing and goes, unless it is an A and ``lonely``."""
    text = lambda c: F.lower(F.col(c).cast("string")) if ignore_case else F.col(c).cast("string")

    def part(at: int, flag: str) -> Column:
        related = [text(r[at]).alias(f"r{k}") for k, r in enumerate(relation)]
        there = F.col(flag)
        if at or not lonely:
            for r in relation:
                there = there & F.col(r[at]).isNotNull()
        return F.when(there, F.struct(F.lit(at == 0).alias("a"), F.lit(at == 1).alias("b"), F.struct(*keys, *related).alias("k")))

    rows = rows.withColumn("__tw_r", F.explode(F.array_compact(F.array(part(0, "__tw_a"), part(1, "__tw_b")))))
    return rows.withColumns({f"__tw_{c}": F.col(f"__tw_r.{c}") for c in "abk"}).drop("__tw_r")


def _stretch(t: Column, width: int) -> Column:
    return F.call_function("div", t - F.pmod(t, F.lit(width)), F.lit(width)).cast("bigint")


class Ordered:
    """Events with ``__tw_a``, ``__tw_b`` (the tests), ``__tw_k`` (the key), ``__tw_t`` (microseconds) and their stretch."""

    def __init__(self, df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None, relation: Sequence[tuple[str, str]] = (), ignore_case: bool = True, everything: bool = False):
        self.carry = df.columns
        self.within = None if within is None else millis(within) * 1000
        self.tie = list(tie)
        # the bare tests, as files can filter by them
        some = df.where(F.col(ts).isNotNull() if everything else F.col(ts).isNotNull() & (a | b))
        rows = some.withColumn("__tw_a", total(a)).withColumn("__tw_b", total(b)).withColumn("__tw_t", F.unix_micros(F.col(ts).cast("timestamp")))
        if relation:
            rows = roles(rows, keys, relation, ignore_case)
        else:
            rows = rows.withColumn("__tw_k", F.struct(*keys) if keys else F.lit(0))
        self.rows = rows

    def stretched(self, back: bool) -> DataFrame:
        """Rows with ``__tw_s``, their stretch, and ``__tw_own``: whether it is their own or they are context there.

        ``back``: stretches need the rows before them, else those after them.
        """
        if self.within is None:
            return self.rows.withColumn("__tw_s", F.lit(0)).withColumn("__tw_own", F.lit(True))
        width = self.within * STRETCH
        own = _stretch(F.col("__tw_t"), width)
        inside = F.pmod("__tw_t", F.lit(width))
        near = inside >= width - self.within if back else inside < self.within
        other = own + 1 if back else own - 1
        both = F.when(near, F.array(F.struct(own.alias("s"), F.lit(True).alias("o")), F.struct(other.alias("s"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(own.alias("s"), F.lit(True).alias("o"))))
        return self.rows.withColumn("__tw_x", F.explode(both)).withColumn("__tw_s", F.col("__tw_x.s")).withColumn("__tw_own", F.col("__tw_x.o")).drop("__tw_x")

    def over(self) -> WindowSpec:
        return Window.partitionBy("__tw_k", "__tw_s").orderBy("__tw_t", *self.tie, F.col("__tw_b").desc())

    def back(self) -> WindowSpec:
        """From the last row to the first: a frame that grows with every row costs its number of rows, where one that shrinks is gone through anew for each."""
        return Window.partitionBy("__tw_k", "__tw_s").orderBy(*[F.col(c).desc() for c in ("__tw_t", *self.tie)], "__tw_b")

    def upcoming(self, c: Column, itself: bool = False) -> Column:
        """The next value of ``c`` that isn't null, after the row or (``itself``) from it on."""
        return F.last(c, ignorenulls=True).over(self.back().rowsBetween(Window.unboundedPreceding, Window.currentRow if itself else -1))

    def event(self) -> Column:
        return F.struct("__tw_t", *self.carry)

    def valid(self, first: Column, last: Column) -> Column:
        return F.lit(True) if self.within is None else last - first < self.within


def _flat(df: DataFrame, carry: Sequence[str], *events: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in events for c in carry], *extra)


def followed_by(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None = None, skip: str = "next", contiguity: str = "relaxed", relation: Sequence[tuple[str, str]] = (), ignore_case: bool = True) -> DataFrame:
    """A then B: columns ``a_…`` and ``b_…`` of both events.

    relaxed, ``skip="next"``: each A with the first B after it. relaxed, ``skip="past_last"``: after a match nothing
    before its end is used again, so each B with the earliest A since the B before. strict: A and B are neighbours
    among all events of the key.
    """
    if contiguity == "strict":
        o = Ordered(df, a, b, keys, ts, tie, within, relation, ignore_case, everything=not relation)
        rows = o.stretched(back=False)
        got = rows.withColumn("b", F.lead(F.when(F.col("__tw_b"), o.event())).over(o.over()))
        return _flat(got.where("__tw_own AND __tw_a AND b IS NOT NULL").withColumn("a", o.event()).where(o.valid(F.col("a.__tw_t"), F.col("b.__tw_t"))), o.carry, "a", "b")
    o = Ordered(df, a, b, keys, ts, tie, within, relation, ignore_case)
    if skip == "next":
        got = o.stretched(back=False).withColumn("b", o.upcoming(F.when(F.col("__tw_b"), o.event())))
        return _flat(got.where("__tw_own AND __tw_a AND b IS NOT NULL").withColumn("a", o.event()).where(o.valid(F.col("a.__tw_t"), F.col("b.__tw_t"))), o.carry, "a", "b")
    if skip != "past_last":
        raise ValueError("skip is next or past_last")
    runs = _runs(o)
    earliest = F.min(F.when(F.col("__tw_a") & o.valid(F.col("__tw_t"), F.col("__tw_bt")), F.struct("__tw_t", *o.tie, F.struct(*o.carry).alias("e"))))
    found = runs.groupBy("__tw_k", "__tw_s", "__tw_run").agg(earliest.alias("first"), F.max(F.when(F.col("__tw_end") & F.col("__tw_own"), F.struct(*o.carry))).alias("b"))
    return _flat(found.where("first IS NOT NULL AND b IS NOT NULL").withColumn("a", F.col("first.e")), o.carry, "a", "b")


def non_overlapping(found: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """Of matches of neighbours that share an event, every other one: after a match the search goes on past its end."""
    order = Window.partitionBy(*[f"a_{k}" for k in keys]).orderBy(f"a_{ts}", *[f"a_{c}" for c in tie])
    names = [ts, *tie]
    chained = total(F.lag(F.struct(*[F.col(f"b_{c}").alias(c) for c in names])).over(order) == F.struct(*[F.col(f"a_{c}").alias(c) for c in names]))
    rows = found.withColumn("__tw_new", (~chained).cast("bigint")).withColumn("__tw_i", F.sum("__tw_new").over(order))
    rows = rows.withColumn("__tw_n", F.row_number().over(Window.partitionBy(*[f"a_{k}" for k in keys], "__tw_i").orderBy(f"a_{ts}", *[f"a_{c}" for c in tie])))
    return rows.where("__tw_n % 2 = 1").select(*found.columns)


def _disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep a match only if it begins after the last one kept of its key ends; rows come sorted by key and begin."""
    now, last = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (key, begin, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if key != now or tuple(begin.values()) > last:
                keep[i], now, last = True, key, tuple(end.values())
        yield batch.filter(pa.array(keep))


def apart(found: DataFrame, key: str, begin: Column, end: Column) -> DataFrame:
    """Of matches of a key that overlap, the first, then the first that begins after its end, and so on; ``begin`` and ``end`` are structs that order."""
    ship(found.sparkSession)
    rows = found.select(F.to_json(F.struct(key)).alias("__tw_key"), begin.alias("__tw_begin"), end.alias("__tw_end"), *found.columns)
    dealt = rows.repartition("__tw_key").sortWithinPartitions("__tw_key", "__tw_begin")
    return dealt.mapInArrow(_disjoint, rows.schema).select(*found.columns)


def _runs(o: Ordered, greedy: bool = False) -> DataFrame:
    """Rows with ``__tw_run``, the number of B's before, ``__tw_end`` (the B that ends the run) and its time ``__tw_bt``; an A that is also a B ends the run before it, or (``greedy``) is an A alone."""
    rows = o.stretched(back=True)
    if greedy:
        rows = rows.withColumn("__tw_b", F.col("__tw_b") & ~F.col("__tw_a"))
    before = o.over().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__tw_run", F.coalesce(F.sum(F.col("__tw_b").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("__tw_bt", o.upcoming(F.when(F.col("__tw_b"), F.col("__tw_t")), itself=True))
    rows = rows.where(F.col("__tw_bt").isNotNull()).withColumn("__tw_end", F.col("__tw_b"))
    both = F.col("__tw_a") & F.col("__tw_b")
    # an event can't follow itself: as the end of a run it isn't its first
    return rows.withColumn("__tw_a", F.col("__tw_a") & ~both)


def repeated_then(df: DataFrame, a: Column, b: Column, n: int, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None = None, contiguity: str = "relaxed", relation: Sequence[tuple[str, str]] = (), greedy: bool = True, last: bool = False) -> DataFrame:
    """A at least n times, then B: the first A, the B and the number of A's; ``last`` adds the last A, as columns ``l_…``.

    relaxed: the A's since the B before that lie within the limit. strict: a run of neighbouring A's directly before
    the B, as long as the limit allows. greedy: an event that is both A and B goes on with the A's.
    """
    strict = contiguity == "strict"
    o = Ordered(df, a, b, keys, ts, tie, within, relation, everything=strict and not relation)
    if strict:
        rows = o.stretched(back=True)
        w = o.over()
        # rows that are no A end a run of A's; the run's next row decides
        other = F.sum((~F.col("__tw_a")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("__tw_run", F.coalesce(other, F.lit(0))).withColumn("__tw_end", F.col("__tw_b") & ~F.col("__tw_a"))
        ends = o.upcoming(F.when(~F.col("__tw_a"), F.struct(F.col("__tw_b").alias("b"), F.col("__tw_t").alias("t"))), itself=True)
        rows = rows.withColumn("__tw_x", ends).where("__tw_x.b").withColumn("__tw_bt", F.col("__tw_x.t"))
    else:
        rows = _runs(o, greedy)
    usable = F.col("__tw_a") & o.valid(F.col("__tw_t"), F.col("__tw_bt"))
    earliest = F.min(F.when(usable, F.struct("__tw_t", *o.tie, F.struct(*o.carry).alias("e"))))
    latest = [F.max(F.when(usable, F.struct("__tw_t", *o.tie, F.struct(*o.carry).alias("e")))).alias("last")] if last else []
    found = rows.groupBy("__tw_k", "__tw_s", "__tw_run").agg(earliest.alias("first"), *latest, F.max(F.when(F.col("__tw_end") & F.col("__tw_own"), F.struct(*o.carry))).alias("b"), F.count(F.when(usable, 1)).alias("times"))
    found = found.where((F.col("times") >= n) & F.col("b").isNotNull()).withColumn("a", F.col("first.e"))
    return _flat(found.withColumn("l", F.col("last.e")) if last else found, o.carry, "a", *(["l"] if last else []), "b", extra=["times"])


def not_followed_by(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int, relation: Sequence[tuple[str, str]] = (), ignore_case: bool = True) -> DataFrame:
    """Each A without a B in the time limit after it, with all its columns. An A whose related field is missing has no B."""
    o = Ordered(df, a, b, keys, ts, tie, within, relation, ignore_case)
    got = o.stretched(back=False).withColumn("__tw_next", o.upcoming(F.when(F.col("__tw_b"), F.col("__tw_t"))))
    alone = got.where(F.col("__tw_own") & F.col("__tw_a") & ~total(F.col("__tw_next") - F.col("__tw_t") < o.within)).select(*o.carry)
    if relation:
        missing = F.lit(False)
        for field, _ in relation:
            missing = missing | F.col(field).isNull()
        alone = alone.unionByName(df.where(total(a) & F.col(ts).isNotNull() & missing))
    return alone


def _thin(batches: Iterator[pa.RecordBatch], silence: int) -> Iterator[pa.RecordBatch]:
    """Keep an alert only if it comes more than ``silence`` after the last one kept of its signature; rows come sorted."""
    now, last = None, 0
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (key, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != now or t - last > silence:
                keep[i], now, last = True, key, t
        yield batch.filter(pa.array(keep))


def silenced(alerts: DataFrame, signature: Column, ts: str, tie: Sequence[str], silence: str | int) -> DataFrame:
    """Thin alerts: after one, the others of its signature are silent for ``silence``.

    After a gap longer than that an alert is always kept, so the alerts between such gaps are independent of all
    others and dealt out by the time at which they begin; a task scans them in order and remembers one time. Gaps are
    found inside stretches of time, and only one time for each stretch is carried on to the next.
    """
    ship(alerts.sparkSession)
    limit, columns = millis(silence) * 1000, alerts.columns
    width = max(1, limit) * STRETCH
    t, inside = F.col("__tw_t"), F.pmod(F.col("__tw_t"), F.lit(width))
    rows = alerts.withColumn("__tw_g", signature).withColumn("__tw_t", F.unix_micros(F.col(ts).cast("timestamp")))
    # the alerts of one silence before a border tell whether the first one after it follows a gap
    place = F.when(inside >= width - limit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("__tw_o", F.explode(place)).withColumn("__tw_s", _stretch(t, width) + F.col("__tw_o"))
    order = Window.partitionBy("__tw_g", "__tw_s").orderBy("__tw_t", *tie)
    spread = spread.withColumn("__tw_gap", F.coalesce(t - F.lag("__tw_t").over(order) > limit, F.lit(True))).where("__tw_o = 0")
    begun = F.last(F.when(F.col("__tw_gap"), t), ignorenulls=True)
    spread = spread.withColumn("__tw_i", begun.over(order))
    ends = spread.groupBy("__tw_g", "__tw_s").agg(F.max(F.when(F.col("__tw_gap"), t)).alias("__tw_i"))
    carried = F.last("__tw_i", ignorenulls=True).over(Window.partitionBy("__tw_g").orderBy("__tw_s").rowsBetween(Window.unboundedPreceding, -1))
    spread = spread.join(ends.select("__tw_g", "__tw_s", carried.alias("__tw_c")), ["__tw_g", "__tw_s"])
    rows = spread.withColumn("__tw_key", F.concat_ws("\x1f", "__tw_g", F.coalesce("__tw_i", "__tw_c"))).select("__tw_key", "__tw_t", *columns)
    dealt = rows.repartition("__tw_key").sortWithinPartitions("__tw_key", "__tw_t", *tie)
    return dealt.mapInArrow(lambda x: _thin(x, limit), rows.schema).select(*columns)


def not_before(df: DataFrame, a: Column, b: Column, ts: str, tie: Sequence[str], within: str | int, a_fields: Sequence[str] = (), b_fields: Sequence[str] = (), silence: str | int | None = None) -> DataFrame:
    """Each B without an A in the time limit before it: ``b_…``, and ``a_…`` of the last A of its group, if there was one.

    An event that satisfies both tests is an A. A's are grouped by ``a_fields``, B's by ``b_fields``; the group is
    returned as ``signature``. A gap of exactly ``within`` is still in time. Events are taken in the order of their times.
    """
    limit, keyed = millis(within) * 1000, bool(a_fields or b_fields)
    place = ["signature", "__tw_s"] if keyed else ["__tw_s"]
    # stretches need no context here, so they may be short: without groups they alone share the events out
    width = max(1, limit if keyed else limit // NARROW)
    t, event = F.col("__tw_t"), F.struct("__tw_t", *df.columns)
    rows = df.where(F.col(ts).isNotNull() & (a | b)).withColumn("__tw_a", total(a)).withColumn("__tw_t", F.unix_micros(F.col(ts).cast("timestamp")))
    sign = F.when(F.col("__tw_a"), group_signature([F.col(c) for c in a_fields])).otherwise(group_signature([F.col(c) for c in b_fields]))
    rows = rows.withColumn("signature", sign).withColumn("__tw_s", _stretch(t, width)).repartition(*place)
    before = Window.partitionBy(*place).orderBy("__tw_t", *tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("a", F.last(F.when(F.col("__tw_a"), event), ignorenulls=True).over(before))
    seen = seen.where(~F.col("__tw_a") & ~total(t - F.col("a.__tw_t") <= limit)).withColumn("b", F.struct(*df.columns))
    # of each stretch the last A alone is carried on
    latest = rows.groupBy(*place).agg(F.max(F.when(F.col("__tw_a"), F.struct("__tw_t", *tie, event.alias("e")))).alias("l"))
    carried = F.last("l.e", ignorenulls=True).over(Window.partitionBy(*place[:-1]).orderBy("__tw_s").rowsBetween(Window.unboundedPreceding, -1))
    alerts = seen.join(latest.select(*place, carried.alias("c")), place, "left").withColumn("a", F.coalesce("a", "c"))
    alerts = alerts.where(~total(t - F.col("a.__tw_t") <= limit))
    out = _flat(alerts, df.columns, "b", "a", extra=["signature"])
    return out if silence is None else silenced(out, F.col("signature"), f"b_{ts}", [f"b_{c}" for c in tie], silence)


def repeated_until(df: DataFrame, a: Column, until: Column, n: int, keys: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """A n times without an ``until`` event between: ``signature`` and the n ``events`` of each match; the next match begins after it.

    The A's between two ``until`` events are numbered and taken n at a time. An event that is both ends what was begun.
    """
    rows = df.where(F.col(ts).isNotNull()).withColumn("__tw_k", group_signature([F.col(k) for k in keys])).withColumn("__tw_t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("__tw_u", total(until)).withColumn("__tw_a", total(a) & ~F.col("__tw_u")).where("__tw_a OR __tw_u")
    order = ["__tw_t", *tie]
    rows = rows.withColumn("__tw_run", F.sum(F.col("__tw_u").cast("bigint")).over(Window.partitionBy("__tw_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where("__tw_a")
    number = F.row_number().over(Window.partitionBy("__tw_k", "__tw_run").orderBy(*order)) - 1
    rows = rows.withColumn("__tw_i", number).withColumn("__tw_c", F.call_function("div", "__tw_i", F.lit(n)))
    # a list holds n events at most
    taken = rows.groupBy("__tw_k", "__tw_run", "__tw_c").agg(F.sort_array(F.collect_list(F.struct("__tw_i", F.struct(*df.columns).alias("event")))).alias("e"))
    return taken.where(F.size("e") == n).select(F.col("__tw_k").alias("signature"), F.transform("e", lambda x: x["event"]).alias("events"))


def match_text(match: DataFrame, *events: str, alias: str = "text") -> DataFrame:
    """A match as text: for each event its name and JSON."""
    parts = []
    for e in events:
        own = [c for c in match.columns if c.startswith(f"{e}_")]
        parts.append(F.concat(F.lit(f"{e.upper()}: ["), F.to_json(F.struct(*[F.col(c).alias(c[len(e) + 1 :]) for c in own])), F.lit("] ")))
    return match.select(F.concat(*parts).alias(alias))
