"""General patterns: loops, ``until`` and conditions on earlier events of the match.

For what window expressions can't say. The stages' tests are evaluated by Spark; the
automaton only reads the flags. Where a pattern has finitely many situations (no time
limit, no conditions on earlier events, skipping past the last event), it runs over parts
of equal size, see ``composed``. Else events are dealt by key and sorted, and a task scans
them in order, so it remembers open matches and never a whole key.

An event opens a match if it passes the first stage. An open match takes each later
event that its stage wants: a loop with its least number is left for the next stage by an
event that this one wants, unless the loop wants it too and is greedy. A loop in last place completes at its least number.
``until`` ends a loop: in last place the open match is discarded, elsewhere the loop
takes no more. Strict contiguity discards a match at the first event that it can't use.
A match whose first event is ``within`` ago or longer is discarded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalars import group_signature, total
from tidewatch.operators.windows import millis
from tidewatch.shipping import ship

Event = dict
#: Gets the event and the events taken so far, by stage.
Iterative = Callable[[Event, dict[str, list[Event]]], bool]


@dataclass(frozen=True)
class Stage:
    name: str
    test: Column
    low: int = 1
    high: int | None = 1
    until: Column | None = None
    also: Iterative | None = None
    greedy: bool = True

    @property
    def loops(self) -> bool:
        return self.high != 1


@dataclass
class _Open:
    start: int
    stage: int
    taken: dict[str, list[Event]]
    closed: bool = False


class Automaton:
    """Matches of one key, event by event. ``stages``: (name, low, high, iterative condition, greedy)."""

    def __init__(self, stages: Sequence[tuple[str, int, int | None, Iterative | None, bool]], within: int | None, strict: bool, past_last: bool):
        self.stages, self.within, self.strict, self.past_last = stages, within, strict, past_last
        self.open: list[_Open] = []
        # A, then the next B: open matches need no look until a B comes, which ends them all
        self.plain = len(stages) == 2 and not strict and not past_last and all(high == 1 and also is None for _, _, high, also, _ in stages)

    def _wants(self, m: _Open, k: int, event: Event, flags: Sequence[bool]) -> bool:
        also = self.stages[k][3]
        return flags[k] and (also is None or also(event, m.taken))

    def _take(self, m: _Open, k: int, event: Event) -> bool:
        """Add the event; true if the match is complete."""
        name, low, _, _, _ = self.stages[k]
        m.stage = k
        m.taken.setdefault(name, []).append(event)
        return k == len(self.stages) - 1 and len(m.taken[name]) >= low

    def step(self, time: int, event: Event, flags: Sequence[bool], until: Sequence[bool]) -> list[dict[str, list[Event]]]:
        """The matches that this event completes, the earliest first."""
        if self.plain:
            done = []
            if flags[1]:
                done, self.open = [m for m in self.open if self.within is None or time - m.start < self.within], []
                for m in done:
                    self._take(m, 1, event)
            if flags[0] and not until[0]:
                # those out of time go once they are half of all
                if self.within is not None and self.open and time - self.open[len(self.open) // 2].start >= self.within:
                    self.open = [m for m in self.open if time - m.start < self.within]
                self.open.append(fresh := _Open(time, 0, {}))
                self._take(fresh, 0, event)
            return [m.taken for m in done]
        done, left = [], []
        for m in self.open:
            if self.within is not None and time - m.start >= self.within:
                continue
            name, low, high, _, greedy = self.stages[m.stage]
            have, last = len(m.taken[name]), m.stage == len(self.stages) - 1
            if until[m.stage] and (high is None or high > 1):
                if last or have < low:
                    continue
                m.closed = True
            goes_on = have >= low and not last and self._wants(m, m.stage + 1, event, flags)
            stays = (high is None or have < high) and not m.closed and self._wants(m, m.stage, event, flags)
            if goes_on and not (stays and greedy):
                finished = self._take(m, m.stage + 1, event)
            elif stays:
                finished = self._take(m, m.stage, event)
            else:
                if not self.strict:
                    left.append(m)
                continue
            (done if finished else left).append(m)
        if done and self.past_last:
            self.open = []
            return [done[0].taken]
        self.open = left
        fresh = _Open(time, 0, {})
        if self._wants(fresh, 0, event, flags) and not until[0]:
            if self._take(fresh, 0, event):
                done.append(fresh)
            # with loops and skipping past the last event, later starts add nothing to an open loop
            elif not (self.past_last and self.stages[0][2] != 1 and any(m.stage == 0 for m in self.open)):
                self.open.append(fresh)
        return [m.taken for m in done]


def _scan(batches: Iterator[pa.RecordBatch], stages, within, strict, past_last, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, machine, found = None, None, []
    n = len(stages)
    for b in batches:
        cols = b.to_pydict()
        names = [c for c in cols if not c.startswith("__tw_")]
        for i in range(b.num_rows):
            key = cols["__tw_k"][i]
            if machine is None or key != now:
                now, machine = key, Automaton(stages, within, strict, past_last)
            event = {c: cols[c][i] for c in names}
            flags, until = [cols[f"__tw_f{k}"][i] for k in range(n)], [cols[f"__tw_u{k}"][i] for k in range(n)]
            found += [{"signature": key, "events": [{"stage": s, "event": e} for s, es in m.items() for e in es]} for m in machine.step(cols["__tw_t"][i], event, flags, until)]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)
            found = []


def match_pattern(df: DataFrame, stages: Sequence[Stage], keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None = None, contiguity: str = "relaxed", skip: str = "past_last") -> DataFrame:
    """``signature`` (the key as text) and ``events`` (stage and event, in order) of each match."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    rows = df.where(F.col(ts).isNotNull()).withColumn("__tw_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__tw_k", group_signature([F.col(k) for k in keys]))
    for k, s in enumerate(stages):
        rows = rows.withColumn(f"__tw_f{k}", total(s.test)).withColumn(f"__tw_u{k}", F.lit(False) if s.until is None else total(s.until))
    if contiguity != "strict":
        used = F.lit(False)
        for k in range(len(stages)):
            used = used | F.col(f"__tw_f{k}") | F.col(f"__tw_u{k}")
        rows = rows.where(used)
    event = T.StructType([T.StructField("stage", T.StringType()), T.StructField("event", T.StructType([f for f in df.schema if not f.name.startswith("__tw_")]))])
    out = T.StructType([T.StructField("signature", T.StringType()), T.StructField("events", T.ArrayType(event))])
    arrow = to_arrow_schema(out)
    if within is None and skip == "past_last":
        from tidewatch.operators import composed

        try:
            machine = composed.machine_of(stages, contiguity == "strict")
        except composed.TooLarge:
            pass
        else:
            return composed.match_composed(rows, machine, [f.name for f in event["event"].dataType], tie, out)
    plain = [(s.name, s.low, s.high, s.also, s.greedy) for s in stages]
    limit = None if within is None else millis(within) * 1000
    dealt = rows.repartition("__tw_k").sortWithinPartitions("__tw_k", "__tw_t", *tie)
    return dealt.mapInArrow(lambda b: _scan(b, plain, limit, contiguity == "strict", skip == "past_last", arrow), out)
