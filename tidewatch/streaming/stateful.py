"""Sequence rules over streams.

Events wait in the state of their key until the watermark has passed them and are then
taken in event order, so a stream gives the matches that a batch over the same events
gives. What waits is bounded by the lateness, open matches by the time limit: an event-time
timer at the next event or deadline wakes the key even if it gets no more events.

A visit to the state and a row handed to Python cost far more than an event's own work.
So keys share the state's keys, a fixed number of buckets by their hash, whose waiting events,
clock and timer they have in common, and events of a bucket are packed into few rows before they are shuffled. What a rule
keeps stays apart by key. A late event is dropped if the watermark had passed it when its bucket was last
visited, or with its pack; one that comes later than Spark asks for, but before its bucket has gone on, may still be taken in order.

The state is kept by ``transformWithState`` in parts of their own: the events of a batch
that must wait are put once, as a few entries of a map or, if few, beside the bucket's clock, and removed once; an open match
is an entry, with the few events it had when it was put, and each event that it takes later,
and so are the A's of a loop. Times are
microseconds, as two events of a millisecond have an order. A batch
writes what it adds and removes, never a key's whole state, and reads what its buckets keep; events of
a match are read only when it ends. The state store is RocksDB with a log of changes,
which the first of these rules sets for its session (``RocksDBStateStoreProvider``).

Only events that pass some test reach the state (all of the key, where neighbours
count), but they are filtered above the watermark, so other events still move time.
Rules that relate fields of A and B are keyed by these fields as well; an event that can
be both comes once in each part, as B first.

``typed`` gives matches the columns that the batch operators give them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.scalars import group_signature, total
from tidewatch.operators.automaton import Automaton, Stage, _Open
from tidewatch.operators.sequences import roles
from tidewatch.operators.windows import millis
from tidewatch.shipping import ship

_OUT = "signature string, kind string, start_ms bigint, end_ms bigint, events string"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Events of an entry of the map of waiting events.
_ENTRY = 512
#: So few waiting events stand beside the clock, which is read and written in any case: a visit to the state costs more than a few events. So do few events of a match.
_FEW = 64
#: Keys of the state. A checkpoint's events were dealt by it.
_BUCKETS = 2048
#: Bytes of the events that go to the state as one row.
_PACK = 8192


def _shown(events: list[tuple[str, str]]) -> str:
    """Stages and their events' JSON, which stays as it is."""
    return "[" + ", ".join(f'{{"stage": {json.dumps(stage, ensure_ascii=False)}, "event": {text}}}' for stage, text in events) + "]"


class _Taken:
    """The events of a match's stage: those in the state, read when asked for, and those added since."""

    def __init__(self, read=None, stored: int = 0):
        self.read, self.stored, self.more, self._old = read, stored, [], None

    def __len__(self) -> int:
        return self.stored + len(self.more)

    def __iter__(self) -> Iterator[dict]:
        if self._old is None:
            self._old = [self.read(k) for k in range(self.stored)]
        yield from self._old
        yield from self.more

    def __getitem__(self, at):
        return list(self)[at]

    def append(self, event: dict) -> None:
        self.more.append(event)


class _Dict(dict):
    """Stages' events; a stage's first event makes its list."""

    def setdefault(self, name, _=None):
        if name not in self:
            self[name] = _Taken()
        return self[name]


class _Patterns:
    """Matches, and open matches whose time is up, by key."""

    def __init__(self, stages, within, skip, strict, kinds):
        self.args, self.kinds = (stages, within, strict, skip == "past_last"), kinds
        self.names = [stage[0] for stage in stages]
        self.reads_fields = any(stage[3] for stage in stages)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "id bigint", "who string, start bigint, stage int, closed boolean, counts array<int>, few string")
        # what an open match took after it was put, or more than a few events
        self.taken = handle.getMapState("taken", "id bigint, stage int, number int", "t bigint, json string")

    def event(self, time: int, text: str) -> dict:
        """Conditions on earlier events see an event's fields, as in its JSON."""
        return (json.loads(text) if self.reads_fields else {}) | {"t": time, "json": text}

    def _few(self, few: str | None) -> list[list]:
        return json.loads(few) if few is not None else [[] for _ in self.names]

    def _read(self, i: int, at: int, few: str | None, k: int) -> dict:
        near = self._few(few)[at]
        return self.event(*(near[k] if k < len(near) else self.taken.getValue((i, at, k))))

    def begin(self, serial: int) -> None:
        self.machines, self.serial, self.known = {}, serial, {}
        for (i,), (who, start, stage, closed, counts, few) in sorted(self.open.iterator()) if self.held else ():
            events = _Dict({self.names[at]: _Taken(lambda k, i=i, at=at, few=few: self._read(i, at, few, k), n) for at, n in enumerate(counts) if n})
            self._machine(who).open.append(m := _Open(start, stage, events, closed))
            self.known[id(m)] = (i, m, (stage, closed), list(counts), few)

    def _machine(self, who: str) -> Automaton:
        if who not in self.machines:
            self.machines[who] = Automaton(*self.args)
        return self.machines[who]

    def _opened(self) -> Iterator[tuple[str, _Open]]:
        return ((who, m) for who, machine in self.machines.items() for m in machine.open)

    def end(self) -> int | None:
        left = {id(m) for _, m in self._opened()}
        for key, (i, _, _, counts, few) in self.known.items():
            if key not in left:
                self.open.removeKey((i,))
                for at, (n, near) in enumerate(zip(counts, self._few(few))):
                    for k in range(len(near), n):
                        self.taken.removeKey((i, at, k))
        for who, m in self._opened():
            i, _, was, counts, few = self.known.get(id(m), (None, m, None, [0] * len(self.names), None))
            now = [len(m.taken.get(name, ())) for name in self.names]
            if was == (m.stage, m.closed) and now == counts:
                continue
            if i is None:
                i, self.serial = self.serial, self.serial + 1
                if sum(now) <= _FEW:
                    few, counts = json.dumps([[(e["t"], e["json"]) for e in m.taken.get(name, ())] for name in self.names], ensure_ascii=False), now
            for at, name in enumerate(self.names):
                events = m.taken.get(name, ())
                for k, e in enumerate(getattr(events, "more", events), counts[at]) if now[at] > counts[at] else ():
                    self.taken.updateValue((i, at, k), (e["t"], e["json"]))
            self.open.updateValue((i,), (who, m.start, m.stage, m.closed, now, few))
        return min((m.start + self.args[1] for _, m in self._opened()), default=None) if self.args[1] is not None else None

    @property
    def empty(self) -> bool:
        return not any(machine.open for machine in self.machines.values())

    def _row(self, kind: str, start: int, end: int, taken: dict) -> tuple:
        return kind, start, end, _shown([(s, e["json"]) for s, es in taken.items() for e in es])

    def _late(self, machine: Automaton, time: int) -> Iterator[tuple]:
        limit, late = self.args[1], 0
        if limit is not None:
            # they stand in order of their start
            while late < len(machine.open) and time - machine.open[late].start >= limit:
                late += 1
            for m in machine.open[:late] if "timeout" in self.kinds else ():
                yield self._row("timeout", m.start, m.start + limit, m.taken)
            machine.open = machine.open[late:] if late else machine.open

    def passed(self, time: int) -> Iterator[tuple]:
        for self.who, machine in self.machines.items():
            yield from self._late(machine, time)

    def take(self, time: int, text: str, flags: list, until: list) -> Iterator[tuple]:
        machine = self._machine(self.who)
        if "timeout" in self.kinds:
            yield from self._late(machine, time)
        for taken in machine.step(time, self.event(time, text), flags, until):
            if "match" in self.kinds:
                yield self._row("match", min(e["t"] for es in taken.values() for e in es), time, taken)


class _Loop:
    """The A's of a key since its last B: few beside their number, then entries, then those added since."""

    def __init__(self, stored: int = 0, useful: int = 0, last: int | None = None, entries: int = 0, few: str | None = None):
        self.stored, self.useful, self.last, self.entries, self.few = self.was = (stored, useful, last, entries, few)
        self.fresh, self.forgotten = [], False

    def forget(self) -> None:
        self.fresh, self.forgotten, self.last = [], True, None


class _RepeatThen:
    """A at least n times, then B; the state is the A's since the last B."""

    kinds = ("match",)

    def __init__(self, n: int, within: int | None, strict: bool, greedy: bool):
        self.n, self.within, self.strict, self.greedy = n, within, strict, greedy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "who string, number int", "events string")
        self.about = handle.getMapState("held", "who string", "stored bigint, useful bigint, last bigint, entries int, few string")

    def begin(self, serial: int) -> None:
        self.serial = serial
        self.loops = {who: _Loop(*about) for (who,), about in (self.about.iterator() if self.held else ())}

    def _since(self, who: str, x: _Loop) -> list[tuple]:
        texts = [] if x.forgotten else [x.few or "[]", *(self.taken.getValue((who, k))[0] for k in range(x.entries))]
        return [*(tuple(e) for text in texts for e in json.loads(text)), *x.fresh]

    def take(self, time: int, text: str, flags: list, until: list) -> Iterator[tuple]:
        is_a, is_b = flags
        if self.who not in self.loops:
            self.loops[self.who] = _Loop()
        x = self.loops[self.who]
        if is_b and not (is_a and (self.greedy or self.strict)):
            usable = [e for e in self._since(self.who, x) if self.within is None or time - e[0] < self.within] if x.last is not None else []
            if len(usable) >= self.n:
                yield "match", usable[0][0], time, _shown([("a", e[1]) for e in usable] + [("b", text)])
            x.forget()
        if is_a:
            x.fresh.append((time, text))
            x.last = time
        elif self.strict:
            x.forget()

    def passed(self, time: int) -> Iterator[tuple]:
        for x in self.loops.values():
            if x.last is not None and self.within is not None and time - x.last >= self.within:
                x.forget()
        self.time = time
        return iter(())

    @property
    def empty(self) -> bool:
        return all(x.last is None for x in self.loops.values())

    def _put(self, who: str, x: _Loop, first: int, events: list[tuple]) -> int:
        """Events as entries from that number on; the next number."""
        for k in range(0, len(events), _ENTRY):
            self.taken.updateValue((who, first), (json.dumps(events[k : k + _ENTRY], ensure_ascii=False),))
            first += 1
        return first

    def end(self) -> int | None:
        """When the last A of some key is of no more use. A's that no B can use any more go once they outnumber the others, so that each is moved once at most."""
        for who, x in self.loops.items():
            if not x.fresh and not x.forgotten:
                continue
            kept = 0 if x.forgotten else x.stored
            few, entries, useful, fresh = (None, 0, 0, x.fresh) if x.forgotten else (x.few, x.entries, x.useful, x.fresh)
            if self.within is not None and kept + len(fresh) > 2 * useful + 16 and x.last is not None:
                fresh = [e for e in self._since(who, x) if self.time - e[0] < self.within]
                few, entries, kept, useful = None, 0, 0, len(fresh)
            now = kept + len(fresh)
            for k in range(entries, x.entries):
                self.taken.removeKey((who, k))
            if now <= _FEW and not entries:
                few = json.dumps([*json.loads(few or "[]"), *fresh], ensure_ascii=False)
            else:
                entries = self._put(who, x, entries, fresh)
            if x.last is not None:
                self.about.updateValue((who,), (now, useful, x.last, entries, few))
            elif x.was[2] is not None:
                self.about.removeKey((who,))
        return min((x.last + self.within for x in self.loops.values() if x.last is not None), default=None) if self.within is not None else None


class _NotBefore:
    """B's without an A in the time before them; the state is the last A and the last alert of each key."""

    kinds = ("alert",)
    empty = True

    def __init__(self, within: int, silence: int | None):
        self.within, self.silence = within, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("last", "who string", "a bigint, json string, alert bigint")

    def begin(self, serial: int) -> None:
        self.serial = serial
        # many keys are read together
        found = {who: last for (who,), last in self.state.iterator()} if len(self.whos) > 8 else {who: self.state.getValue((who,)) for who in self.whos}
        self.was = {who: tuple(found.get(who) or (None, None, None)) for who in self.whos}
        self.now = dict(self.was)

    def take(self, time: int, text: str, flags: list, until: list) -> Iterator[tuple]:
        a, shown, alert = self.now[self.who]
        if flags[0]:
            self.now[self.who] = (time, text, alert)
        elif flags[1] and (a is None or time - a > self.within) and (self.silence is None or alert is None or time - alert > self.silence):
            self.now[self.who] = (a, shown, time)
            yield "alert", time, time, _shown([("b", text)] + ([("a", shown)] if a is not None else []))

    def passed(self, time: int) -> Iterator[tuple]:
        return iter(())

    def end(self) -> int | None:
        for who, last in self.now.items():
            if last != self.was[who]:
                self.state.updateValue((who,), last)
        return None


class _NotBeforePart(_NotBefore):
    """NOT BEFORE within a stretch of time, whose key ends with its number. It also says which was its last own A, for the stretches after it."""

    kinds = ("alert", "carry")

    def __init__(self, within: int, width: int):
        super().__init__(within, None)
        self.width = width

    def begin(self, serial: int) -> None:
        # a stretch is a key of its own, which its timer wakes without events too
        self.whos = {""}
        super().begin(serial)
        self.carry = None

    def take(self, time: int, text: str, flags: list, until: list) -> Iterator[tuple]:
        for kind, start, end, events in super().take(time, text, flags, until):
            yield kind, start, end, events, self.tie
        if flags[0] and time // self.width == int(self.key[1]):
            self.carry = ("carry", time, time, _shown([("a", text)]), self.tie)

    def passed(self, time: int) -> Iterator[tuple]:
        self.over = time >= (int(self.key[1]) + 1) * self.width
        if self.carry is not None:
            yield self.carry

    def end(self) -> int | None:
        """A stretch that the watermark has passed is forgotten; a timer sees to it."""
        if self.over:
            if self.was[""] != (None, None, None):
                self.state.removeKey(("",))
            return None
        super().end()
        return (int(self.key[1]) + 1) * self.width if self.now[""] != (None, None, None) else None


class _Carried(StatefulProcessor):
    """Alerts of all stretches of a signature, in order: the last A of earlier stretches where an alert has none, and silence.

    A batch brings what the watermark has passed since the one before, of all stretches, so nothing waits here.
    """

    def __init__(self, silence: int | None):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "a string, alert bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        a, alert = was = self.state.get() or (None, None)
        out = []
        for r in sorted(rows, key=lambda r: (r["end_ms"], r["tie"])):
            events = json.loads(r["events"])
            if r["kind"] == "carry":
                a = json.dumps(events[0], ensure_ascii=False)
            elif self.silence is None or alert is None or r["end_ms"] - alert > self.silence:
                alert = r["end_ms"]
                if len(events) == 1 and a is not None:
                    events.append(json.loads(a))
                out.append(Row(signature=key[0], kind="alert", start_ms=alert, end_ms=alert, events=json.dumps(events, ensure_ascii=False)))
        if (a, alert) != was:
            self.state.update((a, alert))
        return iter(out)

    def close(self) -> None:
        pass


class _Sequence(StatefulProcessor):
    """Lets the events of a state's key wait for the watermark and gives them to the rule in order.

    An event is its time, tie, JSON and flags, and in a bucket the key it belongs to (``who``), which the rule keeps apart.
    """

    def __init__(self, rule, stages: int, with_tie: bool = False, once: bool = False, shared: bool = False):
        self.rule, self.stages, self.with_tie, self.once, self.shared = rule, stages, with_tie, once, shared

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, last bigint, number bigint", "events string")
        # the watermark up to which events were taken, the next number to give, the timer, how many entries wait in the map, whether the rule has a state, and few events that wait here
        self.clock = handle.getValueState("clock", "done bigint, serial bigint, timer bigint, entries int, held boolean, few string")
        self.rule.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(int(t), *more) for r in rows for t, *more in json.loads(f"[{r['body']}]")]
        return self._turn(key, fresh, timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._turn(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _turn(self, key, fresh: list[tuple], passed: int, fired: int | None) -> Iterator[Row]:
        # all microseconds of the watermark's millisecond have passed
        watermark = passed * 1000 + 999
        done, serial, timer, entries, held, few = was = tuple(self.clock.get() or (None, 0, None, 0, False, None))
        ready, nexts = [], []
        if self.shared:
            # a pack may have late events beside others; what its bucket has passed is over
            done = 0 if done is None else done
            fresh = [e for e in fresh if e[0] > done]

        def sift(events: list[tuple]) -> None:
            ready.extend(e for e in events if done < e[0] <= watermark)
            nexts.extend([min(e[0] for e in events if e[0] > watermark)] if events[-1][0] > watermark else [])

        if few is not None:
            events = [tuple(e) for e in json.loads(few)]
            sift(events)
            few = few if events[-1][0] > watermark else None
        for entry in list(self.waiting.keys()) if entries else ():
            if entry[0] > watermark:
                nexts.append(entry[0])
                continue
            sift([tuple(e) for e in json.loads(self.waiting.getValue(entry)[0])])
            if entry[1] <= watermark:
                self.waiting.removeKey(entry)
                entries -= 1
        ready += [e for e in fresh if e[0] <= watermark]
        later = sorted(e for e in fresh if e[0] > watermark)
        if later:
            nexts.append(later[0][0])
        # stretches of time are few keys with many events, theirs stand in the map
        if 0 < len(later) <= _FEW and few is None and not self.with_tie:
            few = json.dumps(later, ensure_ascii=False)
            later = []
        for k in range(0, len(later), _ENTRY):
            some = later[k : k + _ENTRY]
            self.waiting.updateValue((some[0][0], some[-1][0], serial), (json.dumps(some, ensure_ascii=False),))
            serial, entries = serial + 1, entries + 1
        out = []
        rule = self.rule
        rule.key = key
        rule.held = held
        rule.whos = {event[4] if len(event) > 4 else "" for event in ready}
        rule.begin(serial)
        before = None
        for event in sorted(ready):
            # equal events have equal times, so they are ready together
            if self.once and event == before:
                continue
            before = event
            t, rule.tie, text, flags = event[:4]
            rule.who = event[4] if len(event) > 4 else ""
            bits = [c == "1" for c in flags]
            out += [(rule.who, *x) for x in rule.take(t, text, bits[: self.stages], bits[self.stages :])]
        # of each key in turn
        out += [(rule.who, *x) for x in rule.passed(watermark)]
        deadline = rule.end()
        if deadline is not None:
            nexts.append(deadline)
        wake = max(min(nexts) // 1000, passed + 1) if nexts else None
        if wake != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if nexts or not rule.empty or self.shared:
            now = (watermark, rule.serial, wake, entries, not rule.empty, few)
            # without waiting events the time up to which they were taken is of no matter
            if now[1:] != was[1:] or was[0] is None or (few is not None or entries or self.shared and ready) and now[0] != done:
                self.clock.update(now)
        elif was[0] is not None:
            self.clock.clear()
        for who, kind, start, end, events, *tie in out:
            if kind in rule.kinds:
                own = {"tie": tie[0]} if self.with_tie else {}
                yield Row(signature=json.loads(who)[0] if who else key[0], kind=kind, start_ms=start // 1000, end_ms=end // 1000, events=events, **own)


def _body(*parts: Column) -> Column:
    """An event as one text, a JSON list."""
    return F.to_json(F.array(*parts)).alias("body")


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a bucket as few rows, each with the latest time of its own; a row has about ``_PACK`` bytes or one event."""
    held, rows, size = [], 0, 0
    for b in batches:
        held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
        if rows >= 65_536 or size >= 1 << 24:
            yield from _packed(held)
            held, rows, size = [], 0, 0
    yield from _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches) if batches else None
    if not table:
        return
    table = table.sort_by("bucket").combine_chunks()
    bucket, ts, body = (table[name].chunk(0) for name in ("bucket", "ts", "body"))
    size = pc.binary_length(body).to_numpy().astype(np.int64)
    before = np.cumsum(size) - size
    other = np.concatenate([[True], np.diff(bucket.to_numpy()) != 0])
    part = (before - before[np.flatnonzero(other)][np.cumsum(other) - 1]) // _PACK
    starts = np.flatnonzero(other | np.concatenate([[True], np.diff(part) != 0]))
    latest = np.maximum.reduceat(pc.fill_null(ts.cast(pa.int64()), 0).to_numpy(), starts)
    bodies = pa.ListArray.from_arrays(pa.array(np.append(starts, len(body)), pa.int32()), body)
    yield pa.RecordBatch.from_arrays([bucket.take(pa.array(starts)), pa.array(latest).cast(ts.type), pc.binary_join(bodies, ",")], schema=table.schema)


def _micros(within: str | int | None) -> int | None:
    return None if within is None else millis(within) * 1000


def _order(df: DataFrame, tie: Sequence[str]) -> Column:
    """The tie as text that sorts as the columns do; integers by sign and sixteen hex digits."""

    def text(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.IntegralType):
            return F.concat(F.when(F.col(c) < 0, "0").otherwise("1"), F.lpad(F.hex(F.col(c).cast("bigint")), 16, "0"))
        return F.lpad(F.col(c).cast("string"), 24, "0")

    return F.concat_ws(",", *[text(c) for c in tie])


def _run(df: DataFrame, keys: Sequence[str] | Column, flags: list[Column], stages: int, ts: str, tie: Sequence[str], rule, relation: Sequence[tuple[str, str]] = (), everything: bool = False, lonely: bool = False, once: bool = False) -> DataFrame:
    """``everything``: events that pass no test count too. ``lonely``: an A without a value of a related field stays, and no B relates to it. ``once``: equal events are one."""
    ship(df.sparkSession)
    for name, value in _STORE.items():
        df.sparkSession.conf.set(name, value)
    carry = df.columns
    signature = keys if isinstance(keys, Column) else group_signature([F.col(k) for k in keys])
    order = _order(df, tie)
    if relation:
        if stages != 2:
            raise ValueError("fields are related between two events")
        rows = df.withColumn("__tw_a", total(flags[0])).withColumn("__tw_b", total(flags[1]))
        rows = roles(rows, [], relation, lonely=lonely)
        bits = F.when(F.col("__tw_a"), "1000").otherwise("0100")
        order = F.concat(order, F.when(F.col("__tw_b"), ",0").otherwise(",1"))
        related = F.to_json("__tw_k")
    else:
        rows, related = df, F.lit("")
        bits = F.concat(*[F.when(total(c), "1").otherwise("0") for c in flags])
    rows = rows.withColumn("__tw_flags", bits)
    if not everything:
        # a test that isn't deterministic stays above the watermark (rand() < 0 alone would be replaced by false)
        rows = rows.where(F.col("__tw_flags").contains("1") | (F.rand() + F.rand() < 0))
    who = F.to_json(F.array(signature, related))
    rows = rows.select(F.pmod(F.xxhash64(who), F.lit(_BUCKETS)).cast("int").alias("bucket"), F.col(ts).alias("ts"), _body(F.unix_micros(ts).cast("string"), order, F.to_json(F.struct(*carry), _TIMES), F.col("__tw_flags"), who))
    packs = rows.mapInArrow(_packs, rows.schema)
    return packs.groupBy("bucket").transformWithState(_Sequence(rule, stages, once=once, shared=True), _OUT, "append", "eventTime")


def match_stream(df: DataFrame, stages: Sequence[Stage], keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None = None, skip: str = "next", contiguity: str = "relaxed", kinds: Sequence[str] = ("match", "timeout"), relation: Sequence[tuple[str, str]] = (), once: bool = False) -> DataFrame:
    """Matches and timed-out beginnings of a pattern over a stream with a watermark on ``ts``. ``relation``: fields of the first of two stages and of the second that are equal, in any case of letters."""
    plain = [(s.name, s.low, s.high, s.also, s.greedy) for s in stages]
    flags = [*(s.test for s in stages), *(F.lit(False) if s.until is None else s.until for s in stages)]
    rule = _Patterns(plain, _micros(within), skip, contiguity == "strict", tuple(kinds))
    return _run(df, keys, flags, len(stages), ts, tie, rule, relation, everything=contiguity == "strict" and not relation, lonely="timeout" in kinds, once=once)


def followed_by_stream(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None = None, skip: str = "next", contiguity: str = "relaxed", relation: Sequence[tuple[str, str]] = (), once: bool = False) -> DataFrame:
    return match_stream(df, [Stage("a", a), Stage("b", b)], keys, ts, tie, within, skip, contiguity, ("match",), relation, once)


def not_followed_by_stream(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int, relation: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Each A whose time ran out without a B, once the watermark has passed its end."""
    return match_stream(df, [Stage("a", a), Stage("b", b)], keys, ts, tie, within, "next", kinds=("timeout",), relation=relation)


def repeated_then_stream(df: DataFrame, a: Column, b: Column, n: int, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int | None = None, contiguity: str = "relaxed", relation: Sequence[tuple[str, str]] = (), greedy: bool = True) -> DataFrame:
    """A at least n times, then B."""
    strict = contiguity == "strict"
    rule = _RepeatThen(n, _micros(within), strict, greedy)
    return _run(df, keys, [a, b], 2, ts, tie, rule, relation, everything=strict and not relation)


def not_before_stream(df: DataFrame, a: Column, b: Column, ts: str, tie: Sequence[str], within: str | int, a_fields: Sequence[str] = (), b_fields: Sequence[str] = (), silence: str | int | None = None) -> DataFrame:
    """B's without an A in the time before them, by group. Without groups, stretches of time are the keys of the state."""
    if not a_fields and not b_fields:
        return _not_before_unkeyed(df, a, b, ts, tie, millis(within), None if silence is None else millis(silence))
    own = total(a)
    sign = F.when(own, group_signature([F.col(c) for c in a_fields])).otherwise(group_signature([F.col(c) for c in b_fields]))
    rule = _NotBefore(_micros(within), _micros(silence))
    return _run(df, sign, [own, total(b) & ~own], 2, ts, tie, rule)


def _not_before_unkeyed(df: DataFrame, a: Column, b: Column, ts: str, tie: Sequence[str], within: int, silence: int | None) -> DataFrame:
    """Two operators: alerts are found in stretches of one limit, which share the events out, A's in their own and the next one; then
    the few alerts and each stretch's last A meet, for silence and for A's of long ago."""
    ship(df.sparkSession)
    for name, value in _STORE.items():
        df.sparkSession.conf.set(name, value)
    width, own = max(1, within), total(a)
    order = _order(df, tie)
    stretch = F.floor(F.unix_millis(ts) / width).cast("bigint")
    flags = F.concat(F.when(own, "1").otherwise("0"), F.when(total(b) & ~own, "1").otherwise("0"), F.lit("00"))
    places = F.transform(F.when(own, F.array(stretch, stretch + 1)).otherwise(F.array(stretch)), lambda x: x.cast("string"))
    rows = df.select(F.lit("All").alias("signature"), F.explode(places).alias("stretch"), F.col(ts).alias("ts"), _body(F.unix_micros(ts).cast("string"), order, F.to_json(F.struct(*df.columns), _TIMES), flags), flags.alias("flags"))
    rows = rows.where(F.col("flags").contains("1") | (F.rand() + F.rand() < 0)).drop("flags")
    parts = rows.groupBy("signature", "stretch").transformWithState(_Sequence(_NotBeforePart(within * 1000, width * 1000), 2, with_tie=True), f"{_OUT}, tie string", "append", "eventTime")
    return parts.groupBy("signature").transformWithState(_Carried(silence), _OUT, "append", "none")


def typed(found: DataFrame, events: DataFrame, *stages: str) -> DataFrame:
    """Matches of ``events`` with their columns: for each stage those of its first event, as ``<stage>_<column>``, and ``times``, the number of events of the first stage."""
    event = T.StructType([T.StructField("stage", T.StringType()), T.StructField("event", events.schema)])
    rows = found.withColumn("__tw_e", F.from_json("events", T.ArrayType(event), _TIMES))
    def of(stage: str) -> Column:
        return F.filter("__tw_e", lambda e: e["stage"] == stage)

    own = {s: of(s) for s in stages}
    rows = rows.withColumns({f"__tw_{s}": F.get(c, F.lit(0))["event"] for s, c in own.items()}).withColumn("times", F.size(own[stages[0]]).cast("bigint"))
    return rows.select("signature", *[F.col(f"__tw_{s}.{c}").alias(f"{s}_{c}") for s in stages for c in events.columns], "times")


def typed_events(found: DataFrame, events: DataFrame) -> DataFrame:
    """``signature`` and the ``events`` of each match, as the general patterns give them in batch."""
    event = T.StructType([T.StructField("stage", T.StringType()), T.StructField("event", events.schema)])
    return found.select("signature", F.from_json("events", T.ArrayType(event), _TIMES).alias("events"))
