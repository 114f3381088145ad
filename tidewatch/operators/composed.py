"""Patterns as finite machines whose runs over ranges of events are put together.

A pattern without a time limit and without conditions on earlier events, that skips past the
last event of a match, has finitely many situations: which beginnings are open, each by
its stage and count, the oldest first (of two alike only the older can ever win). So
events needn't be taken by one task for each key, or by one task where there is no key:
they are dealt by range of key and time, in parts of equal size, and

1. each part sums up what it does to every situation that it may be entered in: the
   situation it leaves behind, and for each open beginning whether it ends in a match there,
   goes on, or is dropped. Situations soon lead to the same one, so this costs little more
   than one run;
2. the summaries, a row for each part, are folded in order: forward to the situation
   in which each part is really entered, backward to the match that each beginning
   left open comes to;
3. each part runs once more from there and gives the events of its matches, also those
   of matches that end in a later part. The events of a match then meet by its number.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.operators.automaton import Automaton, Stage, _Open
from tidewatch.shared import shared_dir
from tidewatch.shipping import ship

#: A pattern with more situations than these, or more kinds of events, is left to the plain automaton.
MOST_STATES, MOST_BITS = 128, 8

#: An open beginning: its stage, events taken in it, whether it is closed.
Config = tuple[int, int, bool]
_NEW = -1


class TooLarge(ValueError):
    pass


class Machine:
    """All situations of a pattern (``states``), and what each symbol does in each (``steps``).

    A symbol has a bit for each stage's test, then one for each ``until``. A step is the next state, for each of its
    beginnings where it comes from and whether it took the event, and the beginning that became a match, if any.
    """

    def __init__(self, stages: Sequence[tuple[str, int, int | None, bool]], untils: Sequence[bool], strict: bool):
        self.plain = [(name, low, high, None, greedy) for name, low, high, greedy in stages]
        self.strict, self.untils = strict, [k for k, u in enumerate(untils) if u]
        bits = len(stages) + len(self.untils)
        if bits > MOST_BITS:
            raise TooLarge(f"{bits} tests")
        self.states: list[tuple[Config, ...]] = [()]
        number, self.steps = {(): 0}, []
        while len(self.steps) < len(self.states):
            row = []
            for symbol in range(1 << bits):
                state, moves, done = self._step(self.states[len(self.steps)], symbol)
                if state not in number:
                    number[state] = len(self.states)
                    self.states.append(state)
                    if len(self.states) > MOST_STATES:
                        raise TooLarge("too many situations")
                row.append((number[state], moves, done))
            self.steps.append(row)

    def _step(self, state: tuple[Config, ...], symbol: int) -> tuple[tuple[Config, ...], tuple, int | None]:
        n = len(self.plain)
        until = [False] * n
        for at, k in enumerate(self.untils):
            until[k] = bool(symbol >> (n + at) & 1)
        machine = Automaton(self.plain, None, self.strict, True)
        opened = [_Open(0, stage, {self.plain[stage][0]: [{}] * count}, closed) for stage, count, closed in state]
        machine.open = list(opened)
        before = {id(m.taken): (k, sum(map(len, m.taken.values()))) for k, m in enumerate(opened)}
        found = machine.step(0, {}, [bool(symbol >> k & 1) for k in range(n)], until)
        done = before.get(id(found[0]), (_NEW, 0))[0] if found else None
        after: dict[Config, tuple[int, bool]] = {}
        for m in machine.open:
            name, low, high, _, _ = self.plain[m.stage]
            source, had = before.get(id(m.taken), (_NEW, 0))
            config = (m.stage, min(len(m.taken[name]), low if high is None else high), m.closed)
            after.setdefault(config, (source, sum(map(len, m.taken.values())) > had))
        return tuple(after), tuple(after.values()), done


class _Summary:
    """What a run of events does to each state; fed symbol by symbol."""

    def __init__(self, machine: Machine, states: Sequence[int]):
        self.machine = machine
        self.fates = {e: [None] * len(machine.states[e]) for e in states}
        # those that are in the same situation with the same beginnings go on together
        self.paths = {(e, tuple(range(len(machine.states[e])))): [e] for e in states}

    def feed(self, symbols: Sequence[int], first: int) -> None:
        for at, symbol in enumerate(symbols, first):
            paths: dict[tuple, list[int]] = {}
            for (state, origins), entries in self.paths.items():
                state, moves, done = self.machine.steps[state][symbol]
                if done is not None and done != _NEW and origins[done] != _NEW:
                    for e in entries:
                        self.fates[e][origins[done]] = ("match", at)
                key = (state, tuple(_NEW if source == _NEW else origins[source] for source, _ in moves))
                if key in paths:
                    paths[key] += entries
                else:
                    paths[key] = entries
            self.paths = paths

    def result(self) -> dict[int, tuple[int, list]]:
        """For each state the one it becomes, and the fate of each beginning: (match, event), (open, its place) or none."""
        out = {}
        for (state, origins), entries in self.paths.items():
            for e in entries:
                for place, origin in enumerate(origins):
                    if origin != _NEW:
                        self.fates[e][origin] = ("open", place)
                out[e] = (state, self.fates[e])
        return out


def _runs(keys: pa.Array) -> list[tuple[str, int, int]]:
    """The key, begin and end of each run of equal keys."""
    codes = keys.dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist()
    return [(codes.dictionary[int(at[a])].as_py(), a, b) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]


def _sum_up(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    """A row for each part: its number, first and last key, and a summary of the first key's events and of the last one's."""
    part = first = last = head = tail = None
    seen = 0
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("__tw_p")[0].as_py()
        symbols = b.column("__tw_y").to_numpy()
        for key, begin, end in _runs(b.column("__tw_k")):
            if head is None:
                first, head = key, _Summary(machine, range(len(machine.states)))
            elif key != last:  # begins here, so in the first state
                tail = _Summary(machine, [0])
            last = key
            (tail or head).feed(symbols[begin:end].tolist(), seen + begin)
        seen += b.num_rows
    if head is not None:
        data = pickle.dumps((head.result(), tail.result()[0][0] if tail else None))
        yield pa.record_batch([pa.array([part]), pa.array([first]), pa.array([last]), pa.array([data], pa.binary())], ["part", "first", "last", "data"])


def _fold(parts: list, machine: Machine) -> dict[int, tuple[int, list]]:
    """For each part the state in which it is entered, and the match (part, event) that each beginning it leaves open comes to."""
    entered, left = [], []
    for k, (_, first, _, head, tail) in enumerate(parts):
        entered.append(left[-1] if k and parts[k - 1][2] == first else 0)
        left.append(head[entered[-1]][0] if tail is None else tail)
    comes_to: list[list] = [[] for _ in parts]
    for k in range(len(parts) - 1, -1, -1):
        comes_to[k] = [None] * len(machine.states[left[k]])
        if k + 1 < len(parts) and parts[k + 1][1] == parts[k][2]:
            number, _, _, head, tail = parts[k + 1]
            for j, fate in enumerate(head[entered[k + 1]][1]):
                if fate and fate[0] == "match":
                    comes_to[k][j] = (number, fate[1])
                elif fate and tail is None:
                    comes_to[k][j] = comes_to[k + 1][fate[1]]
    return {p[0]: (entered[k], comes_to[k]) for k, p in enumerate(parts)}


def _emit(batches: Iterator[pa.RecordBatch], machine: Machine, known, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The events of all matches: the match's number, the event's place and stage, and the event."""
    held: list[tuple[int, pa.RecordBatch]] = []
    found: list[tuple[int, int, int, int]] = []
    part = key_now = None
    state, taken, seen, last_stage = 0, [], 0, len(machine.plain) - 1
    columns = [n for n in schema.names if n not in ("match_part", "match_event", "place", "stage")]

    def flush() -> Iterator[pa.RecordBatch]:
        rows = np.array(found, np.int64).reshape(-1, 4)
        found.clear()
        for begin, b in held:
            own = rows[(rows[:, 2] >= begin) & (rows[:, 2] < begin + b.num_rows)]
            if len(own):
                at = pa.array(own[:, 2] - begin)
                yield pa.record_batch([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(own[:, 2]), pa.array(own[:, 3].astype(np.int32)), *(b.column(c).take(at) for c in columns)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        held.append((seen, b))
        symbols = b.column("__tw_y").to_numpy().tolist()
        for key, begin, end in _runs(b.column("__tw_k")):
            if part is None:
                part, key_now = b.column("__tw_p")[0].as_py(), key
                state = known[part][0]
                taken = [[] for _ in machine.states[state]]
            elif key != key_now:
                key_now, state, taken = key, 0, []
            for at in range(begin, end):
                nexts, moves, done = machine.steps[state][symbols[at]]
                if done is not None:
                    found += [(part, seen + at, place, stage) for place, stage in (taken[done] if done != _NEW else [])] + [(part, seen + at, seen + at, last_stage)]
                after = []
                for (source, took), config in zip(moves, machine.states[nexts], strict=True):
                    own = [] if source == _NEW else taken[source]
                    if took:
                        own.append((seen + at, config[0]))
                    after.append(own)
                state, taken = nexts, after
        seen += b.num_rows
        yield from flush()
        # batches before the oldest event of an open beginning are done with
        oldest = min((t[0][0] for t in taken if t), default=seen)
        held = [(at, x) for at, x in held if at + x.num_rows > oldest]
    if part is not None:
        for own, match in zip(taken, known[part][1], strict=True):
            if match is not None:
                found += [(*match, place, stage) for place, stage in own]
        yield from flush()


def machine_of(stages: Sequence[Stage], strict: bool) -> Machine:
    """Raises ``TooLarge`` for what has no finite machine of fair size."""
    if any(s.also is not None for s in stages):
        raise TooLarge("conditions on earlier events")
    return Machine([(s.name, s.low, s.high, s.greedy) for s in stages], [s.until is not None for s in stages], strict)


def match_composed(rows: DataFrame, machine: Machine, names: Sequence[str], tie: Sequence[str], out) -> DataFrame:
    """Matches of ``rows`` with ``__tw_k`` (key), ``__tw_t``, ``__tw_f…`` and ``__tw_u…`` (tests) as ``signature`` and ``events``; ``names``: the events' own columns."""
    spark = rows.sparkSession
    ship(spark)
    shared_dir(spark)
    n = len(machine.plain)
    bits = [F.col(f"__tw_f{k}").cast("int") * (1 << k) for k in range(n)] + [F.col(f"__tw_u{k}").cast("int") * (1 << (n + at)) for at, k in enumerate(machine.untils)]
    rows = rows.select(*names, "__tw_k", "__tw_t", sum(bits[1:], bits[0]).alias("__tw_y"))
    # cut, so that all readings see the same parts
    rows = rows.repartitionByRange("__tw_k", "__tw_t", *tie).sortWithinPartitions("__tw_k", "__tw_t", *tie).withColumn("__tw_p", F.spark_partition_id()).checkpoint(eager=True)
    sums = rows.select("__tw_p", "__tw_k", "__tw_y").mapInArrow(lambda b: _sum_up(b, machine), "part bigint, first string, last string, data binary")
    # a row for each part
    parts = sorted((r["part"], r["first"], r["last"], *pickle.loads(r["data"])) for r in sums.collect())
    known = spark.sparkContext.broadcast(_fold(parts, machine))
    fields = [f for f in rows.schema.fields if f.name in (*names, "__tw_k", "__tw_p")]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("match_part", "match_event", "place")] + [T.StructField("stage", T.IntegerType())])
    for f in fields:
        schema = schema.add(f)
    arrow = to_arrow_schema(schema)
    found = rows.mapInArrow(lambda b: _emit(b, machine, known.value, arrow), schema)
    stage = F.element_at(F.array(*[F.lit(s[0]) for s in machine.plain]), F.col("stage") + 1).alias("stage")
    # a part's events follow those of the parts before it, so the part in which an event lies orders events of several parts
    one = F.struct("__tw_p", "place", F.struct(stage, F.struct(*names).alias("event")).alias("e"))
    whole = found.groupBy("__tw_k", "match_part", "match_event").agg(F.sort_array(F.collect_list(one)).alias("l"))
    return whole.select(F.col("__tw_k").alias("signature"), F.transform("l", lambda x: x["e"]).cast(out["events"].dataType).alias("events"))
