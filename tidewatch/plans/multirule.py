"""Many rules over one reading of the events, sequences among them.

``one_scan`` reads the events once, whatever the number of rules. An event is copied once for
each set of keys by which rules group (twice where a rule relates a field of A to one of
B: for each part it can play), if it passes any of their tests, and once more near the
border of a stretch of time. One exchange deals the copies by keys and stretch, and
there all rules of all key sets are answered by window expressions over the same sorted
rows, onward and backward in time. Tests and next or last events are worked out
once for each different text, however many rules share it. Matches and what windowed
rules count are then aggregated together. So the number of scans and shuffles doesn't
depend on the rules.

How the sequences are told from the rows of a stretch: after a row, the next B is the last one met when
rows are gone through backward. An A whose next B comes within the limit is usable by it; the first
usable A since the B before begins the match, and usable A's between are a difference of running
counts. All frames begin with the stretch, as Spark works a frame that shrinks out anew for
every row; so a hot key costs its number of rows. Rows of key sets without sequences need no
neighbours and are dealt evenly, whatever their keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.intel import IntelGroups
from tidewatch.functions.scalars import as_number, group_signature, key_text, total
from tidewatch.operators.sequences import STRETCH, _stretch
from tidewatch.operators.windows import millis
from tidewatch.plans.compiler import Tests, _over
from tidewatch.plans.rules import Having, Rule

_WINDOWED = ("having_count", "having_sum", "having_count_distinct")
_SEQUENCES = ("followed_by", "not_followed_by", "not_before", "repeat_then")
#: Rows of key sets without sequences are dealt to so many parts.
PARTS = 4096


def _micros(rule: Rule) -> int:
    return millis(rule.window.interval) * 1000


def _refuse(rule: Rule) -> None:
    if rule.family in _SEQUENCES and rule.window is None:
        raise ValueError(f"rule {rule.name}: a sequence without a time limit doesn't share a pass")
    if rule.family not in ("having_any", *_WINDOWED, *_SEQUENCES) or rule.family == "not_before" and rule.silence:
        raise ValueError(f"rule {rule.name}: {rule.family}{' with silence' if rule.silence else ''} doesn't share a pass")
    if rule.contiguity == "strict" and (rule.family != "followed_by" or rule.relation):
        raise ValueError(f"rule {rule.name}: strict {rule.family} doesn't share a pass")


class _Flags:
    """A column for each different test, by number."""

    def __init__(self, tests: Tests):
        self.tests, self.texts = tests, {}

    def __call__(self, text: str, where: str) -> str:
        return f"__tw_f{self.texts.setdefault((text, where), len(self.texts))}"

    def columns(self) -> dict[str, Column]:
        return {f"__tw_f{k}": total(self.tests[text] & self.tests[where] if where else self.tests[text]) for (text, where), k in self.texts.items()}


class _Windows:
    """Window expressions as SQL, each once, in rounds that may use those before."""

    def __init__(self, tie: Sequence[str]):
        self.rounds: list[dict[str, str]] = [{}, {}, {}]
        self.names: dict[str, str] = {}
        place = "PARTITION BY __tw_g, __tw_key, __tw_s ORDER BY"
        onward = ["__tw_t", *[f"`{c}`" for c in tie], "__tw_role"]
        self.before = f"({place} {', '.join(onward)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        self.back = f"({place} {', '.join(f'{c} DESC' for c in onward)})"
        self.after = f"{self.back[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def add(self, when: int, sql: str) -> str:
        if sql not in self.names:
            self.names[sql] = f"__tw_w{len(self.names)}"
            self.rounds[when][self.names[sql]] = sql
        return self.names[sql]

    def over(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, columns: d.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()]) if columns else d, self.rounds, df)


def one_scan(rules: Sequence[Rule], events: DataFrame, ts: str = "ts", tie: tuple[str, ...] = ("event_id",), groups: IntelGroups | None = None, raw: str | None = None) -> DataFrame:
    """``rule`` (its key), ``signature``, ``window_start``, ``window_end``, ``value``, and ``a_…`` and ``b_…``: time and ``tie`` of the match's events.

    having_any: a. Windowed rules: the window and its value. followed_by: a and b. not_followed_by: a. not_before: b;
    the last A, too long ago to matter, isn't looked up. repeat_then: the first A, b, and the number of A's as value.
    Sequences need a time limit; repeat_until, strict loops and silence have plans of their own only.
    """
    for r in rules:
        _refuse(r)
    tests = Tests(events, [t for r in rules for t in (*(e.filter for e in r.events), r.where)], groups, raw)
    flag = _Flags(tests)
    sides = [[flag(e.filter, r.where) for e in r.events] for r in rules]
    sets: dict[tuple, list[int]] = {}
    for k, r in enumerate(rules):
        sets.setdefault((tuple(r.groupBy), tuple(map(tuple, r.relation))), []).append(k)
    at = {k: g for g, members in enumerate(sets.values()) for k in members}
    limits = [_micros(r) for r in rules if r.family in _SEQUENCES]
    width, near = max(limits, default=1) * STRETCH, max(limits, default=0)

    flags = flag.columns()
    own_field = [next(iter(r.having.values()), Having()).field if r.family in ("having_sum", "having_count_distinct") else None for r in rules]
    numbers = {f: f"__tw_v{k}" for k, f in enumerate(dict.fromkeys(f for f, r in zip(own_field, rules, strict=True) if r.family == "having_sum"))}
    texts = {f: f"__tw_d{k}" for k, f in enumerate(dict.fromkeys(f for f, r in zip(own_field, rules, strict=True) if r.family == "having_count_distinct"))}
    read = flags | {c: F.coalesce(as_number(F.col(f)), F.lit(0.0)) for f, c in numbers.items()} | {c: key_text(F.col(f)) for f, c in texts.items()}
    rows = tests.df.where(F.col(ts).isNotNull()).withColumns(read | {"__tw_t": F.unix_micros(F.col(ts).cast("timestamp"))})
    rows = _copies(rows, rules, sides, sets, tie)
    keep = list(dict.fromkeys(["__tw_g", "__tw_key", "__tw_sign", "__tw_t", *tie, "__tw_role", "__tw_seq", *read]))
    rows = _stretched(rows.select(*keep), width, near, tie)

    w = _Windows(tie)
    names = ["__tw_t", *tie]
    e = f"struct({', '.join(f'`{c}`' for c in names)})"
    kinds = ", ".join(["__tw_t: bigint", *[f"`{c}`: {events.schema[c].dataType.simpleString()}" for c in tie]])
    nothing = f"CAST(NULL AS struct<{kinds}>)"

    def hit(k: int, test: str, a: str = nothing, b: str = nothing, pane: str = "CAST(NULL AS bigint)", value: str = "1D", distinct: str = "CAST(NULL AS string)") -> str:
        return f"CASE WHEN __tw_g = {at[k]} AND {test} THEN named_struct('k', {k}, 'pane', {pane}, 'a', {a}, 'b', {b}, 'v', CAST({value} AS double), 'd', {distinct}) END"

    def found(k: int) -> str:
        r, a = rules[k], sides[k][0]
        if r.family == "having_any":
            return hit(k, a, e)
        if r.family in _WINDOWED:
            step = math.gcd(_micros(r), _micros_of(r.slide, r))
            return hit(k, a, pane=f"__tw_t - pmod(__tw_t, {step}L)", value=numbers[own_field[k]] if r.family == "having_sum" else "1D", distinct=texts[own_field[k]] if r.family == "having_count_distinct" else "CAST(NULL AS string)")
        b, limit = sides[k][1], _micros(r)
        a, b = f"({a} AND __tw_role <> 0)", f"({b} AND __tw_role <> 1)"
        if r.contiguity == "strict":
            neighbour = w.add(0, f"lag(CASE WHEN {b} THEN {e} END) OVER {w.back}")
            return hit(k, f"{a} AND {neighbour}.__tw_t - __tw_t < {limit}", e, neighbour)
        if r.family == "not_before":
            last = w.add(1, f"last(CASE WHEN {a} THEN __tw_t END) IGNORE NULLS OVER {w.before}")
            return hit(k, f"{b} AND NOT {a} AND NOT coalesce(__tw_t - {last} <= {limit}, false)", b=e)
        if r.family == "not_followed_by" or r.family == "followed_by" and r.skip == "next":
            nexts = w.add(0, f"last(CASE WHEN {b} THEN {e} END) IGNORE NULLS OVER {w.after}")
            soon = f"coalesce({nexts}.__tw_t - __tw_t < {limit}, false)"
            return hit(k, f"{a} AND {soon}", e, nexts) if r.family == "followed_by" else hit(k, f"{a} AND NOT {soon}", e)
        # the A's since the B before, within the limit; an event that is both goes on with a loop's A's, else it ends the run
        loop = r.family == "repeat_then"
        a, b = (a, f"({b} AND NOT {a})") if loop else (f"({a} AND NOT {b})", b)
        nexts = w.add(0, f"last(CASE WHEN {b} THEN __tw_t END) IGNORE NULLS OVER {w.after}")
        usable = f"({a} AND coalesce({nexts} - __tw_t < {limit}, false))"
        run = w.add(1, f"last(CASE WHEN {b} THEN false WHEN {usable} THEN true END) IGNORE NULLS OVER {w.before}")
        count = w.add(1, f"count(CASE WHEN {usable} THEN 1 END) OVER {w.before}") if loop else "1L"
        first = f"CASE WHEN {usable} AND NOT coalesce({run}, false) THEN struct({', '.join(f'`{c}`' for c in names)}{f', {count} AS n' if loop else ''}) END"
        start = w.add(2, f"last({first}) IGNORE NULLS OVER {w.before}")
        begun = f"struct({', '.join(f'{start}.`{c}`' for c in names)})"
        enough = f"{count} - {start}.n >= {r.patternRepeat.low}" if loop else "true"
        return hit(k, f"{b} AND coalesce({run}, false) AND {begun} < {e} AND {enough}", begun, e, value=f"{count} - {start}.n" if loop else "1D")

    hits = [found(k) for k in range(len(rules))]
    rows = w.over(rows).where("__tw_own")
    got = rows.selectExpr("__tw_sign AS signature", f"inline(filter(array({', '.join(hits)}), x -> x IS NOT NULL))")
    return _aggregated(rules, got, tie)


def _micros_of(slide, rule: Rule) -> int:
    return millis(slide.interval) * 1000 if slide else _micros(rule)


def _copies(rows: DataFrame, rules: Sequence[Rule], sides: list[list[str]], sets: dict[tuple, list[int]], tie: Sequence[str]) -> DataFrame:
    """A copy of an event for each key set that it concerns: its number, key and signature; role 0: B only, 1: A only, 2: both."""
    copies = []
    for g, ((keys, relation), members) in enumerate(sets.items()):
        sign = group_signature([F.col(c) for c in keys])
        strict = any(rules[k].contiguity == "strict" for k in members)
        sequence = any(rules[k].family in _SEQUENCES for k in members)

        def copy(test: Column, key: Column, role: int, g=g, sign=sign, sequence=sequence) -> Column:
            return F.when(test, F.struct(F.lit(g).alias("g"), key.alias("key"), sign.alias("sign"), F.lit(role).alias("role"), F.lit(sequence).alias("seq")))

        any_of = lambda which: F.expr(" OR ".join(dict.fromkeys(which)))
        if not relation:
            copies.append(copy(F.lit(True) if strict else any_of([c for k in members for c in sides[k]]), sign, 2))
            continue
        for at in (1, 0):
            values = [F.lower(F.col(r[at]).cast("string")) for r in relation]
            there = reduce(lambda x, y: x & y, [v.isNotNull() for v in values])
            key = F.concat_ws("\x1f", F.lit("r"), sign, *values)
            test = any_of([sides[k][at] for k in members])
            if at == 0:  # an A that relates to nothing is alone
                copies.append(copy(test, F.when(there, key).otherwise(F.concat_ws("\x1f", F.lit("n"), *[F.col(c).cast("string") for c in tie])), 1))
            else:
                copies.append(copy(test & there, key, 0))
    rows = rows.withColumn("__tw_c", F.explode(F.array_compact(F.array(*copies))))
    return rows.withColumns({f"__tw_{c}": F.col(f"__tw_c.{c}") for c in ("g", "key", "sign", "role", "seq")}).drop("__tw_c")


def _stretched(rows: DataFrame, width: int, near: int, tie: Sequence[str]) -> DataFrame:
    """Rows of sequence rules once in their stretch (``__tw_own``) and once in each neighbour that needs them as context; others in one of ``PARTS`` parts."""
    s, inside = _stretch(F.col("__tw_t"), width), F.pmod("__tw_t", F.lit(width))
    place = lambda which, own: F.struct(which.alias("s"), F.lit(own).alias("own"))
    seq = F.col("__tw_seq")
    places = F.array(place(s, True), F.when(seq & (inside >= width - near), place(s + 1, False)), F.when(seq & (inside < near), place(s - 1, False)))
    rows = rows.withColumn("__tw_p", F.explode(F.array_compact(places)))
    part = F.pmod(F.xxhash64("__tw_sign", "__tw_t", *tie), F.lit(PARTS))
    return rows.withColumns({"__tw_s": F.when(seq, F.col("__tw_p.s")).otherwise(part), "__tw_key": F.when(seq, F.col("__tw_key")), "__tw_own": F.col("__tw_p.own")}).drop("__tw_p", "__tw_seq")


def _covering(size: int, slide: int) -> Column:
    """Starts of the windows that a pane lies in."""
    first = F.col("pane") - F.pmod("pane", F.lit(slide))
    starts = F.transform(F.sequence(F.lit(0), F.lit(-(-size // slide) - 1)), lambda j: first - j * F.lit(slide))
    return F.filter(starts, lambda s: s + F.lit(size) > F.col("pane"))


def _aggregated(rules: Sequence[Rule], got: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Windowed rules counted by pane, then by window, then over different values; matches of other rules go along as they are."""
    windowed = [k for k, r in enumerate(rules) if r.family in _WINDOWED]
    k = F.col("k")
    if not windowed:
        out = got.withColumns({"start": F.lit(None).cast("bigint"), "value": F.col("v")})
    else:
        counted = k.isin(windowed)
        got = got.withColumn("u", F.when(~counted, F.col("v")))
        same = ["k", "signature", "a", "b", "u"]
        panes = got.groupBy(*same, "pane", "d").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
        starts = F.array(F.lit(None).cast("bigint"))
        for spec in {(_micros(rules[i]), _micros_of(rules[i].slide, rules[i])) for i in windowed}:
            size, slide = spec
            mine = [i for i in windowed if (_micros(rules[i]), _micros_of(rules[i].slide, rules[i])) == spec]
            starts = F.when(k.isin(mine), _covering(size, slide)).otherwise(starts)
        spread = panes.withColumn("start", F.explode(starts)).groupBy(*same, "start", "d").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        whole = spread.groupBy(*same, "start").agg(F.sum("v").alias("v"), F.count("d").alias("values"), F.sum("n").alias("n"))
        distinct = [i for i in windowed if rules[i].family == "having_count_distinct"]
        whole = whole.withColumn("value", F.when(k.isin(distinct), F.col("values").cast("double")).otherwise(F.col("v")))
        passed = ~counted
        for i in windowed:
            passed = passed | ((k == i) & _over(next(iter(rules[i].having.values()), Having()), F.col("value")))
        # equal matches of equal events are as many as they were
        out = whole.where(passed).withColumn("__tw_i", F.explode(F.when(counted, F.array(F.lit(1))).otherwise(F.array_repeat(F.lit(1), F.col("n").cast("int")))))
    sizes = F.element_at(F.array(*[F.lit(_micros(r) if r.family in _WINDOWED else None).cast("bigint") for r in rules]), k + 1)
    value = F.when(k.isin([i for i, r in enumerate(rules) if r.family in (*_WINDOWED, "repeat_then")]), F.col("value"))
    event = lambda side: [F.timestamp_micros(F.col(f"{side}.__tw_t")).alias(f"{side}_ts"), *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in tie]]
    return out.select(F.element_at(F.array(*[F.lit(r.key) for r in rules]), k + 1).alias("rule"), "signature", F.timestamp_micros("start").alias("window_start"), F.timestamp_micros(F.col("start") + sizes).alias("window_end"), value.alias("value"), *event("a"), *event("b"))
