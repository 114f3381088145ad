"""Rules and jobs to plans.

``compile_rule`` turns one rule into a DataFrame over an event DataFrame. The same call
serves batch and streams and gives the same columns: over a stream the sequence
families become stateful operators, over a batch window plans. ``one_pass`` puts many
filters and windowed rules over one reading of the events. ``Job`` puts sources, rules
and sinks together, as the declarative form of an application.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import predicates
from tidewatch.functions.intel import IntelGroups
from tidewatch.functions.scalars import as_number, group_signature
from tidewatch.operators import sequences, windows
from tidewatch.operators.automaton import Stage, match_pattern
from tidewatch.plans.rules import Having, Rule
from tidewatch.streaming import stateful

FAMILIES = ("having_any", "having_count", "having_count_distinct", "having_sum", "followed_by", "not_followed_by", "not_before", "repeat_then", "repeat_until")


class Tests:
    """Compiles a rule's predicates over one DataFrame; large intelligence groups are attached to it once, as flags."""

    def __init__(self, df: DataFrame, texts: list[str], groups: IntelGroups | None, raw: str | None = None):
        self.trees = {t: predicates.parse(t) for t in texts if t}
        self.flags: dict[tuple[str, str], str] = {}
        self.df = df
        for name, group in sorted(set().union(*map(predicates.groups, self.trees.values()), set())):
            if groups is not None and not groups.is_small(group):
                flag = f"__tw_in{len(self.flags)}"
                self.df = groups.mark(self.df, name, group, flag)
                self.flags[name, group] = flag
        self.find, self.groups = predicates.resolver(self.df, raw), groups

    def __getitem__(self, text: str) -> Column:
        return self._compiled(text, False)

    def condition(self, text: str) -> Column:
        """The test for a filter."""
        return self._compiled(text, True)

    def _compiled(self, text: str, as_filter: bool) -> Column:
        if not text:
            return F.lit(True)
        return predicates.compile_predicate(self._flagged(self.trees[text]), self._find, self.groups.member if self.groups else None, as_filter)

    def _flagged(self, tree):
        match tree:
            case predicates.Compare(f, "belong", g) if (f, g) in self.flags:
                return predicates.Compare(self.flags[f, g], "=", "true")
            case predicates.Not(c):
                return predicates.Not(self._flagged(c))
            case predicates.And(cs) | predicates.Or(cs):
                return type(tree)(tuple(map(self._flagged, cs)))
        return tree

    def _find(self, name: str):
        return self.find(name)


def compile_rule(rule: Rule, events: DataFrame, ts: str = "ts", tie: tuple[str, ...] = ("event_id",), groups: IntelGroups | None = None, raw: str | None = None) -> DataFrame:
    """The matches of a rule."""
    tests = Tests(events, [*(e.filter for e in rule.events), rule.where], groups, raw)
    df, names = tests.df, events.columns
    if rule.where:
        df = df.where(tests.condition(rule.where))
    test = [tests[e.filter] for e in rule.events]
    within = rule.window.interval if rule.window else None
    slide = rule.slide.interval if rule.slide else None
    match rule.family:
        case "having_any":
            out = windows.having_any(df, tests.condition(rule.events[0].filter)).select(*names)
        case "having_count" | "having_count_distinct" | "having_sum":
            out = _windowed(rule, df.where(tests.condition(rule.events[0].filter)), ts, within, slide)
        case other if other not in FAMILIES:
            raise ValueError(f"unknown family {other}; known: {', '.join(FAMILIES)}")
        case _:
            flagged = df.select(*names, *_flags(test))
            out = (_in_stream if df.isStreaming else _in_batch)(rule, flagged, names, ts, tie, within)
    out = out.select(*[c for c in out.columns if "__tw_" not in c])
    return _alert(rule, _selected(rule, out))


def _in_batch(rule: Rule, df: DataFrame, names: list[str], ts: str, tie: tuple[str, ...], within: str | None) -> DataFrame:
    a, b, keys, n = F.col("__tw_0"), F.col("__tw_1"), rule.groupBy, rule.patternRepeat.low
    match rule.family:
        case "followed_by":
            return sequences.followed_by(df, a, b, keys, ts, tie, within, rule.skip, rule.contiguity, rule.relation)
        case "not_followed_by":
            return sequences.not_followed_by(df, a, b, keys, ts, tie, within, relation=rule.relation)
        case "not_before":
            return sequences.not_before(df, a, b, ts, tie, within, keys, keys, rule.silence)
        case "repeat_then":
            return sequences.repeated_then(df, a, b, n, keys, ts, tie, within, rule.contiguity, rule.relation)
        case "repeat_until" if within is None and rule.contiguity != "strict":
            found = sequences.repeated_until(df.select(*names, "__tw_0", "__tw_1"), a, b, n, keys, ts, tie)
            event = lambda e: F.struct(F.lit(rule.events[0].alias).alias("stage"), F.struct(*[e[c].alias(c) for c in names]).alias("event"))
            return found.withColumn("events", F.transform("events", event))
        case _:
            return match_pattern(df, [Stage(rule.events[0].alias, a, n, None, until=b)], keys, ts, tie, within, rule.contiguity)


def _in_stream(rule: Rule, df: DataFrame, names: list[str], ts: str, tie: tuple[str, ...], within: str | None) -> DataFrame:
    a, b, keys, n = F.col("__tw_0"), F.col("__tw_1"), rule.groupBy, rule.patternRepeat.low
    match rule.family:
        case "followed_by":
            return stateful.typed(stateful.followed_by_stream(df, a, b, keys, ts, tie, within, rule.skip, rule.contiguity, rule.relation), df, "a", "b").drop("signature", "times")
        case "not_followed_by":
            alone = stateful.typed(stateful.not_followed_by_stream(df, a, b, keys, ts, tie, within, rule.relation), df, "a")
            return alone.select(*[F.col(f"a_{c}").alias(c) for c in names])
        case "not_before":
            found = stateful.typed(stateful.not_before_stream(df, a, b, ts, tie, within, keys, keys, rule.silence), df, "b", "a")
            return found.select(*[c for c in found.columns if c not in ("signature", "times")], "signature")
        case "repeat_then":
            return stateful.typed(stateful.repeated_then_stream(df, a, b, n, keys, ts, tie, within, rule.contiguity, rule.relation), df, "a", "b").drop("signature")
        case _:
            stage = Stage(rule.events[0].alias, a, n, None, until=b)
            found = stateful.match_stream(df, [stage], keys, ts, tie, within, "past_last", rule.contiguity, ("match",))
            return stateful.typed_events(found, df.select(*names))


def _flags(tests: list[Column]) -> list[Column]:
    return [t.alias(f"__tw_{k}") for k, t in enumerate(tests)]


def _windowed(rule: Rule, df: DataFrame, ts: str, size: str, slide: str | None) -> DataFrame:
    (name, h), *rest = rule.having.items() or [("cnt", Having())]
    if rest:
        raise ValueError("a windowed rule has one threshold")
    match rule.family:
        case "having_count":
            out = windows.having_count(df, rule.groupBy, ts, size, slide, value=name)
        case "having_sum":
            out = windows.having_sum(df, rule.groupBy, ts, h.field, size, slide, value=name)
        case _:
            out = windows.having_count_distinct(df, rule.groupBy, ts, h.field, size, slide, value=name)
    return out.where(_over(h, F.col(name)))


def _selected(rule: Rule, out: DataFrame) -> DataFrame:
    """The rule's own columns, if it names any: ``alias.field`` is column ``alias_field`` of a match, or ``field`` itself."""
    if not rule.selects:
        return out
    shown = []
    sides = {e.alias: s for e, s in zip(rule.events, "ab", strict=False)}
    for s in rule.selects:
        if not s.text():
            continue
        if s.attr is None:
            c = F.expr(s.constant().removesuffix("F")) if s.constType.lower() in ("float", "double") else F.expr(s.constant())
        else:
            name = f"{sides.get(s.attr.alias, '')}_{s.attr.attrField}"
            c = F.col(name if name in out.columns else s.attr.attrField)
            c = F.expr(f"{s.fn}(`{name if name in out.columns else s.attr.attrField}`)") if s.fn else c
        shown.append(c.alias(s.alias or (s.attr.attrField if s.attr else "const")))
    return out.select(*shown)


def _alert(rule: Rule, out: DataFrame) -> DataFrame:
    """Alert columns, for rules that raise one; the key joins those of the key columns that the matches have."""
    if not rule.alert.enabled:
        return out
    a = rule.alert
    out = out.withColumns({"alarm_name": F.lit(rule.name), "alarm_level": F.lit(a.level), "alarm_stage": F.lit(a.stage), "alarm_content": F.lit(a.content), "alarm_advice": F.lit(a.advice)})
    parts = [F.col(c).cast("string") for c in a.alarmKey if c in out.columns]
    return out.withColumn("alarm_key", F.md5(F.concat_ws(",", *parts).cast("binary")))


def one_pass(rules: list[Rule], events: DataFrame, ts: str = "ts", groups: IntelGroups | None = None, raw: str | None = None) -> DataFrame:
    """Filters and windowed rules over one reading of the events: ``rule`` (its key), ``signature``, ``window_start``, ``window_end`` and ``value`` of each match.

    An event is copied once for each rule whose test it passes, and rules with the same windows are aggregated
    together, so the number of scans and shuffles doesn't grow with that of the rules. A filter's matches have no
    window, and their signature is made of its ``groupBy``. Distinct counts are not among the families.
    """
    tests = Tests(events, [t for r in rules for t in (r.events[0].filter, r.where)], groups, raw)
    shape: dict[tuple, list[int]] = {}
    parts = []
    for k, r in enumerate(rules):
        if r.family not in ("having_any", "having_count", "having_sum"):
            raise ValueError(f"{r.family} doesn't share a pass")
        h = next(iter(r.having.values()), Having())
        spec = None if r.family == "having_any" else (r.window.interval, r.slide.interval if r.slide else None)
        number = F.coalesce(as_number(F.col(h.field)), F.lit(0.0)) if r.family == "having_sum" else F.lit(1.0)
        shape.setdefault(spec, []).append(k)
        parts.append(F.when(tests.condition(r.events[0].filter) & tests.condition(r.where), F.struct(F.lit(k).alias("k"), group_signature([F.col(c) for c in r.groupBy]).alias("signature"), number.alias("v"))))
    hit = tests.df.select(F.col(ts), F.explode(F.array_compact(F.array(*parts))).alias("x")).select(ts, "x.*")
    out = []
    for spec, members in shape.items():
        mine = hit.where(F.col("k").isin(members))
        if spec is None:
            out.append(mine.select("k", "signature", F.lit(None).cast("timestamp").alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"), F.col("v").alias("value")))
            continue
        counted = windows.having_sum(mine, ["k", "signature"], ts, "v", *spec, value="value").withColumn("k", F.col("k").cast("int"))
        passed = F.lit(False)
        for k in members:
            passed = passed | ((F.col("k") == k) & _over(next(iter(rules[k].having.values()), Having()), F.col("value")))
        out.append(counted.where(passed).select("k", "signature", "window_start", "window_end", "value"))
    found = reduce(DataFrame.unionByName, out)
    return found.select(F.element_at(F.array(*[F.lit(r.key) for r in rules]), F.col("k") + 1).alias("rule"), "signature", "window_start", "window_end", "value")


def _over(h: Having, c: Column) -> Column:
    return {">": c > h.value, ">=": c >= h.value, "<": c < h.value, "<=": c <= h.value, "=": c == h.value}[h.op]


def fan_out(rules: list[Rule], events: DataFrame, **settings) -> dict[str, DataFrame]:
    """Several rules over one event table, each a plan of its own, by its key; see ``one_pass`` for many."""
    return {r.key: compile_rule(r, events, **settings) for r in rules}


@dataclass
class Job:
    """Sources, rules and sinks by name. ``build`` checks that everything needed is named."""

    sources: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    rules: list[tuple[str, Rule, str]] = field(default_factory=list)  # source, rule, sink
    sinks: dict[str, Callable[[DataFrame, str], object]] = field(default_factory=dict)

    def source(self, name: str, read: Callable[[SparkSession], DataFrame]) -> Job:
        self.sources[name] = read
        return self

    def rule(self, source: str, rule: Rule, sink: str) -> Job:
        self.rules.append((source, rule, sink))
        return self

    def sink(self, name: str, write: Callable[[DataFrame, str], object]) -> Job:
        self.sinks[name] = write
        return self

    def build(self, spark: SparkSession, **settings) -> dict[str, DataFrame]:
        for source, rule, sink in self.rules:
            if source not in self.sources or sink not in self.sinks:
                raise ValueError(f"rule {rule.name}: no source {source} or no sink {sink}")
        read = {name: f(spark) for name, f in self.sources.items()}
        return {rule.key: compile_rule(rule, read[source], **settings) for source, rule, _ in self.rules}

    def run(self, spark: SparkSession, **settings) -> dict[str, object]:
        """What each rule's sink returns, such as a running query."""
        plans = self.build(spark, **settings)
        return {rule.key: self.sinks[sink](plans[rule.key], rule.key) for _, rule, sink in self.rules}
