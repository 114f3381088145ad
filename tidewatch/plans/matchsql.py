"""A subset of MATCH_RECOGNIZE as DataFrame plans.

    SELECT * FROM table MATCH_RECOGNIZE (
      PARTITION BY k, … ORDER BY ts
      MEASURES A.x AS ax, FIRST(A.y) AS ay, LAST(A.z) - B.z AS dz, …
      ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW | SKIP TO NEXT ROW
      PATTERN (A B) | (A{n,} B) | (A B+ C{2} D{1,3} …)   WITHIN INTERVAL 'n' UNIT
      DEFINE A AS condition, B AS condition
    ) …

Rows of a match are neighbours, as the standard demands. Conditions are SQL over the
row's own columns (``A.x = 'v'`` in A's definition) and over rows matched before: another
variable's ``A.x`` or ``LAST(A.x)`` is that of its last row so far, ``FIRST(A.x)`` that of its first,
and so for the variable itself, whose ``A.x`` is the row at hand. Measures are SQL
expressions; ``A.x`` of a repeated variable is its last row's.

``(A B)``, ``(A{n,} B)`` and patterns of fixed length whose definitions read other rows are
window plans: in a fixed pattern every variable's rows lie at known distances, and before
a B each A of the run is a possible first, of which the earliest that B's definition
accepts begins the match. Other patterns and other ways to skip go to the automaton,
where a loop takes a row that both it and the next variable want; their definitions
see the row's own columns only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.automaton import Stage, match_pattern
from tidewatch.operators.sequences import Ordered, apart, followed_by, non_overlapping, repeated_then


@dataclass(frozen=True)
class MatchQuery:
    table: str
    keys: tuple[str, ...]
    order: str
    measures: tuple[tuple[str, str], ...]  # expression, alias
    pattern: tuple[tuple[str, int, int | None], ...]  # variable, least and most rows
    skip: str
    within: str | None
    defines: dict[str, str]

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(v for v, _, _ in self.pattern)


def _split(text: str) -> list[str]:
    """Parts between top-level commas."""
    parts, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def _element(text: str) -> tuple[str, int, int | None]:
    m = re.fullmatch(r"(\w+)(?:(\+)|\{(\d+)(,)?(\d+)?\})?", text)
    if not m:
        raise ValueError(f"unsupported pattern element {text}")
    name, plus, low, comma, high = m.groups()
    if plus:
        return name, 1, None
    if low is None:
        return name, 1, 1
    return name, int(low), int(high) if high else None if comma else int(low)


def parse_match(text: str) -> MatchQuery:
    flat = " ".join(text.split())
    m = re.search(r"FROM\s+(\w+)\s+MATCH_RECOGNIZE\s*\((.*)\)", flat, re.I)
    if not m:
        raise ValueError("no MATCH_RECOGNIZE clause")
    table, body = m.groups()
    heads = r"(PARTITION BY|ORDER BY|MEASURES|ONE ROW PER MATCH|AFTER MATCH SKIP|PATTERN|WITHIN|DEFINE)"
    parts = re.split(rf"\b{heads}\b", body, flags=re.I)
    clause = {k.upper(): v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}
    skips = {"PAST LAST ROW": "past_last", "TO NEXT ROW": "next"}
    skip = skips.get(clause.get("AFTER MATCH SKIP", "PAST LAST ROW").upper())
    if skip is None:
        raise ValueError("AFTER MATCH SKIP is PAST LAST ROW or TO NEXT ROW")
    inside = re.match(r"\((.*?)\)", clause["PATTERN"])
    if not inside:
        raise ValueError(f"unsupported pattern {clause['PATTERN']}")
    pattern = tuple(map(_element, re.sub(r"\s*([{},+])\s*", r"\1", inside[1]).replace("}", "} ").replace("+", "+ ").split()))
    if len({v for v, _, _ in pattern}) < len(pattern):
        raise ValueError("a variable stands in the pattern once")
    measures = []
    for part in _split(clause["MEASURES"]):
        x = re.fullmatch(r"(.+)\s+AS\s+`?(\w+)`?", part, re.I)
        if not x:
            raise ValueError(f"unsupported measure {part}")
        measures.append((x[1], x[2]))
    within = re.search(r"INTERVAL\s+'(\d+)'\s+(\w+)", clause.get("WITHIN", ""), re.I)
    defines = {v.strip(): cond.strip() for v, cond in (re.split(r"\s+AS\s+", p, maxsplit=1, flags=re.I) for p in _split(clause["DEFINE"]))}
    return MatchQuery(
        table=table,
        keys=tuple(_split(clause.get("PARTITION BY", ""))),
        order=re.sub(r"\s+ASC$", "", clause["ORDER BY"], flags=re.I),
        measures=tuple(measures),
        pattern=pattern,
        skip=skip,
        within=f"{within[1]} {within[2].lower()}" if within else None,
        defines=defines,
    )


def _outside_quotes(text: str, change: Callable[[str], str]) -> str:
    return "'".join(p if k % 2 else change(p) for k, p in enumerate(text.split("'")))


def _own(condition: str, variable: str) -> str:
    return _outside_quotes(condition, lambda t: re.sub(rf"\b{variable}\.", "", t))


def _measure(text: str, variables: tuple[str, ...]) -> str:
    """The expression over the structs ``__tw_first_<variable>`` and ``__tw_last_<variable>``."""
    name = "|".join(variables)

    def change(t: str) -> str:
        t = re.sub(rf"\b(FIRST|LAST)\s*\(\s*({name})\.`?(\w+)`?\s*\)", lambda m: f"__tw_{m[1].lower()}_{m[2]}.`{m[3]}`", t, flags=re.I)
        return re.sub(rf"(?<![\w.])({name})\.`?(\w+)`?", r"__tw_last_\1.`\2`", t)

    return _outside_quotes(text, change)


def _mentions(condition: str, variables: tuple[str, ...]) -> bool:
    return re.search(rf"\b({'|'.join(variables)})\.", re.sub(r"'[^']*'", "", condition)) is not None if variables else False


def _before(condition: str, variable: str, variables: tuple[str, ...], row: str) -> str:
    """A definition over ``__tw_first_…`` and ``__tw_last_…`` of the rows so far; ``variable`` itself, outside FIRST and LAST, is ``row``."""
    ends = {v: f"__tw_last_{v}" for v in variables}

    def change(t: str) -> str:
        t = re.sub(rf"\b(FIRST|LAST)\s*\(\s*({'|'.join(variables)})\.`?(\w+)`?\s*\)", lambda m: f"\x00__tw_{m[1].lower()}_{m[2]}.`{m[3]}`", t, flags=re.I)
        t = re.sub(rf"(?<![\w.\x00])({'|'.join(variables)})\.`?(\w+)`?", lambda m: f"{row if m[1] == variable else ends[m[1]]}.`{m[2]}`", t)
        return t.replace("\x00", "")

    return _outside_quotes(condition, change)


def _rows_at(t: str, names: dict[str, str]) -> str:
    """``t`` with the names of structs replaced."""
    return _outside_quotes(t, lambda x: re.sub(r"__tw_(?:first|last)_\w+", lambda m: names.get(m[0], m[0]), x))


def _fixed(df: DataFrame, q: MatchQuery, conditions: dict[str, str], tie: tuple[str, ...]) -> DataFrame:
    """Matches of a pattern of fixed length as ``__tw_first_…`` and ``__tw_last_…``: each row with those after it, tested row by row."""
    o = Ordered(df, F.lit(True), F.lit(False), q.keys, q.order, tie, q.within, everything=True)
    event, length = F.struct("__tw_t", *df.columns), sum(low for _, low, _ in q.pattern)
    rows = o.stretched(back=False).select("__tw_k", "__tw_s", "__tw_own", *o.tie, "__tw_t", "__tw_b", event.alias("__tw_r0"))
    rows = rows.withColumns({f"__tw_r{k}": F.lead("__tw_r0", k).over(o.over()) for k in range(1, length)}).where("__tw_own")
    rows = rows.where(F.col(f"__tw_r{length - 1}").isNotNull() & o.valid(F.col("__tw_r0.__tw_t"), F.col(f"__tw_r{length - 1}.__tw_t")))
    at, seen = 0, {}
    for v, low, _ in q.pattern:
        for k in range(at, at + low):
            # before its first row, FIRST of the variable itself is that row; LAST is the row at hand
            names = seen | {f"__tw_first_{v}": f"__tw_r{at}", f"__tw_last_{v}": f"__tw_r{k}"}
            rows = rows.where(F.expr(_rows_at(_before(conditions[v], v, q.variables, f"__tw_r{k}"), names)))
        seen |= {f"__tw_first_{v}": f"__tw_r{at}", f"__tw_last_{v}": f"__tw_r{at + low - 1}"}
        at += low
    if q.skip == "past_last":
        rows = apart(rows, "__tw_k", F.struct("__tw_r0.__tw_t", *[f"__tw_r0.{c}" for c in tie]), F.struct(f"__tw_r{length - 1}.__tw_t", *[f"__tw_r{length - 1}.{c}" for c in tie]))
    return rows.select(*[F.col(c).alias(name) for name, c in seen.items()])


def _loop_then(df: DataFrame, q: MatchQuery, a_test: Column, condition: str, tie: tuple[str, ...]) -> DataFrame:
    """``(A{n,} B)`` where B's definition reads the A's: ``a_…``, ``l_…`` (the last A) and ``b_…``.

    A run of neighbouring A's ends at the next row, the only B that may follow. Each A of the run has it in its row, so
    the definition is tested once for each A as the first.
    """
    (a, low, _), (b, _, _) = q.pattern
    o = Ordered(df, a_test, F.lit(False), q.keys, q.order, tie, q.within, everything=True)
    event = F.struct(*o.carry)
    rows = o.stretched(back=True).withColumn("__tw_n", F.row_number().over(o.over())).withColumn("__tw_l", F.lag(event).over(o.over()))
    end = F.when(~F.col("__tw_a"), F.struct("__tw_n", "__tw_t", F.col("__tw_own").alias("own"), event.alias("b"), F.col("__tw_l").alias("l")))
    rows = rows.withColumn("__tw_e", o.upcoming(end)).where("__tw_a AND __tw_e.own").where(o.valid(F.col("__tw_t"), F.col("__tw_e.__tw_t")))
    rows = rows.where(F.col("__tw_e.__tw_n") - F.col("__tw_n") >= low).withColumn("__tw_f", event)
    names = {f"__tw_first_{a}": "__tw_f", f"__tw_last_{a}": "__tw_e.l", f"__tw_first_{b}": "__tw_e.b", f"__tw_last_{b}": "__tw_e.b"}
    rows = rows.where(F.expr(_rows_at(_before(condition, b, q.variables, "__tw_e.b"), names)))
    found = rows.groupBy("__tw_k", "__tw_s", F.col("__tw_e.__tw_n").alias("__tw_n")).agg(F.min(F.struct("__tw_t", *o.tie, F.col("__tw_f").alias("a"), F.col("__tw_e.l").alias("l"), F.col("__tw_e.b").alias("b"))).alias("m"))
    return found.select(*[F.col(f"m.{side}.{c}").alias(f"{side}_{c}") for side in "alb" for c in o.carry])


def match_recognize(spark: SparkSession, text: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Run a MATCH_RECOGNIZE query over a table or view of the session; keys, then measures."""
    q = parse_match(text)
    df = spark.table(q.table)
    conditions = {v: q.defines.get(v, "true") for v in q.variables}
    related = [v for v in q.variables if _mentions(conditions[v], tuple(x for x in q.variables if x != v))]
    shape = tuple((low, high) for _, low, high in q.pattern)
    pair, loop = shape == ((1, 1), (1, 1)), len(shape) == 2 and shape[0][1] is None and shape[1] == (1, 1) and q.skip == "past_last"
    fixed = all(low == high for low, high in shape)
    reads = [v for v in q.variables if re.search(r"\b(FIRST|LAST)\s*\(", re.sub(r"'[^']*'", "", conditions[v]), re.I)]
    related = related or reads
    if related and fixed and not (pair and related == [q.variables[1]] and not reads):
        rows = _fixed(df, q, conditions, tie)
        return _shown(rows, q)
    if related and not (pair or loop and related == [q.variables[1]]):
        raise ValueError("definitions may read other rows in patterns of fixed length, and B's in (A{n,} B)")
    tests = {v: F.lit(True) if v in related else F.expr(_own(c, v)) for v, c in conditions.items()}
    if pair or loop:
        a, b = q.variables
        if pair:
            found = followed_by(df, tests[a], tests[b], q.keys, q.order, tie, q.within, contiguity="strict")
            if related:
                on = _outside_quotes(conditions[b], lambda t: re.sub(rf"\b{a}\.`?(\w+)`?", r"`a_\1`", re.sub(rf"\b{b}\.`?(\w+)`?", r"`b_\1`", t)))
                found = found.where(F.expr(on))
            if q.skip == "past_last":
                found = non_overlapping(found, q.keys, q.order, tie)
        elif related:
            found = _loop_then(df, q, tests[a], conditions[b], tie)
        else:
            found = repeated_then(df, tests[a], tests[b], shape[0][0], q.keys, q.order, tie, q.within, "strict", last=True)
        side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in df.columns])
        ends = {f"__tw_first_{a}": side("a"), f"__tw_last_{a}": side("l" if loop else "a"), f"__tw_first_{b}": side("b"), f"__tw_last_{b}": side("b")}
    else:
        stages = [Stage(v, tests[v], low, high) for v, low, high in q.pattern]
        found = match_pattern(df, stages, q.keys, q.order, tie, q.within, "strict", q.skip)
        of = lambda v: F.filter("events", lambda e: e["stage"] == v)
        ends = {f"__tw_{end}_{v}": F.element_at(of(v), at)["event"] for v in q.variables for end, at in (("first", 1), ("last", -1))}
    return _shown(found.select(*[c.alias(k) for k, c in ends.items()]), q)


def _shown(rows: DataFrame, q: MatchQuery) -> DataFrame:
    """Keys, then measures."""
    shown = [alias for _, alias in q.measures]
    keys = [F.col(f"__tw_first_{q.variables[0]}.{k}").alias(k) for k in q.keys if k not in shown]
    return rows.select(*keys, *[F.expr(_measure(e, q.variables)).alias(alias) for e, alias in q.measures])
