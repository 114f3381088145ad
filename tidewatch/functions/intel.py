"""Intelligence groups: named sets of matchers, and membership in them.

A group table has ``group_id, name, type, intelligence_type, content``. A group is
known by its name and by its id. ``ip`` contents are addresses, ranges ``a-b`` or CIDR
blocks ``a/n``; all other types match their exact text, and hash, URL and time contents
can be read as patterns if asked for.

Small groups become literals of the plan. Larger ones stay tables: exact contents are
joined by value, IP ranges by the address's leading bits, and patterns by what their
matches must contain (see ``patterns``), so no join compares every event with every range or
pattern. In SQL texts, and for patterns that demand nothing of a text, pattern
groups of any size are literal expressions.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import patterns
from tidewatch.functions.scalars import ip_bounds, ip_in, ip_number, total

#: Most contents of a group that become literals.
LITERAL_LIMIT = 512
_EXACT = {"time", "num", "string"}
_NARROW_BITS, _WIDE_BITS = 16, 24


def ip_cells(contents: DataFrame) -> DataFrame:
    """The ranges among the ``content`` of ``contents``, as ``lo`` and ``hi``, once for each of the leading ``bits`` (``cell``) that they cover."""
    c = F.col("content")
    low, high = (F.get(F.split(c, "[-/]"), k) for k in (0, 1))
    mask = F.coalesce(high.try_cast("int"), F.lit(0))
    free = F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - F.when(mask.between(0, 32), mask).otherwise(0)) - 1
    base, other = ip_number(low), ip_number(high)
    ranges = contents.where(c.rlike("[-/]")).select(
        "*",
        F.when(c.contains("-"), F.least(base, other)).otherwise(base.bitwiseAND(free.bitwiseXOR(F.lit(0xFFFFFFFF)))).alias("lo"),
        F.when(c.contains("-"), F.greatest(base, other)).otherwise(base.bitwiseOR(free)).alias("hi"),
    )
    wide = (F.col("hi") - F.col("lo")) >= (1 << _WIDE_BITS)
    bits = F.when(wide, F.lit(_WIDE_BITS)).otherwise(_NARROW_BITS)
    return ranges.withColumn("bits", bits).withColumn("cell", F.explode(F.sequence(F.call_function("shiftright", "lo", "bits"), F.call_function("shiftright", "hi", "bits"))))


class IntelGroups:
    """The groups of a table. ``patterns``: read hash contents as partial, URL contents as full regular expressions."""

    def __init__(self, table: DataFrame, patterns: bool = False, literal_limit: int = LITERAL_LIMIT):
        self.table = table.select("group_id", "name", "type", "intelligence_type", "content").where("content IS NOT NULL")
        self.by_pattern, self.limit = patterns, literal_limit
        # one row for each group; the table isn't dealt out for it
        self.kinds = {}
        self.sizes = {}
        for r in self.table.groupBy("group_id", "name", "type", "intelligence_type").agg(F.count("*").alias("rows"), F.approx_count_distinct("content").alias("about")).collect():
            if r["type"] not in _EXACT | {"ip"}:
                raise ValueError(f"group {r['name']} has unknown type {r['type']}")
            for key in {r["name"], r["group_id"]}:
                self.kinds[key] = (r["type"], r["intelligence_type"])
                rows, about = self.sizes.get(key, (0, 0))
                self.sizes[key] = rows + r["rows"], about + r["about"]
        # repeated contents count once: exactly, where the estimate leaves open whether they are few
        for key, (rows, about) in self.sizes.items():
            self.sizes[key] = rows if rows <= self.limit else about if about > 4 * self.limit else self.contents(key).count()

    def reloaded(self, table: DataFrame) -> IntelGroups:
        """The groups of a newer table, with the same settings."""
        return IntelGroups(table, self.by_pattern, self.limit)

    def contents(self, group: str) -> DataFrame:
        return self.table.where((F.col("name") == group) | (F.col("group_id") == group)).select("content").distinct()

    def is_small(self, group: str) -> bool:
        return self.sizes.get(group, 0) <= self.limit

    def member(self, value: Column, group: str) -> Column:
        """Membership as an expression, for small groups; an unknown group has no members."""
        if group not in self.kinds:
            return F.lit(False)
        if not self.is_small(group):
            raise ValueError(f"{group} has {self.sizes[group]} contents: attach it with mark()")
        return self._literal(value, group, [r["content"] for r in self.contents(group).collect()])

    def _literal(self, value: Column, group: str, contents: Iterable[str]) -> Column:
        kind, sub = self.kinds[group]
        contents = sorted(contents)
        if kind == "ip":
            exact = [c for c in contents if ip_bounds(c) is None]
            tests = [ip_in(value, c) for c in contents if ip_bounds(c) is not None]
            return reduce(lambda a, b: a | b, tests, total(value.isin(exact)) if exact else F.lit(False))
        if self._by_pattern(group):
            return self._matches(value, group)
        return total(value.isin(contents))

    def _by_pattern(self, group: str) -> bool:
        kind, sub = self.kinds[group]
        return self.by_pattern and kind == "string" and sub in ("hash", "url")

    def _expressions(self, group: str, contents: DataFrame | None = None) -> list[str]:
        """The contents of a group, or some of them, as regular expressions, each of up to ``LITERAL_LIMIT`` alternatives."""
        contents = sorted(r[0] for r in (self.contents(group) if contents is None else contents).collect())
        blocks = ["|".join(f"(?:{c})" for c in contents[s : s + LITERAL_LIMIT]) for s in range(0, len(contents), LITERAL_LIMIT)]
        return [rf"\A(?:{b})\z" for b in blocks] if self.kinds[group][1] == "url" else blocks

    def _matches(self, value: Column, group: str) -> Column:
        return total(reduce(lambda a, b: a | b, [value.rlike(x) for x in self._expressions(group)]))

    def register_sql(self, name: str = "belong") -> None:
        """Define ``name(value, group)`` for SQL texts; the planner inlines it.

        Small groups are literals. Large ones are temporary views that the function looks into: exact contents by
        value, IP ranges by leading bits.
        """
        quote = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
        number = r"coalesce(aggregate(transform(split(trim(v), '\\.'), x -> try_cast(x AS bigint)), 0L, (s, x) -> shiftleft(s, 8) | x), 0L)"
        cases = []
        for k, (group, (kind, _)) in enumerate(sorted(self.kinds.items())):
            if self._by_pattern(group):
                tests = [f"v RLIKE {quote(x)}" for x in self._expressions(group)]
                cases.append(f"WHEN {quote(group)} THEN {' OR '.join(tests)}")
                continue
            if not self.is_small(group):
                exact, view = self.contents(group), f"__tw_{name}_{k}"
                if kind == "ip":
                    exact = exact.where("NOT content RLIKE '[-/]'")
                    self._cells(group).createOrReplaceTempView(f"{view}_cells")
                exact.createOrReplaceTempView(view)
                tests = [f"EXISTS (SELECT 1 FROM {view} c WHERE c.content = v)"]
                if kind == "ip":
                    tests += [f"EXISTS (SELECT 1 FROM {view}_cells c WHERE c.bits = {bits} AND c.cell = shiftright({number}, {bits}) AND {number} BETWEEN c.lo AND c.hi)" for bits in (_NARROW_BITS, _WIDE_BITS)]
                cases.append(f"WHEN {quote(group)} THEN {' OR '.join(tests)}")
                continue
            contents = sorted(r["content"] for r in self.contents(group).collect())
            bounds = [ip_bounds(c) for c in contents] if kind == "ip" else [None] * len(contents)
            tests = [f"v IN ({', '.join(quote(c) for c, b in zip(contents, bounds, strict=True) if b is None)})"] if None in bounds else []
            tests += [f"{number} BETWEEN {b[0]}L AND {b[1]}L" for b in bounds if b is not None]
            cases.append(f"WHEN {quote(group)} THEN {' OR '.join(tests)}")
        body = f"CASE g {' '.join(cases)} ELSE false END" if cases else "false"
        self.table.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING, g STRING) RETURNS BOOLEAN RETURN coalesce(v IS NOT NULL AND ({body}), false)")

    def mark(self, df: DataFrame, field: str, group: str, flag: str) -> DataFrame:
        """``df`` with the boolean ``flag``: whether ``field`` is in the group, whatever its size."""
        if group not in self.kinds or self.is_small(group):
            return df.withColumn(flag, self.member(F.col(field).cast("string"), group))
        if self.kinds[group][0] == "ip":
            return self._mark_ip(df, field, group, flag)
        if self._by_pattern(group):
            return self._mark_patterns(df, field, group, flag)
        known = self.contents(group).select(F.col("content").alias("__tw_content"), F.lit(True).alias(flag))
        return df.join(known, F.col(field).cast("string") == F.col("__tw_content"), "left").drop("__tw_content").withColumn(flag, total(F.col(flag)))

    def _mark_patterns(self, df: DataFrame, field: str, group: str, flag: str) -> DataFrame:
        by_gram, rest = patterns.index(self.table.where((F.col("name") == group) | (F.col("group_id") == group)).select(F.col("content").alias("pattern")), self.sizes[group])
        hit = patterns.matching(df, field, by_gram, self.kinds[group][1] == "url").select(F.col("text").alias("__tw_text"), F.lit(True).alias(flag))
        value = F.col(field).cast("string")
        tests = [value.rlike(x) for x in self._expressions(group, rest)]
        return df.join(hit, value == F.col("__tw_text"), "left").drop("__tw_text").withColumn(flag, reduce(lambda a, b: a | b, map(total, tests), total(F.col(flag))))

    def _cells(self, group: str) -> DataFrame:
        return ip_cells(self.contents(group)).drop("content")

    def _mark_ip(self, df: DataFrame, field: str, group: str, flag: str) -> DataFrame:
        c, cells = F.col("content"), self._cells(group)
        exact = self.contents(group).where(~c.rlike("[-/]")).select(c.alias("__tw_content"), F.lit(True).alias("__tw_exact"))
        # distinct values of the field only: each is decided once
        values = df.select(F.col(field).cast("string").alias("__tw_value")).where("__tw_value IS NOT NULL").distinct()
        at = values.withColumn("ip", ip_number(F.col("__tw_value"))).withColumn("bits", F.explode(F.array(F.lit(_NARROW_BITS), F.lit(_WIDE_BITS)))).withColumn("cell", F.call_function("shiftright", "ip", "bits"))
        hit = at.join(cells, ["bits", "cell"]).where(F.col("ip").between(F.col("lo"), F.col("hi"))).select("__tw_value")
        hit = hit.union(values.join(exact, values["__tw_value"] == exact["__tw_content"], "left_semi").select("__tw_value")).distinct().withColumn(flag, F.lit(True))
        return df.join(hit, F.col(field).cast("string") == F.col("__tw_value"), "left").drop("__tw_value").withColumn(flag, total(F.col(flag)))
