"""Intelligence groups with the time in which each version held.

Groups change by messages ``module;ids;op``: a group is added, edited (renamed, retyped)
or deleted, or its contents are edited. Kept as a log with what each message found in
the store, they give the versions of every group, and an event is tested with the
version of its own time: replayed over old events the flags are what they were, in a batch and
in a stream, however late the log is read.

An event meets each version of a content in one row: the log's side of the join is gathered
by content, or by leading address bits, into the spans in which it held, whose number is
that of the changes and not of the events. So no event is copied, and streams need
no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.intel import _NARROW_BITS, _WIDE_BITS, ip_cells
from tidewatch.functions.scalars import ip_number

CONTENTS, GROUP = "intelligence", "intelligence_group"
_KNOWN = ((CONTENTS, "edit"), (GROUP, "add"), (GROUP, "edit"), (GROUP, "delete"))


def parsed(messages: DataFrame, message: str = "message") -> DataFrame:
    """``module;ids;op`` as a row for each id: ``module``, ``group_id``, ``op``. Messages of another form raise an error when read."""
    parts = F.split(F.col(message), ";")
    known = F.lit(False)
    for module, op in _KNOWN:
        known = known | ((F.get(parts, F.lit(0)) == module) & (F.get(parts, F.lit(2)) == op) & (F.size(parts) == 3))
    ids = F.array_distinct(F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda x: F.trim(x)))
    checked = F.when(F.coalesce(known, F.lit(False)), ids).otherwise(F.raise_error(F.concat(F.lit("unexpected message: "), F.coalesce(F.col(message), F.lit("null")))).cast("array<string>"))
    return messages.withColumns({"module": F.get(parts, F.lit(0)), "op": F.get(parts, F.lit(2)), "group_id": F.explode(checked)})


def versions(log: DataFrame) -> DataFrame:
    """``group_id, name, type, intelligence_type, contents, valid_from, valid_to`` (null: still) of each version.

    ``log`` has ``at``, ``module``, ``group_id``, ``op``, and of the store as the message found it ``name``, ``type``,
    ``intelligence_type`` (for messages about groups) and ``contents`` (about contents). Messages of one time are taken
    in the order of add, edit, contents, delete. A deleted group has no version until it is added again, and then no contents until these are
    edited; contents of an unknown group are ignored.
    """
    rank = F.when(F.col("op") == "delete", 3).when(F.col("module") == CONTENTS, 2).when(F.col("op") == "edit", 1).otherwise(0)
    rows = log.withColumn("rank", rank)
    order = Window.partitionBy("group_id").orderBy("at", "rank")
    gone = F.sum((F.col("op") == "delete").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("life", F.coalesce(gone, F.lit(0))).withColumn("valid_to", F.lead("at").over(order))
    life = Window.partitionBy("group_id", "life").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    about = F.when(F.col("module") == GROUP, F.struct("name", "type", "intelligence_type"))
    rows = rows.withColumn("info", F.last(about, ignorenulls=True).over(life))
    own = F.when((F.col("module") == CONTENTS) & F.col("info").isNotNull(), F.coalesce("contents", F.array().cast("array<string>")))
    rows = rows.withColumn("held", F.last(own, ignorenulls=True).over(life))
    rows = rows.where("op <> 'delete' AND info IS NOT NULL AND held IS NOT NULL AND (valid_to IS NULL OR valid_to > at)")
    return rows.select("group_id", "info.*", F.col("held").alias("contents"), F.col("at").alias("valid_from"), "valid_to")


class VersionedGroups:
    """The groups of a log of changes, see ``versions``."""

    def __init__(self, log: DataFrame):
        self.versions = versions(log)

    def _contents(self, group: str) -> DataFrame:
        mine = self.versions.where((F.col("name") == group) | (F.col("group_id") == group))
        return mine.select("type", F.explode("contents").alias("content"), F.struct("valid_from", "valid_to").alias("span"))

    def mark(self, df: DataFrame, ts: str, field: str, group: str, flag: str) -> DataFrame:
        """``df`` with the boolean ``flag``: whether ``field`` was in the group, by name or id, at the time ``ts``. Without a time or a value: false."""
        t, value = F.col(ts).cast("timestamp"), F.col(field).cast("string")
        held = lambda s: (t >= s["valid_from"]) & (s["valid_to"].isNull() | (t < s["valid_to"]))
        rows = self._contents(group)
        ranged = (F.col("type") == "ip") & F.col("content").rlike("[-/]")
        exact = rows.where(~ranged).groupBy(F.col("content").alias("__tw_content")).agg(F.collect_list("span").alias("__tw_spans"))
        out = df.join(exact, value == F.col("__tw_content"), "left")
        hit: Column = F.exists(F.coalesce("__tw_spans", F.array().cast(exact.schema["__tw_spans"].dataType)), held)
        cells = ip_cells(rows.where(F.col("type") == "ip")).select("bits", "cell", F.struct("lo", "hi", "span.*").alias("r"))
        number = ip_number(value)
        for bits in (_NARROW_BITS, _WIDE_BITS):
            own = cells.where(F.col("bits") == bits).groupBy(F.col("cell").alias(f"__tw_c{bits}")).agg(F.collect_list("r").alias(f"__tw_r{bits}"))
            out = out.join(own, (F.call_function("shiftright", number, F.lit(bits)) == F.col(f"__tw_c{bits}")) & value.isNotNull(), "left")
            ranges = F.coalesce(f"__tw_r{bits}", F.array().cast(own.schema[f"__tw_r{bits}"].dataType))
            hit = hit | F.exists(ranges, lambda r: number.between(r["lo"], r["hi"]) & held(r))
        return out.select(*df.columns, F.coalesce(hit & t.isNotNull(), F.lit(False)).alias(flag))
