"""FOLLOWED BY and NOT FOLLOWED BY over streams as joins of a stream with itself.

A and B are two sides of one stream, joined by key, by related fields and by the time
limit.

FOLLOWED BY wants one B for each A. An interval join would make a pair for each B in an
A's limit, and look through all B's of the key for it, so its work grew with the square
of the events; each side is taken in event order by ``stateful`` instead, where a B ends
the A's that wait for it, so an A meets one B.

NOT FOLLOWED BY is an outer interval join without Python: both sides have the stream's
watermark, so Spark keeps an A until the watermark has passed its limit and a B as long
as an A that is still to come may reach back to it, and emits the A's that stayed alone.
It still makes all pairs, so it suits rules whose related fields or keys leave few B's
in the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import total
from tidewatch.operators import sequences
from tidewatch.operators.windows import millis
from tidewatch.streaming import stateful


def _keyed(keys: Sequence[str], relation: Sequence[tuple[str, str]]) -> None:
    if not keys and not relation:
        raise ValueError("a join needs a key or related fields")


def _sides(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int, relation: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame, Column]:
    """A's, B's and what joins them. Event times stay plain columns, as their watermark goes with them."""

    def side(test: Column, name: str, at: int) -> DataFrame:
        related = [F.lower(F.col(r[at]).cast("string")).alias(f"__tw_{name}r{k}") for k, r in enumerate(relation)]
        same = [F.coalesce(F.col(k).cast("string"), F.lit("None")).alias(f"__tw_{name}k{k_}") for k_, k in enumerate(keys)]
        # a test that isn't deterministic stays above the watermark, so that all events move time
        return df.where((total(test) & F.col(ts).isNotNull()) | (F.rand() + F.rand() < 0)).select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns], *same, *related)

    joined = [F.col(f"__tw_a{c}{k}") == F.col(f"__tw_b{c}{k}") for c, n in (("k", len(keys)), ("r", len(relation))) for k in range(n)]
    _keyed(keys, relation)
    limit = F.expr(f"INTERVAL '{millis(within) / 1000:.3f}' SECOND")
    on = (F.col(f"b_{ts}") >= F.col(f"a_{ts}")) & (F.col(f"b_{ts}") < F.col(f"a_{ts}") + limit)
    place = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in (ts, *tie)])
    on = on & (place("b") > place("a"))
    for c in joined:
        on = on & c
    return side(a, "a", 0), side(b, "b", 1), on


def followed_by_join(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int, relation: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Each A with the first B after it in the limit: ``a_…`` and ``b_…``. Equal A's, ``tie`` included, are one."""
    _keyed(keys, relation)
    if not df.isStreaming:
        return sequences.followed_by(df.distinct(), a, b, keys, ts, tie, within, relation=relation)
    timed = F.col(ts).isNotNull()
    found = stateful.followed_by_stream(df, a & timed, b & timed, keys, ts, tie, within, relation=relation, once=True)
    return stateful.typed(found, df, "a", "b").drop("signature", "times")


def not_followed_by_join(df: DataFrame, a: Column, b: Column, keys: Sequence[str], ts: str, tie: Sequence[str], within: str | int, relation: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Each A without a B in the limit after it, with its own columns, once the watermark has passed the limit. An A whose related field is missing has no B."""
    left, right, on = _sides(df, a, b, keys, ts, tie, within, relation)
    alone = left.join(right.withColumn("__tw_met", F.lit(True)), on, "left_outer").where(F.col("__tw_met").isNull())
    return alone.select(*[F.col(f"a_{c}").alias(c) for c in df.columns])
