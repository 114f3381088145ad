"""Where results go. Batch and streaming DataFrames are written by the same calls; a stream returns its running query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Operators of a plan that put several rows together, or carry something from one to the next.
_TOGETHER = {"Aggregate", "Window", "Sort", "Deduplicate", "Distinct", "GlobalLimit", "SessionWindow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInPandas", "MapInArrow"}


def _write(df: DataFrame, form: str, name: str | None = None, checkpoint: str | None = None, mode: str = "append", once: bool = False, **options: str) -> StreamingQuery | None:
    if not df.isStreaming:
        writer = df.write.format(form).options(**options)
        (writer.mode("append") if form not in ("noop", "console") else writer.mode("overwrite")).save()
        return None
    writer = df.writeStream.format(form).outputMode(mode).options(**options)
    writer = writer.queryName(name) if name else writer
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


def as_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """``value``: each row as JSON text; ``key`` if a column is named for it."""
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))


def kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None, key: str | None = None, **options: str) -> StreamingQuery | None:
    """JSON records to a topic; a stream goes on from its checkpoint when it is started again."""
    return _write(as_json(df, key), "kafka", checkpoint=checkpoint, **{"kafka.bootstrap.servers": servers, "topic": topic, **options})


def console(df: DataFrame, **settings) -> StreamingQuery | None:
    return _write(df, "console", **settings)


def discard(df: DataFrame, **settings) -> StreamingQuery | None:
    """Evaluate every row and keep none: for measurements."""
    return _write(df, "noop", **settings)


def memory(df: DataFrame, name: str, mode: str = "append", once: bool = True) -> StreamingQuery | None:
    """A stream's rows as the session's table ``name``; a batch becomes a view."""
    if not df.isStreaming:
        df.createOrReplaceTempView(name)
        return None
    return _write(df, "memory", name=name, mode=mode, once=once)


def files(df: DataFrame, path: str, checkpoint: str | None = None, form: str = "parquet", **settings) -> StreamingQuery | None:
    return _write(df, form, checkpoint=checkpoint, path=path, **settings)


def search_index(df: DataFrame, index: str, **options: str) -> StreamingQuery | None:
    """Documents of a search engine, through its own Spark connector if that is on the class path."""
    try:
        return _write(df, "es", path=index, **options)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e):
            raise NotImplementedError("the search engine's connector isn't on the class path") from e
        raise


def side_outputs(df: DataFrame, sides: dict[str, Column], write: Callable[[DataFrame, str], object]) -> dict[str, object]:
    """Each named condition's rows to their own output; a row may go to several, or to none."""
    return {name: write(df.where(F.coalesce(test, F.lit(False))), name) for name, test in sides.items()}


def _by_row(out: DataFrame, batch: DataFrame) -> bool:
    """Whether nothing on the way from the batch to the result puts several of its rows together; what is looked up stands on the other side of a join."""

    def met(df: DataFrame) -> int:
        node, n = df._jdf.queryExecution().analyzed(), 0
        while not node.children().isEmpty():
            n += node.nodeName() in _TOGETHER
            node = node.children().head()
        return n

    return met(out) <= met(batch)


def fan_out_batches(df: DataFrame, plans: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[DataFrame, str, int], None], checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Many plans over one stream, which is read once: each micro-batch is kept while the plans run over it.

    A plan sees one micro-batch, so it may filter, project and look things up; one that aggregates, sorts or keeps
    state would forget all others and is refused. A plan is made anew for each micro-batch and may read its groups anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, plan in plans.items():
                out = plan(batch)
                whole = batch.isEmpty() or _by_row(out, batch)
                if not whole:
                    raise ValueError(f"{name} looks further than one micro-batch: run it as a stream of its own")
                write(out, name, number)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(availableNow=True) if once else writer).start()
