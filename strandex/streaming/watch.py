"""File events: filter, debounce by session, dispatch, and a single-writer stream into an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import is_indexable

#: A path is quiet for this long before its last event counts; events later than the watermark are dropped.
QUIET, LATE = "300 milliseconds", "10 seconds"


def relevant(events: DataFrame) -> DataFrame:
    """Events whose path, or destination, can be indexed."""
    return events.where(is_indexable(F.col("path")) | F.coalesce(is_indexable(F.col("dest")), F.lit(False)))


def debounce(events: DataFrame, quiet: str = QUIET, order: Column | None = None) -> DataFrame:
    """The last event of each burst of a path: ``path, kind, dest, n, last_ts``.

    A gap of ``quiet`` or more ends a burst.  The same plan serves batches and streams (with a watermark)."""
    by = order if order is not None else F.col("ts")
    bursts = events.groupBy("path", F.session_window("ts", quiet).alias("w"))
    out = bursts.agg(F.max_by(F.struct("kind", "dest"), by).alias("last"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return out.select("path", "last.kind", "last.dest", "n", "last_ts")


def actions(events: DataFrame) -> DataFrame:
    """``path, action``: created and modified paths are indexed, deleted ones removed, a move does both."""
    index, remove = (lambda p: F.struct(p.alias("path"), F.lit("index").alias("action"))), (lambda p: F.struct(p.alias("path"), F.lit("remove").alias("action")))
    todo = (
        F.when(F.col("kind").isin("CREATED", "MODIFIED"), F.array(index(F.col("path"))))
        .when(F.col("kind") == "DELETED", F.array(remove(F.col("path"))))
        .when(F.col("kind") == "MOVED", F.array(remove(F.col("path")), index(F.col("dest"))))
    )
    rows = events.select(F.explode(todo).alias("a")).select("a.*").where("path is not null")
    return rows.where((F.col("action") == "remove") | is_indexable(F.col("path")))


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, late: str = LATE, once: bool = False) -> StreamingQuery:
    """Debounced actions of a stream, one micro-batch at a time, to ``apply(actions, batch id)`` (the single writer)."""
    burst = debounce(relevant(events).withWatermark("ts", late), quiet)
    writer = burst.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply(actions(df), n))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
