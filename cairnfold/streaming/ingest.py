"""Continuous ingest: micro-batches through the same operators as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnfold.api import Engine
from cairnfold.operators import chunking


def ingest(engine: Engine, objects: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Puts a stream of ``bucket, name, body`` into the store, a commit for each micro-batch; without ``every`` it ends
    when all there is has been read. A batch that is played again finds its objects with equal ETags and
    writes nothing, so each object is stored once."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.put(batch)

    writer = objects.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def unique_chunks(objects: DataFrame, size: int) -> DataFrame:
    """A stream of ``namespace, obj_seq, body`` as a stream of the chunks not seen before in their namespace; the
    fingerprints are the state."""
    cut = chunking.fixed_chunks(objects, "body", ["namespace", "obj_seq"], size)
    return cut.dropDuplicates(["namespace", "fp"])


def collect_garbage(engine: Engine, ticks: DataFrame, checkpoint: str, every: str = "1 hour") -> StreamingQuery:
    """Sweeps the deletion queue at each trigger of a stream of ticks (the rate source, or a table of commands)."""

    def sweep(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.gc()

    return ticks.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def upload_sessions(parts: DataFrame, lifetime: str = "1 hour") -> DataFrame:
    """A stream of ``upload_id, part_no, size, at`` as ``upload_id, parts, size, last`` of each session that had no part for
    ``lifetime``; late parts beyond it are left out."""
    own = parts.withWatermark("at", lifetime).groupBy("upload_id", F.session_window("at", lifetime))
    return own.agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.max("at").alias("last")).drop("session_window")
