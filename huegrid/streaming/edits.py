"""Edit streams: (seq, generation, layer_idx, param) with the newest edit of each layer winning.

Edits of generations older than the newest seen are stale.  A layer's edit
also calls for every union layer to be recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(edits: DataFrame) -> DataFrame:
    """The newest edit of each layer of each generation."""
    return edits.groupBy("generation", "layer_idx").agg(F.max_by("param", "seq").alias("param"), F.max("seq").alias("seq"), F.count("*").alias("edits"))


def current(edits: DataFrame) -> DataFrame:
    """The newest edits of the newest generation alone."""
    newest = edits.agg(F.max("generation").alias("_g"))
    return latest(edits.join(F.broadcast(newest), F.col("generation") == F.col("_g"), "left_semi"))


def cascade(changed: DataFrame, unions: DataFrame) -> DataFrame:
    """Layers to recompute (layer_idx, pass): the changed ones, then all union layers if any other layer changed."""
    first = changed.join(unions, "layer_idx", "left_anti").select("layer_idx").distinct().withColumn("pass", F.lit(1))
    trigger = F.broadcast(first.limit(1).select(F.lit(1).alias("_")))
    second = unions.select("layer_idx").join(trigger, F.lit(True), "left_semi").unionByName(changed.join(unions, "layer_idx", "left_semi").select("layer_idx")).distinct()
    return first.unionByName(second.withColumn("pass", F.lit(2)))


def stream_latest(edits: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """The running result of latest() over a stream, in complete mode in a memory table (small: a row a layer and generation)."""
    writer = latest(edits).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_upsert(edits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's newest edits as Parquet under path/batch=N; a repeated batch replaces its own files, so the sink is idempotent."""

    def write(batch: DataFrame, n: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(written: DataFrame) -> DataFrame:
    """One newest row a generation and layer from the micro-batches' rows."""
    return written.groupBy("generation", "layer_idx").agg(F.max_by("param", "seq").alias("param"), F.max("seq").alias("seq"), F.sum("edits").alias("edits"))
