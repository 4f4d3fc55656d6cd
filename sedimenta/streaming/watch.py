"""Evidence that keeps arriving: a folder of files as a stream of chunks, scanned as they come.

Spark's streaming checkpoint takes the place of a checkpoint document.  No state is kept between batches but that of drop_seen().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.evidence import plan_chunks


def watch_folder(spark: SparkSession, folder: str, chunk: int = 16 << 20, overlap: int = 64 << 10, files_per_batch: int = 100) -> DataFrame:
    """Chunk rows of the files in a folder, each once.  For files of up to Spark's binary limit (2 GB); larger images are read in batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = plan_chunks(files.select(F.col("path").alias("evidence"), F.col("length").alias("total"), "content", "modificationTime"), chunk, overlap)
    return rows.select("evidence", "chunk_id", "start", "length", "valid_length", F.substring("content", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("data"), F.col("modificationTime").alias("seen_at"))


def drop_seen(rows: DataFrame, key: str, time: str = "seen_at", delay: str = "1 day") -> DataFrame:
    """Rows whose key has not come before; keys are forgotten after the delay, so state stays bounded."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_once(rows: DataFrame, sink, checkpoint: str):
    """Everything that is there now, in batches; ``sink`` gets (rows, batch id) and may be called again for a batch after a failure."""
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
