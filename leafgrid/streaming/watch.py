"""The per-document operators on streams.

All of them but the windows are stateless, so they run in append mode; operators with windows over a
document run inside foreachBatch, where each micro-batch holds whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """New files in a folder as a stream of doc_id and content."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(path)
    return stream.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), "content")


def for_each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run transform on each micro-batch and keep its rows as Parquet, one folder for each batch.

    A repeated batch overwrites its own folder, so results are exact after a restart.
    """

    def sink(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
