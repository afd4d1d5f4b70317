"""Incremental forms: new documents are chunked as they arrive, and the newest state of each job is kept.

Each micro-batch is written by key of the batch, so a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioweave.operators import segment
from folioweave.operators.jobs import latest


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_stream(docs: DataFrame, key: str = "doc_id", limit: int = segment.MAX_SPEECH, least: int = segment.MIN_SPEECH) -> DataFrame:
    """Speech chunks of a stream of documents; stateless, so it needs no watermark."""
    return segment.exploded(docs, segment.speech_chunks(F.col("text"), limit, least), key)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_batch(stream: DataFrame, checkpoint: str, path: str, shape: Callable[[DataFrame], DataFrame] = latest) -> StreamingQuery:
    """Each batch shaped (by default the newest row of each job) and written under its number."""

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
