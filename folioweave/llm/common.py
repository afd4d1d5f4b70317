"""What the operators share: the shared work folder, materialised tables, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the files are installed with the Python environment of every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Only a local session without that setting, as in tests, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "folioweave")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose per-batch function is made once a task, on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                for part in small(batch):
                    yield f(part)

    return df.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and of about `size` bytes of text, so that Python objects of few texts live at once."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(weight)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def parallel(spark: SparkSession) -> int:
    """Partitions for a wide exchange; the session's setting is sized to the input by whoever runs the job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fingerprint(*cols) -> list:
    """Two 64-bit hashes over the same columns, 128 bits together, as columns h1 and h2."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]
