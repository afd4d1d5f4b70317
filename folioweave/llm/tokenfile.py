"""Token-id files: ORC stripes with integer run-length encoding, row indexes and Bloom filters.

write_tokens() range-partitions documents by doc_id, tokenises each sorted
partition and writes one ORC file of it, so that file and stripe statistics of
doc_id do not overlap. Rows hold ids and their place in the file, `part` and
`part_start`. A file's size follows its range of documents, so no task holds
more than its partition, streamed in Arrow batches. read_tokens() lets Spark
split files at stripes and prunes stripes by statistics and row groups by row
index and Bloom filter when ids are asked for. read_with_start() adds the global
start: sums by part (one row a file) are added up and broadcast; their number is
the number of files, `partitions`, a parameter.

Defined results: null text is the end id alone; null doc_ids come first; equal
doc_ids are ordered by a hash of the text; each row keeps its own entry; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, parallel, small, table, text_or_empty, texts_of, vocabulary, work_folder
from .textvec import encoder

ORC_OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "doc_id long, part int, part_start long, n_ids long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, kind: str = "json_words", end_id: int = 1, partitions: int | None = None) -> None:
    """Write the token ids of all documents, ascending by doc_id, as a folder of ORC files."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path, kind).encode
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in small(whole):
                ids = [np.append(x, np.uint32(end_id)) for x in encode(texts_of(batch))]
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                at = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(start + at[:-1]),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32))),
                    ],
                    ["doc_id", "part", "part_start", "n_ids", "ids"],
                )
                start += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # However many rows share a doc_id, or all they hold, they are split: equal rows by their number in the scan.
    order = [F.col("doc_id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")]
    placed = rows.select("doc_id", "text", *order[1:]).repartitionByRange(partitions or parallel(spark), "doc_id", "hash", "row")
    ordered = placed.sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with doc_ids, only the stripes and row groups that may hold them are read."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def read_with_start(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every row, start counting all ids of the rows before it."""
    rows = read_tokens(spark, path)
    sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    # One row a file: at most as many as the partitions that were written.
    joined = rows.join(F.broadcast(base), "part")
    return joined.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "ids")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids as they were read."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return run

    return map_batches(rows.select("doc_id", "start", "ids"), make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return digests(read_with_start(spark, path))
