"""Cost-balanced packing of tokenised documents into training sequences.

A piece of n tokens costs linear * n + quadratic * n**2 (projections and
attention). Descending pieces go to the cheapest sequence that has token
capacity left; where a piece does not fit, it is cut there and its rest goes
to the next cheapest. The sequences of a block are made to measure: with T
tokens there are T // size full ones, and the remainder's binary digits give
sequences of power-of-two lengths, so that no block needs any padding.

Scale: a block is a run of whole documents of one input partition, closed at
`block_tokens`; tokenising and packing happen in the scan's own tasks, without
a shuffle, and memory is bounded by a block plus one document. Blocks
of different partitions never meet; a sequence's id holds partition and number.

Defined results: null text is an empty document (its end id alone); every row
is a document of its own, whatever its doc_id (null and repeated ones too);
an empty table packs to no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import small, table, text_or_empty, texts_of, vocabulary
from .textvec import encoder

SIZE = 1024
BLOCK_TOKENS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


def capacities(tokens: int, size: int = SIZE) -> list[int]:
    """Lengths of the sequences that hold exactly `tokens`: full ones, then powers of two."""
    full, rest = divmod(tokens, size)
    return [size] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], size: int = SIZE, linear: float = 1.0, quadratic: float = 1.0 / SIZE) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (document, start, length, sequence, offset), for documents of the given token counts."""
    room = capacities(sum(lengths), size)
    used = [0] * len(room)
    heap = [(0.0, k) for k in range(len(room))]
    pieces = [(min(size, n - at), i, at) for i, n in enumerate(lengths) for at in range(0, n, size)]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    out = []
    for left, doc, at in pieces:
        while left:
            cost, k = heap[0]
            n = min(left, room[k] - used[k])
            out.append((doc, at, n, k, used[k]))
            used[k] += n
            if used[k] == room[k]:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (cost + linear * n + quadratic * n * n, k))
            left, at = left - n, at + n
    return out


def pack_documents(docs: DataFrame, path: str, kind: str = "json_spaced", end_id: int = 0, size: int = SIZE, block_tokens: int = BLOCK_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence; with_ids adds each piece's token ids."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind).encode
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, tokens
            placed = assign([len(x) for _, x in held], size, linear, quadratic)
            total: dict[int, list] = {}
            for _, _, n, k, _ in placed:
                was = total.setdefault(k, [0, 0.0])
                was[0] += n
                was[1] += linear * n + quadratic * n * n
            cuts = [held[d][1][at : at + n] for d, at, n, _, _ in placed]
            columns = [
                pa.array([held[d][0] for d, *_ in placed], pa.int64()),
                pa.array([p[1] for p in placed], pa.int64()),
                pa.array([p[2] for p in placed], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cuts], pa.int64()),
                pa.array([len(held[d][1]) for d, *_ in placed], pa.int64()),
                pa.array([number + p[3] for p in placed], pa.int64()),
                pa.array([p[4] for p in placed], pa.int64()),
                pa.array([total[p[3]][0] for p in placed], pa.int64()),
                pa.array([total[p[3]][1] for p in placed], pa.float64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cost"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32())))
                names.append("ids")
            number += len(total)
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for whole in batches:
            for batch in small(whole):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch)), strict=True):
                    held.append((doc_id, np.append(ids, np.uint32(end_id))))
                    tokens += len(ids) + 1
                    if tokens >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.drop("cost")
