"""Longest-processing-time sharding: groups of equal texts stay together, shards get near-equal bytes.

Sizes of groups are summed by a 128-bit text fingerprint (partial sums first,
so a group of a third of all rows is a few rows a task). Groups of at least
1/UNITS of all bytes are units of their own: there are at most UNITS of them.
All smaller groups are bundled by fingerprint into UNITS bundles. Units sorted
by size, descending, go to the least-loaded shard through a heap; the driver
never holds more than 2 * UNITS sizes, whatever the input. Bundling is what keeps
the driver's list bounded and departs from scheduling every group by itself: two
shards' loads differ by at most the largest unit, which is a group of over 1/UNITS
of all bytes or a bundle, on average of 1/UNITS.

Slots are gapless in each shard without ordering a shard in one task: rows are
dealt to UNITS / 8 cells a shard by a hash, cells are counted (at most
shards * UNITS counts) and numbered, and a window ranks rows in a cell.

Defined results: null text has size 1 and forms a group; equal rows get
different slots; null doc_ids come first in their cell; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fingerprint, materialised, table, text_or_empty

UNITS = 4096


def schedule(sizes: list[tuple[int, tuple]], shards: int) -> dict[tuple, int]:
    """Shard of each unit: descending sizes to the least-loaded shard; ties by unit key, then shard number."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, unit in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out[unit] = k
    return out


def assign_shards(docs: DataFrame, shards: int = 8, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *fingerprint(text),
    )
    # A doc_id or a row may be repeated any number of times, so its number in the scan takes part; stored, it is the same for all that follows.
    cell = F.pmod(F.xxhash64("doc_id", "h1", F.monotonically_increasing_id()), F.lit(units // 8)).cast("int")
    rows = materialised(rows.withColumn("cell", cell), "sizes")
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    limit = total // units + 1
    bundle = F.pmod(F.col("h1"), F.lit(units)).cast("long")
    heavy = F.col("bytes") >= limit
    units_df = groups.groupBy(
        F.when(heavy, F.col("h1")).otherwise(bundle).alias("u1"),
        F.when(heavy, F.col("h2")).alias("u2"),
    ).agg(F.sum("bytes").alias("bytes"))
    # At most `units` heavy groups, as each has a share of 1/units, and `units` bundles.
    found = [(r["bytes"], (r["u1"], r["u2"] is not None, r["u2"] or 0)) for r in units_df.collect()]
    place = schedule(found, shards)
    big = [(u1, u2, k) for (u1, own, u2), k in place.items() if own]
    rest = {u1: k for (u1, own, _), k in place.items() if not own}
    by_bundle = F.array(*[F.lit(rest.get(k, 0)) for k in range(units)]) if units <= 64 else F.split(F.lit(" ".join(str(rest.get(k, 0)) for k in range(units))), " ")
    small_shard = F.element_at(by_bundle, (bundle + 1).cast("int")).cast("int")
    if big:
        # At most `units` rows.
        own = F.broadcast(spark.createDataFrame(big, "h1 long, h2 long, own int"))
        rows = rows.join(own, ["h1", "h2"], "left")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("int"))
    rows = rows.withColumn("shard", F.coalesce("own", small_shard))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "cell")
    counts = rows.groupBy("shard", "cell").count()
    base = counts.select("shard", "cell", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    # At most shards * units / 8 rows.
    return ranked.join(F.broadcast(base), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
