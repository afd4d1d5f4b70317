"""Approximate nearest neighbours by cross-polytope hashing, multiprobe tables and exact reranking.

Each table rotates a unit vector by three rounds of random signs and a fast
Hadamard transform and takes the nearest signed axis, at every number of
vectors. Every vector is indexed, a query probes the PROBES best buckets of each
of TABLES tables. Candidates meet queries as blocks: a bucket of more than BLOCK
vectors is split by a hash of the id, its queries likewise, and each pair of
blocks is one small matrix product, of which every query keeps its best and all
that tie with them. Those are scored again in double precision on the original
vectors.

Rows of equal vectors form one class that carries its smallest ids, as many as
any query can return of it; so a vector that a third of all rows share is
indexed once. Queries that find fewer neighbours than asked are searched again
against all blocks, themselves split into blocks.

Scale: hashing is one pass; the index is shuffled once with TABLES copies of
each class; counts of buckets (TABLES * 2 * padded dimensions rows, whatever the
number of vectors) are broadcast. A query meets a fixed share of all vectors, so
scoring grows with queries times vectors. Measured recall: README.

Defined results: vectors null, empty, zero, of another length than most, or with
null or non-finite components, and rows without vec_id, take no part; repeated
rows count once; without candidates a query returns nothing; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fingerprint, map_batches, materialised, table

TABLES = 16
PROBES = 6
BLOCK = 2048
#: More than rounding can move a cosine in double precision.
ROUNDING = 1e-9
HITS = "qid long, cid long, ids array<long>, score double"


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of rows, padded to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([7, seed])
    for _ in range(3):
        y = y * rng.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            z = y.reshape(len(y), -1, 2, half)
            y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], 2).reshape(len(y), width)
            half *= 2
        y /= np.sqrt(width)
    return y


def nearest_axes(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Of each row the `probes` best buckets of each table (rows, tables, probes): signed axes, the nearest first."""
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        y = rotate(x, t * 8)
        order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
        code = order * 2 + (np.take_along_axis(y, order, 1) < 0)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = code[:, :1]
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """rows (cid, ids, vec) with `buckets`: table * 2**32 + bucket of each table and probe."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column(2))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            found = nearest_axes(x, tables, probes)
            keys = (found + (np.arange(found.shape[1], dtype=np.int64) << 32)[None, :, None]).reshape(len(x), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
            return pa.RecordBatch.from_arrays([*batch.columns, lists], ["cid", "ids", "vec", "buckets"])

        return run

    return map_batches(rows.select("cid", "ids", "vec"), make, f"cid long, ids array<long>, vec {rows.schema['vec'].dataType.simpleString()}, buckets array<long>")


def score_blocks(keep: int):
    """A cogrouped function: of each query (left) its `keep` best classes (right) of the same block."""

    def run(queries: pa.Table, classes: pa.Table) -> pa.Table:
        names = ["qid", "cid", "ids", "score"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not queries.num_rows or not classes.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        q, c = matrix(queries["vec"]), matrix(classes["vec"])
        nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        unit, cid = (c / nc[:, None]).T, classes["cid"].to_numpy()
        take, parts = min(keep, len(c)), []
        for at in range(0, len(q), 64):
            rough = (q[at : at + 64] / nq[at : at + 64, None]) @ unit
            # Ties go to the least id, so all that may tie with the last that is kept are scored.
            least = -np.partition(-rough, take - 1, axis=1)[:, take - 1 : take]
            a, b = np.nonzero(rough >= least - ROUNDING)
            score = (q[at + a] * c[b]).sum(1) / (nq[at + a] * nc[b])
            order = np.lexsort((cid[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.arange(len(a)) - np.searchsorted(a, a) < keep
            parts.append((at + a[first], b[first], score[first]))
        a, b, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.Table.from_arrays([queries["qid"].take(pa.array(a)), classes["cid"].take(pa.array(b)), classes["ids"].take(pa.array(b)), pa.array(score)], names)

    return run


def meet(queries: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """Scores of all pairs of query and class blocks that share key, part and slice."""
    keys = ["key", "part", "slice"]
    left = queries.select(*keys, F.col("cid").alias("qid"), "vec").groupBy(*keys)
    return left.cogroup(classes.select(*keys, "cid", "ids", "vec").groupBy(*keys)).applyInArrow(score_blocks(keep), HITS)


def best_classes(hits: DataFrame, keep: int) -> DataFrame:
    once = hits.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")


def nearest(rows: DataFrame, query_ids, k: int = 5, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query; rows has vec_id and embedding, query_ids makes a condition of vec_id."""
    spark = rows.sparkSession
    most = k + 1
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # Scores are made of the original components: floats stay floats, any other kind is taken as doubles.
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(usable)
    lengths = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("embedding") == lengths["n"]).select("vec_id", "embedding", *fingerprint(F.col("embedding")))
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    once = good.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most)
    classes = materialised(once.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("vec")).withColumn("cid", F.element_at("ids", 1)), "classes")
    queries = materialised(good.where(query_ids(F.col("vec_id"))).select("vec_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")), "queries")
    asked = classes.join(queries.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")

    index = materialised(hashed(classes, tables, 1), "index")
    probing = materialised(hashed(asked, tables, probes), "probes")
    keyed = index.select("cid", "ids", "vec", F.explode(F.array_distinct("buckets")).alias("key"))
    sought = probing.select("cid", "vec", F.explode(F.array_distinct("buckets")).alias("key"))
    sizes = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    # At most tables * 2 * padded dimensions rows, a bound that does not grow with the number of vectors.
    plan = materialised(sizes(keyed.select("key"), "parts").join(sizes(sought.select("key"), "slices"), "key"), "plan")
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = keyed.join(F.broadcast(plan), "key").withColumn("part", own("parts")).withColumn("slice", every("slices"))
    left = sought.join(F.broadcast(plan), "key").withColumn("slice", own("slices")).withColumn("part", every("parts"))
    found = materialised(best_classes(meet(left, right, most), most), "found")

    total = good.select("vec_id").distinct().limit(k + 1).count()
    have = found.groupBy("qid").agg(F.sum(F.size("ids")).alias("n"))
    short = asked.join(have.where(F.col("n") > min(k, total - 1)).select(F.col("qid").alias("cid")), "cid", "left_anti")
    short = materialised(short, "short")
    if not short.isEmpty():
        slices, parts = (max(1, -(-df.count() // block)) for df in (short, classes))
        split = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        again = short.withColumns({"key": F.lit(0), "slice": split(slices)}).withColumn("part", all_of(parts))
        everything = classes.withColumns({"key": F.lit(0), "part": split(parts)}).withColumn("slice", all_of(slices))
        extra = best_classes(meet(again, everything, most), most)
        found = found.join(short.select(F.col("cid").alias("qid")), "qid", "left_anti").unionByName(extra)

    flat = found.select("qid", "score", F.explode("ids").alias("vec_id"))
    head = flat.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= most).drop("r")
    pairs = queries.join(head, "qid").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
