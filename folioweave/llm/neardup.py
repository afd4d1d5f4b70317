"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search, links confirmed on full sets.

A document's set is its distinct word shingles. Documents of equal sets form a
class (128-bit fingerprint of the set) and only class representatives go on. A
signature has CHUNKS chunks of CHUNK b-bit MinHash symbols. Two signatures at a
distance of at most CHUNKS * (ERRORS + 1) - 1 symbols agree in some chunk but
for ERRORS symbols (pigeonhole), so each chunk enters an index once for
every choice of ERRORS symbols left out. With 8 chunks of 7 symbols and one
error, two sets of similarity 0.85 fail to meet with probability 4e-5.

Pairs of a bucket are not enumerated. In each of ROUNDS rounds a bucket's leader
meets its other members, pairs of far signatures are dropped (at the threshold a
tenth of what the index misses, at most), the rest are confirmed on the full shingle sets, links give components, and a leader that has
met everyone leaves. Leader is the member whose buckets are largest together:
in a group of copies that is the text that most others resemble. A bucket whose
members share a component is done. What then remains, buckets whose members are
alike but not linked, is compared block against block inside one Arrow stage:
members bring their signatures and sets, pairs that are no link never become
rows, and every block emits the links that join its components. A group of
thousands of near copies is thus joined by about as many pairs as it has
members, and no link between different texts that the index can find is lost.

Components are the least label reachable, by alternating neighbour minima
and pointer jumps in joins; links, labels and texts stay distributed, and each
round is written to the shared folder, which cuts lineage.

Scale: one scan for signatures; buckets are counted before they are joined, so
keys that occur once (nearly all) never leave the count; joins with hot keys are
plain equi-joins of stored tables, which Spark splits at skew.

Defined results: null and empty texts and texts without words have an empty
set, are linked with nothing and kept; equal rows are linked; a doc_id
repeated with other texts takes the least component of its texts; rows without
doc_id are linked with nothing (component_id null, kept); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialised, table, text_or_empty, texts_of
from .textvec import finish, shingle_sets

WIDTH = 5
CHUNK = 7
ERRORS = 1
ROUNDS = 3
SYMBOL_BITS = 16
#: A block of a torn bucket: members and shingles it holds, about.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1_000_000
#: Pairs of far signatures aren't confirmed; of true links this may lose that share of what the index loses.
FAR_LOSS = 0.1


def signatures(hashes: np.ndarray, offsets: np.ndarray, symbols: int) -> np.ndarray:
    """MinHash symbols (rows of b-bit values) of each set; sets must not be empty."""
    seeds = np.random.default_rng(5).integers(1, 1 << 63, size=symbols, dtype=np.uint64)
    out = np.empty((symbols, len(offsets) - 1), np.int32)
    for k, seed in enumerate(seeds):
        mixed = (hashes ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(mixed, offsets[:-1])
        out[k] = (finish(least) >> np.uint64(64 - SYMBOL_BITS)).astype(np.int32)
    return out


def described(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (array<int>) of every row."""
    symbols = chunks * CHUNK

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, offsets = shingle_sets(texts_of(batch), WIDTH)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            at = np.append(offsets[:-1][full], offsets[-1]) if len(full) else np.zeros(1, np.int64)
            sig = np.zeros((len(size), symbols), np.int32)
            prints = np.zeros((2, len(size)), np.int64)
            if len(full):
                sig[full] = signatures(hashes, at, symbols).T
                for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                    prints[k, full] = np.add.reduceat(finish(hashes ^ np.uint64(salt)), at[:-1]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, symbols, dtype=np.int32)), pa.array(sig.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(prints[0]), pa.array(prints[1]), lists], ["doc_id", "n_shingles", "f1", "f2", "sig"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows, make, "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>")


def index_keys(sig: Column, chunks: int) -> Column:
    """The 64-bit keys under which a signature is found: each chunk with each choice of ERRORS symbols left out."""
    keys = []
    for c in range(chunks):
        symbols = [F.get(sig, F.lit(c * CHUNK + k)) for k in range(CHUNK)]
        keys += [F.xxhash64(F.lit(c * CHUNK + out), *(s for k, s in enumerate(symbols) if k != out)) for out in range(CHUNK)]
    return F.array(*keys)


def index_miss(chunks: int, percent: int) -> float:
    """Probability that two sets of that similarity share no key."""
    same = percent / 100
    chunk = sum(math.comb(CHUNK, k) * (1 - same) ** k * same ** (CHUNK - k) for k in range(ERRORS + 1))
    return (1 - chunk) ** chunks


def far_loss(chunks: int, percent: int, most: int) -> float:
    """Probability that signatures of two sets of that similarity differ in more than `most` symbols."""
    n, same = chunks * CHUNK, percent / 100
    return sum(math.comb(n, k) * (1 - same) ** k * same ** (n - k) for k in range(most + 1, n + 1))


def most_differing(chunks: int, percent: int) -> int:
    """The least number of differing symbols whose loss stays under FAR_LOSS of the index's own."""
    allowed = FAR_LOSS * index_miss(chunks, percent)
    return next(most for most in range(chunks * CHUNK + 1) if far_loss(chunks, percent, most) <= allowed)


def are_near(chunks: int, percent: int) -> Column:
    """Whether signatures and sizes of a and b leave room for a link."""
    differ = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x != y), lambda d: d))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differ <= most_differing(chunks, percent))


def side(reps: DataFrame, name: str) -> DataFrame:
    return reps.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n_shingles").alias(f"n_{name}"))


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, chunks: int) -> DataFrame:
    """The pairs (a, b) of representatives whose sets have 100 * intersection >= percent * union."""
    close = pairs.join(side(reps, "a"), "a").join(side(reps, "b"), "b").where(are_near(chunks, percent)).select("a", "b")
    text = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    with_texts = close.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, at = shingle_sets(texts_of(batch, "text_a"), WIDTH)
            right, bt = shingle_sets(texts_of(batch, "text_b"), WIDTH)
            keep = []
            for i in range(batch.num_rows):
                x, y = left[at[i] : at[i + 1]], right[bt[i] : bt[i + 1]]
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return run

    return map_batches(with_texts, make, "a long, b long")


def linked_in_block(sig: np.ndarray, label: np.ndarray, sets: list[np.ndarray], first: np.ndarray | None, slot: int, percent: int, chunks: int) -> list[tuple[int, int]]:
    """Links (row, row) that join different labels of one block, or of two where `first` marks the rows of the first.

    A pair is looked at in the first bucket that its signatures share, `slot` telling which this is, and not again
    once links found before have joined its labels.
    """
    most, (chunk, left_out) = most_differing(chunks, percent), divmod(slot, CHUNK)
    codes, roots = np.unique(label, return_inverse=True)
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ids, flat = pd.factorize(np.concatenate(sets))[0], np.concatenate([[0], np.cumsum(size)])
    mine = np.zeros(int(ids.max()) + 1, bool)
    found = []
    left = np.arange(len(sig)) if first is None else np.flatnonzero(first)
    right = left if first is None else np.flatnonzero(~first)
    for a in left.tolist():
        others = right[right > a] if first is None else right
        others = others[(roots[others] != roots[a]) & (100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a]))]
        if not len(others):
            continue
        differ = (sig[others] != sig[a]).reshape(len(others), -1, CHUNK).sum(2)
        here = (differ[:, chunk] <= ERRORS) & (differ.sum(1) <= most) & ~(differ[:, :chunk] <= ERRORS).any(1)
        if left_out:
            here &= differ[:, chunk] == ERRORS
        others = others[here]
        if not len(others):
            continue
        mine[ids[flat[a] : flat[a + 1]]] = True
        for b in others.tolist():
            if root(roots[a]) != root(roots[b]):
                shared = int(np.count_nonzero(mine[ids[flat[b] : flat[b + 1]]]))
                if 100 * shared >= percent * (size[a] + size[b] - shared):
                    parent[root(roots[a])] = root(roots[b])
                    found.append((a, b))
        mine[ids[flat[a] : flat[a + 1]]] = False
    return found


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that are equal in `keys`, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys], 1)
        cuts = np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1
        starts = [0, *cuts.tolist(), batch.num_rows]
        for k in range(len(starts) - 1):
            key = tuple(codes[starts[k]])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(starts[k], starts[k + 1] - starts[k]))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def block_links(rows: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, chunks: int) -> DataFrame:
    """Links (a, b) that join the labels of the buckets' members (key, rep, label), found block against block.

    Members carry signature and set, so a pair that is no link is never a row. A bucket of more than BLOCK_ROWS members
    or BLOCK_SHINGLES shingles is split by a hash of the member, and every two of its blocks meet in one group of rows.
    """
    torn = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = materialised(rows.join(torn, "key").select("key", "rep", "label"), "torn")
    wanted = materialised(rest.select("rep").distinct(), "torn-members")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, at = shingle_sets(texts_of(batch), WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], ["rep", "shingles"])

        return run

    sets = map_batches(wanted.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "text"), make, "rep long, shingles array<long>")
    members = materialised(wanted.join(reps.select("rep", "sig", "n_shingles"), "rep").join(sets, "rep"), "torn-sets")
    sized = rest.join(members.select("rep", "n_shingles"), "rep").groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    slots = F.array_position(index_keys(F.col("sig"), chunks), F.col("key")).cast("int") - 1
    full = rest.join(members, "rep").join(materialised(sized, "torn-blocks"), "key").withColumns({"slot": slots, "block": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")})
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["key", "i", "j"]
    dealt = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "slot", "rep", "label", "sig", "shingles")
    spread = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in runs_of(batches, keys):
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            block = group["block"].to_numpy()
            if group.num_rows < 2 or (i != j and (block == block[0]).all()):
                continue
            lists = group["shingles"].combine_chunks()
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sig = group["sig"].combine_chunks().flatten().to_numpy().astype(np.uint16).reshape(group.num_rows, -1)
            rep = group["rep"].to_numpy()
            pairs = linked_in_block(sig, group["label"].to_numpy(), [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], None if i == j else block == i, group["slot"][0].as_py(), percent, chunks)
            a += [int(min(rep[x], rep[y])) for x, y in pairs]
            b += [int(max(rep[x], rep[y])) for x, y in pairs]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """node, label: the least node reachable, of every node that has a link (a, b)."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialised(edges.union(edges.select("v", "u")).where("u <> v").distinct(), f"{name}-edges")
    labels = materialised(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), name)
    while True:
        # The least label among the neighbours, then the label's own label.
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialised(lower.join(hop, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), name)
        labels = moved.select("node", "label")
        if moved.where("was <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, chunks: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    every = materialised(described(docs, chunks), "signatures")
    known = every.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    reps = materialised(classes, "classes")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():
        # However often a doc_id is repeated, each of its texts is looked at once.
        again = materialised(again, "repeated")
        once = materialised(texts.join(again, "doc_id", "left_semi").distinct(), "repeated-texts")
        texts = texts.join(again, "doc_id", "left_anti").unionByName(once)

    keyed = reps.select("rep", F.explode(index_keys(F.col("sig"), chunks)).alias("key"))
    sizes = materialised(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = materialised(keyed.join(sizes, "key"), "buckets")
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    rows = materialised(shared.join(weight, "rep").select("key", "rep", "weight", F.col("rep").alias("label")), "members")
    links, labels = None, None
    met = None
    for turn in range(ROUNDS):
        leader = F.max_by(F.struct("rep", "label"), F.struct("weight", -F.col("rep")))
        heads = rows.groupBy("key").agg(leader.alias("head"), F.min("label").alias("x"), F.max("label").alias("y"))
        heads = materialised(heads.where("x <> y").select("key", F.col("head.rep").alias("head"), F.col("head.label").alias("head_label")), f"heads-{turn}")
        if heads.isEmpty():
            rows = None
            break
        led = materialised(rows.join(heads, "key").where("rep <> head"), f"led-{turn}")
        pairs = led.where("label <> head_label").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pairs = materialised(pairs, f"pairs-{turn}")
        met = pairs if met is None else met.unionByName(pairs)
        found = materialised(confirmed(pairs, reps, texts, percent, chunks), f"links-{turn}")
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links, f"labels-{turn}")
        rows = led.select("key", "rep", "weight").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "weight", F.coalesce("label", "rep").alias("label"))
        rows = materialised(rows, f"members-{turn}")
    if rows is not None:
        found = materialised(block_links(rows, reps, texts, percent, chunks), "links-last")
        if links is None or not found.isEmpty():
            labels = components(found if links is None else links.unionByName(found), "labels-last")
    final = labels if labels is not None else reps.select(F.col("rep").alias("node"), F.col("rep").alias("label"))

    members = known.select("doc_id", "f1", "f2").distinct().join(reps.select("f1", "f2", "rep"), ["f1", "f2"])
    placed = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    placed = placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = every.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, percent: int = 80, chunks: int = 10) -> DataFrame:
    """One row of each component of documents, all columns: the one of the least doc_id, null last.

    A document is a doc_id with its text, null counting as an id and as an empty text. So each text of a repeated
    doc_id is decided by itself, rows without doc_id take part, and of rows equal in both one stays. Documents go by a
    64-bit hash of both; two of n share one with probability n * n / 2**65.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()))
    rows = materialised(keyed.groupBy("__key").agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count(F.lit(1)).alias("n")), "keys")
    again = rows.where("n > 1").select("__key")
    if not again.isEmpty():
        once = keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"])
        keyed = materialised(keyed.join(again, "__key", "left_anti").unionByName(once), "once")
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), percent, chunks)
    placed = materialised(found.select(F.col("doc_id").alias("__key"), "component_id").join(rows, "__key"), "placed")
    least = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__key")).alias("least"))
    gone = placed.select("__key").join(least.select("least.__key"), "__key", "left_anti")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)
