"""Byte-level BPE: Spark higher-order functions fold the merges over distinct words.

Bounded blocks of documents are pre-tokenised in the scan's tasks into distinct
pieces and positions (vectorised, no shuffle). A piece that is a token itself is
its id. Every other distinct piece of a block reaches the JVM as the array of its
bytes' tokens, and aggregate() folds ranked merges over it: an element of the state is
one number, of the token that merging with the next one gives, the place in the
piece and the token itself. Ids are ranks, so the least element is the merge to make,
at its leftmost place; only the two new pairs are looked up. The rank map is one
constant, an array that is a perfect hash, since a lookup in Spark's own maps is linear. A
documents' ids are its pieces' ids in order; decoding concatenates the binary
pieces of the ids.

Most pieces of a block are common ones. The most frequent HOT_WORDS pieces of about
HOT_DOCS documents, chosen by a hash, are folded first and sent to all workers, a
table of fixed bound; blocks then fold only what it lacks. The table is a cache:
it changes how often a piece is folded, never a result.

The fold is quadratic in a piece's length, so a piece of over MAX_FOLD bytes has
the same merges made in the same order with a heap, in linearithmic time.

Scale: one pass without a shuffle after that cache; a block is bounded by `block_chars` plus one
document; the rank map has the size of the vocabulary and stands in the plan as a
scalar subquery, not as text.

Defined results: null text is empty and has no ids; each row counts as a
document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small, table, text_or_empty, texts_of, vocabulary
from .textvec import chunked, numbered_pieces

#: Of the rank map. Coprime, and their product is above all pairs: two pairs never agree in both remainders.
GROUPS = 49_999
SLOTS = 200_003
#: No token: what stands after the last one of a piece.
END = (1 << 16) - 1
#: Above all ids: two tokens that do not merge.
NONE = 1 << 16
#: Bits of a place in a piece.
PLACE_BITS = 9
#: Bytes of a piece that is folded, at most; below 2 ** PLACE_BITS.
MAX_FOLD = 400
BLOCK_CHARS = 8_000_000
CHUNK = 500_000
HOT_DOCS = 16_000
HOT_WORDS = 300_000
#: Bytes of a hot word, at most.
HOT_BYTES = 24
OUT_TOKENS = 250_000


@lru_cache(None)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= END:
        raise ValueError("a vocabulary of more than 65,535 ids does not fit the keys of the rank map")
    return ranks


@lru_cache(None)
def single_ids(path: str) -> np.ndarray:
    """The tokens of bytes 0 to 255."""
    ranks = read_ranks(path)
    return np.array([ranks[bytes([b])] for b in range(256)], np.int64)


@lru_cache(None)
def byte_pairs(path: str) -> np.ndarray:
    """What bytes a and b merge into, or NONE."""
    ranks = read_ranks(path)
    return np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int64)


@lru_cache(None)
def merge_table(path: str) -> np.ndarray:
    """The rank map: a perfect hash of pairs, whose key is a * 65536 + b.

    The first GROUPS numbers say where a group's slots begin, by the key modulo
    GROUPS; the pair's slot is that plus the key modulo SLOTS. A slot holds key and,
    in its last 16 bits, what the pair merges into.
    """
    ranks = read_ranks(path)
    groups: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                key = (a << 16) + b
                groups.setdefault(key % GROUPS, []).append((key, rank))
    begins = [GROUPS] * GROUPS
    slots: dict[int, int] = {}
    for group, found in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        at = [key % SLOTS for key, _ in found]
        shift = GROUPS
        while any(x + shift in slots for x in at):
            shift += 1
        begins[group] = shift
        slots.update((x + shift, (key << 16) + rank) for x, (key, rank) in zip(at, found, strict=True))
    # The highest bit is in no key, so an empty slot matches none.
    out = np.full(max(begins) + SLOTS, 1 << 48, np.int64)
    out[:GROUPS] = begins
    out[np.fromiter(slots, np.int64, len(slots))] = np.fromiter(slots.values(), np.int64, len(slots))
    return out


def rank_map(spark: SparkSession, path: str) -> Column:
    """The rank map as a constant of the query (array<bigint>)."""
    numbers = pa.array(merge_table(path))
    return spark.createDataFrame(pa.table({"pairs": pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)})).scalar()


def _expand(sql: str) -> str:
    """let1(value, x -> body), that is body with value computed once, as get(transform(array(value), x -> body), 0)."""
    while (at := sql.rfind("let1(")) >= 0:
        depth, arrow, end = 0, -1, at + 4
        for k in range(at + 4, len(sql)):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if not depth:
                    end = k
                    break
            elif sql[k] == "," and depth == 1 and arrow < 0:
                arrow = k
        sql = f"{sql[:at]}get(transform(array({sql[at + 5 : arrow]}), {sql[arrow + 2 : end]}), 0){sql[end + 1 :]}"
    return sql


def fold_sql(pairs: str = "__pairs") -> str:
    """SQL from the start `w` of a piece's state (array<bigint>, two elements at least) to its ids.

    SQL text, since lists of arguments that Spark's parser makes are strict, and
    those of Column functions lazy, which doubles the time of each step. slice()
    and concat() cost two to five times a transform() of these short arrays.
    """
    low, id_, place = (1 << 16 + PLACE_BITS) - 1, END, ((1 << PLACE_BITS) - 1) << 16
    # Of a key of two tokens, what they merge into, above place and token: a slot of another key differs in bits above an id's.
    rank = lambda key: f"shiftleft(least(get({pairs}, get({pairs}, {key} % {GROUPS}L) + {key} % {SLOTS}L) ^ shiftleft({key}, 16), {NONE}L), {16 + PLACE_BITS})"
    # i: the place of the element before the merge, from 0; x at k. The merge's own is x at i + 1, and the one at i + 2 goes.
    merged = f"shiftright(get(s, i + 1), {16 + PLACE_BITS})"
    before = f"let1(shiftleft(x & {id_}L, 16) | {merged}, key -> {rank('key')} | (x & {low}L))"
    own = f"let1(shiftleft({merged}, 16) | coalesce(get(s, i + 3) & {id_}L, {END}L), key -> {rank('key')} | (x & {place}L) | shiftright(key, 16))"
    elements = f"array_remove(transform(s, (x, k) -> if(k < i, x, if(k > i + 1, x, if(k = i, {before}, {own})))), get(s, i + 2))"
    step = f"if(array_min(s) < {NONE << 16 + PLACE_BITS}L, let1(CAST(array_position(s, array_min(s)) AS INT) - 2, i -> {elements}), s)"
    return _expand(f"aggregate(sequence(2, size(w)), w, (s, z) -> {step}, s -> transform(s, x -> x & {id_}L))")


def heap_fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece, by the same merges as the fold: the least rank first, at its leftmost place."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            rank = ranks.get(piece[i : end[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


def byte_tokens(words: list[bytes], path: str) -> pa.ListArray:
    """Of each word the state before the first merge: of each byte the token, its place and what it and the next byte merge into."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(words), np.uint8)
    merged = np.full(len(data), NONE, np.int64)
    merged[:-1] = byte_pairs(path)[data[:-1], data[1:]]
    merged[at[1:] - 1] = NONE
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    state = (merged << 16 + PLACE_BITS) | (place << 16) | single_ids(path)[data]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(state))


def can_be_hot(coded: bytes) -> bool:
    """Whether a piece fits an array of fixed width, which drops bytes 0 at its end."""
    return len(coded) <= HOT_BYTES and b"\0" not in coded


def hot_words(docs: DataFrame, path: str, sample: int = HOT_DOCS, most: int = HOT_WORDS) -> pa.Table:
    """w and ids of at most `most` frequent pieces of about `sample` documents that are no tokens themselves."""
    near = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(max(docs.count(), 1))) < sample

    def count():
        ranks = read_ranks(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[str, int] = {}
            for _, parts in chunked(texts_of(batch), CHUNK):
                pieces, numbers, *_ = numbered_pieces(parts, "spaced", HOT_BYTES)
                for piece, n in zip(pieces, np.bincount(numbers, minlength=len(pieces)).tolist(), strict=True):
                    if len(piece) <= HOT_BYTES and can_be_hot(coded := piece.encode()) and coded not in ranks:
                        found[piece] = found.get(piece, 0) + n
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["w", "n"])

        return run

    def tokens():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), byte_tokens([x.encode() for x in batch.column(0).to_pylist()], path)], ["word", "w"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(near)
    counts = map_batches(rows, count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    top = map_batches(counts.orderBy(F.desc("n"), "w").limit(most).select("w").repartition(12), tokens, "word string, w array<bigint>")
    # At most `most` rows of two short values.
    return top.withColumn("__pairs", rank_map(docs.sparkSession, path)).select("word", F.expr(fold_sql()).alias("ids")).toArrow()


@lru_cache(2)
def _hot_array(data: bytes) -> np.ndarray:
    """The hot words in ascending order, as an array of HOT_BYTES a word."""
    return np.array([w.encode() for w in pa.ipc.open_stream(data).read_all()["word"].to_pylist()], f"S{HOT_BYTES}")


def places_of(coded: list[bytes], hot: np.ndarray) -> np.ndarray:
    """The place of each piece among the hot words, or -1."""
    if not len(hot) or not coded:
        return np.full(len(coded), -1)
    fits = np.fromiter(map(can_be_hot, coded), bool, len(coded))
    found = np.array([x if y else b"" for x, y in zip(coded, fits, strict=True)], f"S{HOT_BYTES}")
    place = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
    return np.where(fits & (hot[place] == found), place, -1)


def flat_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of the lists."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().astype(np.int32)


@lru_cache(2)
def _known_ids(data: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of the entries of fixed number: each token, then each hot word."""
    vocabulary_size = max(read_ranks(path).values()) + 1
    sizes, values = flat_lists(pa.ipc.open_stream(data).read_all()["ids"].combine_chunks())
    return np.concatenate([np.ones(vocabulary_size, np.int64), sizes]), np.concatenate([np.arange(vocabulary_size, dtype=np.int32), values])


def blocks_of(docs: DataFrame, path: str, hot: bytes, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of blocks: distinct pieces to fold, ids of pieces too long for that, documents with the codes of their pieces.

    A code from 0 counts the words of the block; -1 - k is entry k of: the tokens, the hot words, the block's long pieces.
    """
    item = pa.struct([("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32()))])
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        chars = 0
        ranks, ready = read_ranks(path), _hot_array(sent.value)
        first = max(ranks.values()) + 1

        def flush() -> pa.RecordBatch:
            nonlocal held, chars
            texts = [t for _, t in held]
            words: dict[bytes, int] = {}
            long: list[list[int]] = []
            parts_of: list[list[np.ndarray]] = [[] for _ in texts]

            for numbers, parts in chunked(texts, CHUNK):
                pieces, local, before, _, _ = numbered_pieces(parts, "spaced", MAX_FOLD // 4)
                coded = [x.encode("utf-8", "surrogatepass") for x in pieces]
                number = -1 - np.fromiter((ranks.get(x, -1) for x in coded), np.int32, len(coded))
                rest = np.flatnonzero(number == 0)
                place = places_of([coded[k] for k in rest], ready)
                number[rest] = -1 - first - place
                for k in rest[place < 0].tolist():
                    x = coded[k]
                    if len(x) > MAX_FOLD:
                        long.append(heap_fold(x, ranks))
                        number[k] = -first - len(ready) - len(long)
                    else:
                        number[k] = words.setdefault(x, len(words))
                codes = number[local]
                for k, i in enumerate(numbers):
                    parts_of[i].append(codes[before[k] : before[k + 1]])
            lists = [x[0] if len(x) == 1 else np.concatenate(x) for x in parts_of]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            numbers_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(lists)))
            rows = pa.StructArray.from_arrays([pa.array([i for i, _ in held], pa.int64()), numbers_], fields=list(item))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            out = pa.RecordBatch.from_arrays([one(byte_tokens(list(words), path)), one(pa.array(long, pa.list_(pa.int64()))), one(rows)], ["words", "long", "docs"])
            held, chars = [], 0
            return out

        for whole in batches:
            for batch in small(whole):
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    held.append((doc_id, text))
                    chars += len(text)
                    if chars >= block_chars:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "words array<array<bigint>>, long array<array<bigint>>, docs array<struct<doc_id:bigint,pieces:array<int>>>")


def ids_of_blocks(batches: Iterator[pa.RecordBatch], hot: bytes, path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and ids of runs of documents, from folded blocks."""
    fixed_sizes, fixed = _known_ids(hot, path)
    for batch in batches:
        for row in range(batch.num_rows):
            part = batch.slice(row, 1)
            word_sizes, words = flat_lists(part.column(0).flatten())
            long_sizes, long = flat_lists(part.column(1).flatten())
            # In the order of codes: ..., the first hot word, ..., the first token | the words of the block.
            size = np.concatenate([fixed_sizes, long_sizes, word_sizes])
            at = np.cumsum(size) - size
            ids = np.concatenate([fixed, long, words])
            negative = len(fixed_sizes) + len(long_sizes)
            documents = part.column(2).flatten()
            doc_ids, lists = documents.field(0).to_pylist(), documents.field(1)
            offsets, codes = lists.offsets.to_numpy(), lists.values.to_numpy()
            first = 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + OUT_TOKENS, "right")) - 1)
                mine = codes[offsets[first] : offsets[last]]
                entry = np.where(mine >= 0, mine + negative, -1 - mine)
                count = size[entry]
                ends = np.cumsum(count)
                total = int(ends[-1]) if len(ends) else 0
                tokens = ids[np.repeat(at[entry] - (ends - count), count) + np.arange(total)]
                cut = np.concatenate([[0], ends])[offsets[first : last + 1] - offsets[first]]
                yield doc_ids[first:last], [tokens[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                first = last


def encoded(docs: DataFrame, path: str, make: Callable[[], Callable[[list, list[np.ndarray]], pa.RecordBatch]], schema: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """What a function of doc_ids and ids makes of every whole text; the function is made once a task, on the executor."""
    found = hot_words(docs, path)
    # Ascending by bytes, which is the order by code points.
    found = found.sort_by("word")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    data = sink.getvalue().to_pybytes()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    blocks = blocks_of(docs, path, data, block_chars).withColumn("__pairs", rank_map(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for doc_ids, ids in ids_of_blocks(batches, sent.value, path):
            yield f(doc_ids, ids)

    return blocks.select(F.expr(f"transform(words, w -> {fold_sql()})").alias("words"), "long", "docs").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""

    def make():
        return lambda doc_ids, ids: pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded(docs, path, make, "doc_id long, ids array<int>", block_chars)


@lru_cache(None)
def _pieces(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes that the ids stand for."""
    pieces = _pieces(path)
    return b"".join(chain.from_iterable([pieces[i] for i in ids[at : at + OUT_TOKENS].tolist()] for at in range(0, len(ids), OUT_TOKENS)))


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and data (binary) of rows of doc_id and ids."""

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode(np.array(x, np.int64), path) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), make, "doc_id long, data binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")

    def make():
        def run(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            coded = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            plain = [hashlib.sha256(decode(x, path)).hexdigest() for x in ids]
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    return encoded(table(spark, sf_dir, "documents"), path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
