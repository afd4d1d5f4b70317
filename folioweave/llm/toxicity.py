"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Learning: document frequencies of tokens (lower-cased words and their proper
prefixes of 4 to 9 characters) are counted by class over a bounded sample of labelled
documents (SAMPLE rows of the labels, the first by a hash of doc_id). Log-odds
carry an informative Dirichlet prior proportional to a token's overall
frequency, of PRIOR documents or half the toxic ones, if fewer; the TOKENS most significant tokens of z >= MIN_Z are kept, so the
model has a fixed bound. A word scores its most toxic token's log-odds, any
other word -DRIFT; a linear-time scan over the toxic words of a text finds all
maximal segments. By the extreme-value law of such segments, a text of n words holds
by chance E = K * n * exp(-decay * s) of a sum of s or more; K and decay are fitted to the best
segments of clean documents by maximum likelihood. Segments of p-value 1 - exp(-E)
<= SIGNIFICANT are the toxic passages. A document's evidence, -log E of its best
segment and of every other significant one together, becomes a probability by a logistic
curve, which may weigh the length of the text otherwise than the law does.

Scale: counting is a partial aggregation by token and class over at most SAMPLE
documents; scoring is one pass without a shuffle.

Defined results: null and empty texts score like a text without toxic words;
each row is scored; without labels of both classes all scores are 0;
an empty table gives no rows; extra columns are ignored; labels, lang, source and doc_id are never read by a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialised, small, table, text_or_empty, texts_of
from .textvec import chunked, numbered_pieces

SAMPLE = 16_000
TOKENS = 5_000
MIN_Z = 4.0
MIN_DOCS = 5
MIN_WEIGHT = 2.0
PRIOR = 200.0
SIGNIFICANT = 0.01
DRIFT = 0.4
PREFIXES = (4, 5, 6, 7, 8, 9)


def tokens_of(word: str) -> list[str]:
    """A word's own token and those of its proper prefixes."""
    w = word.lower()
    return [] if not w[0].isalpha() else [w] + [w[:n] + "*" for n in PREFIXES if len(w) > n]


def words_in(texts: list[str]):
    """Of each text: distinct words of its chunk, numbers of its words, their starts and ends."""
    out = [([], [], [], []) for _ in texts]
    shift = [0] * len(texts)
    for numbers, parts in chunked(texts):
        pieces, codes, before, starts, ends = numbered_pieces(parts, "words", 200)
        words = np.array(pieces, object)
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])])
        for k, i in enumerate(numbers):
            a, b = before[k], before[k + 1]
            for held, new in zip(out[i], (words, codes[a:b], starts[a:b] - begin[k] + shift[i], ends[a:b] - begin[k] + shift[i]), strict=True):
                held.append(new)
            shift[i] += len(parts[k])
    return out


def document_counts(texts: list[str], toxic: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, and how many clean and how many toxic texts hold each."""
    known: dict[str, int] = {}
    docs, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    memo: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, (words, codes, _, _) in enumerate(words_in(texts)):
        for w, c in zip(words, codes, strict=True):
            if id(w) not in memo:
                lists = [[known.setdefault(t, len(known)) for t in tokens_of(x)] for x in w]
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                memo[id(w)] = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)])
            flat, at = memo[id(w)]
            mine = np.unique(c)
            count = at[mine + 1] - at[mine]
            ends = np.cumsum(count)
            tokens.append(flat[np.repeat(at[mine] - (ends - count), count) + np.arange(int(count.sum()))])
            docs.append(np.full(len(tokens[-1]), i))
    pairs = np.unique(np.concatenate(docs) * max(len(known), 1) + np.concatenate(tokens))
    label = np.array(toxic, np.int64)[pairs // max(len(known), 1)] if len(pairs) else np.zeros(0, np.int64)
    token = pairs % max(len(known), 1)
    return list(known), np.bincount(token[label == 0], minlength=len(known)), np.bincount(token[label == 1], minlength=len(known))


@dataclass
class Model:
    weights: dict[str, float]
    rate: float = 1.0
    decay: float = 1.0
    slope: float = 1.0
    offset: float = -50.0
    length: float = 0.0

    def word_score(self, word: str) -> float:
        return max((self.weights.get(t, 0.0) for t in tokens_of(word)), default=0.0)

    def segments(self, texts: list[str]) -> list[tuple[int, list[tuple[float, int, int]]]]:
        """Of each text, its number of words and all maximal segments as (score, start, end) in characters."""
        out = []
        memo: dict[int, np.ndarray] = {}
        for words, codes, starts, ends in words_in(texts):
            total, found = 0, []
            for w, c, s, e in zip(words, codes, starts, ends, strict=True):
                table_ = memo.get(id(w))
                if table_ is None:
                    table_ = memo[id(w)] = np.fromiter(map(self.word_score, w), float, len(w))
                score = table_[c]
                hit = np.flatnonzero(score > 0)
                found += [(total + h, v, a, b) for h, v, a, b in zip(hit.tolist(), score[hit].tolist(), s[hit].tolist(), e[hit].tolist(), strict=True)]
                total += len(c)
            out.append((total, maximal_segments(found)))
        return out

    def surprise(self, total: int, score: float) -> float:
        """-log E of a segment in a text of that many words."""
        return self.decay * score - math.log(self.rate * (total + 1))

    def passages(self, total: int, segments: list) -> list[tuple[float, int, int, float]]:
        """The significant segments, with their p-values."""
        tested = [(v, a, b, -math.expm1(-math.exp(-self.surprise(total, v)))) for v, a, b in segments]
        return [x for x in tested if x[3] <= SIGNIFICANT]

    def statistic(self, total: int, segments: list) -> float:
        """The evidence of the best segment and of all others that are significant, on a logarithmic scale."""
        best = self.surprise(total, max((x[0] for x in segments), default=0.0))
        significant = [self.surprise(total, x[0]) for x in self.passages(total, segments)]
        evidence = best + sum(significant) - max(significant, default=0.0)
        return math.copysign(math.log1p(abs(evidence)), evidence)

    def probability(self, total: int, segments: list) -> float:
        x = self.slope * self.statistic(total, segments) + self.length * math.log(total + 1) + self.offset
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def maximal_segments(hits: list[tuple[int, float, int, int]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments among positive words (position, score, start, end), every other word counting -drift, in linear time."""
    stack: list[list[float]] = []  # left sum, right sum, start, end
    total, last = 0.0, -1
    for at, score, start, end in hits:
        total -= drift * (at - last - 1)
        new = [total, total + score, start, end]
        total, last = total + score, at
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= new[0]:
                k -= 1
            if k < 0 or stack[k][1] >= new[1]:
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
    return [(r - l, int(a), int(b)) for l, r, a, b in stack]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most `sample` labelled documents outside the held-out fifth."""
    outside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & outside).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # At most `sample` rows; of a doc_id that is repeated one text counts.
    mine = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return mine.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = materialised(training_rows(docs, labels, sample), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({})

    def count():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, clean, toxic = document_counts(texts_of(batch), batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(clean), pa.array(toxic)], ["token", "clean", "toxic"])

        return run

    counts = map_batches(rows, count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    prior = min(PRIOR, max(1.0, sizes[1] / 2))
    share = F.lit(prior) * (F.col("c") + F.col("t")) / F.lit(float(sum(sizes.values())))
    odds = lambda n, of: F.log((F.col(n) + share + 0.01) / (F.lit(float(of) + prior) - F.col(n) - share + 0.01))
    weight = odds("t", sizes[1]) - odds("c", sizes[0])
    error = F.sqrt(1 / (F.col("t") + share + 0.01) + 1 / (F.col("c") + share + 0.01))
    kept = counts.where(F.col("t") >= MIN_DOCS).select("token", weight.alias("weight"), (weight / error).alias("z")).where((F.col("z") >= MIN_Z) & (F.col("weight") >= MIN_WEIGHT))
    # At most TOKENS rows.
    model = Model({r["token"]: r["weight"] for r in kept.orderBy(F.desc("z"), "token").limit(TOKENS).collect()})

    def best():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = model.segments(texts_of(batch))
            kind = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([[x[0] for x in s] for _, s in got], kind)], ["toxic", "n", "sums"])

        return run

    # At most `sample` rows: the sums of the few segments of a text.
    found = map_batches(rows, best, "toxic int, n long, sums array<double>").collect()
    clean = [(r["n"], max(r["sums"], default=0.0)) for r in found if r["toxic"] == 0]
    model.rate, model.decay = extreme_value(np.array([n for n, _ in clean], float) + 1, np.array([x for _, x in clean]), MIN_WEIGHT)
    z = np.array([[model.statistic(r["n"], [(x, 0, 0) for x in r["sums"]]), math.log(r["n"] + 1)] for r in found])
    (model.slope, model.length), model.offset = logistic(z, np.array([r["toxic"] for r in found], float))
    return model


def extreme_value(size: np.ndarray, best: np.ndarray, least: float = 0.0) -> tuple[float, float]:
    """Rate and decay for which P(best <= s) = exp(-rate * size * exp(-decay * s)), by maximum likelihood; a best of up to `least`, that of one word, says no more than that there is none above."""
    found = best > least
    over = np.maximum(best - least, 0.0)
    m = int(found.sum())
    if not m or not size.sum():
        return 0.5 / max(float(size.sum()), 1.0), 1.0
    rate = lambda decay: m / float((size * np.exp(-decay * over)).sum())

    def loss(decay: float) -> float:
        return -(m * math.log(rate(decay)) + m * math.log(decay) - decay * float(over[found].sum()) - m)

    low, high, golden = math.log(1e-3), math.log(1e2), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        x, y = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, y) if loss(math.exp(x)) < loss(math.exp(y)) else (x, high)
    decay = math.exp(low)
    return rate(decay) * math.exp(decay * least), decay


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 100, penalty: float = 0.1) -> tuple[list[float], float]:
    """Weights of the columns of z (the first not negative) and offset of a lightly penalised logistic curve, by damped Newton steps."""
    middle, spread = z.mean(0), z.std(0)
    spread[spread == 0] = 1.0
    x = np.column_stack([(z - middle) / spread, np.ones(len(z))])
    weight = np.array([penalty] * z.shape[1] + [0.0])
    loss = lambda b: float(np.logaddexp(0, x @ b).sum() - y @ (x @ b) + 0.5 * weight @ (b * b))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(weight + 1e-9), x.T @ (y - p) - weight * b)
        step = 1.0
        while step > 1e-6 and loss(b + step * move) > loss(b):
            step /= 2
        b = b + step * move
        if np.abs(step * move).max() < 1e-9:
            break
    slopes = b[:-1] / spread
    slopes[0] = max(slopes[0], 1e-6)
    return slopes.tolist(), float(b[-1] - (slopes * middle).sum())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (significant segments: score, start, end in characters, p) of every row."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = model.segments(texts_of(batch))
            p = [model.probability(n, s) for n, s in got]
            spans = [[{"score": v, "start": a, "end": b, "p": q} for v, a, b, q in model.passages(n, s)] for n, s in got]
            kind = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows, make, "doc_id long, score double, passages array<struct<score:double,start:long,end:long,p:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below one half, all columns."""

    def run(batches):
        for whole in batches:
            for batch in small(whole):
                yield batch.filter(pa.array([model.probability(n, s) < 0.5 for n, s in model.segments(texts_of(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
