"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics of whole texts are computed vectorised in the scan's tasks. The trees
are grown on the driver from binned statistics of a bounded sample of labelled
documents (SAMPLE rows of the labels, the first by a hash of doc_id: at
most SAMPLE * features doubles), flattened into node arrays and sent with the
task; scoring walks all trees of a batch level by level in numpy. A document
fails outright on the base rules; else the trees' verdict holds. Constrained
statistics (CONSTRAINTS) can only lower the score as they grow.

Scale: training reads labels, and of documents only the sample's texts are
analysed (the sample is broadcast, at most SAMPLE rows); scoring is one pass
without a shuffle.

Defined results: null text has no words and fails the base rules; each row
counts as a document; without labels of both kinds, documents that pass the base
rules are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small, table, text_or_empty, texts_of
from .textvec import HASH_CHARS, Words, _whole_chunks, finish, long_words, segment_hash, window_docs, windows

SAMPLE = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "bang_rate", "line_words", "distinct_rate", "other_rate"]
#: -1: the score never rises with the statistic.
CONSTRAINTS = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:?'\"()-")] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!")] = True
_PLAIN = _UPPER | _DIGIT | _MARK | _BANG | _SYMBOL
_PLAIN[[*range(97, 123), *range(128, 256), 32, *range(9, 14)]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def repeated(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, hash) pairs in order: found twice or more; found earlier."""
    codes, uniq = pd.factorize(finish(hashes + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    count = np.bincount(codes, minlength=len(uniq))
    first = np.empty(len(uniq), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return count[codes] > 1, first[codes] != np.arange(len(codes))


def covered_words(again: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the positions `again`."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + width, -1)
    return np.cumsum(mark)[:-1] > 0


def measured(n, chars, symbols, dup_lines, repeats, lines, worded_lines, distinct, letters, *kinds) -> tuple[np.ndarray, np.ndarray]:
    """BASE counts and FEATURES from counts of each text; kinds: bytes that are upper case, digits, marks, bangs, others."""
    one, some = np.maximum(n, 1), np.maximum(letters, 1)
    upper, digit, mark, bang, other = (k / some for k in kinds)
    rates = [np.log1p(n), chars / one, symbols / one, dup_lines / np.maximum(lines, 1), repeats / one, upper, digit, mark, bang, n / np.maximum(worded_lines, 1), distinct / one, other]
    return np.stack([n, chars, symbols, dup_lines, repeats], 1).astype(np.int64), np.stack(rates, 1).astype(float)


def counted(w: Words) -> list[np.ndarray]:
    """Of each text: words, code points in them, symbols, bytes in them, bytes of each kind."""
    of = lambda flags: w.per_doc(flags[w.data])
    return [w.counts, w.per_doc(w.inside & _LEAD[w.data]), of(_SYMBOL), w.per_doc(w.inside), of(_UPPER), of(_DIGIT), of(_MARK), of(_BANG), of(~_PLAIN)]


def long_statistics(text: str) -> tuple[np.ndarray, np.ndarray]:
    """statistics() of a text over one chunk, from its segments' words and, line by line, its lines."""
    sums, hashes = 0, []
    for w in long_words(text):
        sums = sums + np.array([x[0] for x in counted(w)], np.int64)
        hashes.append(w.hashes())
    n, chars, symbols, letters, *kinds = (sums[k : k + 1] for k in range(len(sums)))
    h = np.concatenate(hashes)
    doc = np.zeros(len(h), np.int64)
    again = np.flatnonzero(repeated(doc[: max(len(h) - 7, 0)], windows(h, 8))[0])
    seen, lines, worded, dup = set(), 0, 0, 0
    for body in text.split("\n"):
        key, has_word = xxhash.xxh128_digest(body.encode("utf-8", "surrogatepass")), bool(body.strip(" \t\n\x0b\x0c\r"))
        lines, worded, dup = lines + 1, worded + has_word, dup + (has_word and key in seen)
        seen.add(key)
    one = lambda x: np.array([x], np.int64)
    return measured(n, chars, symbols, one(dup), one(covered_words(again, 8, len(h)).sum()), one(lines), one(worded), one(len(np.unique(h))), letters, *kinds)


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the BASE counts (int64) and the FEATURES (float64)."""
    base, more = [np.zeros((0, len(BASE)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for _, parts in _whole_chunks(texts):
        if len(parts[0]) > HASH_CHARS:
            counts, rates = long_statistics(parts[0])
            base.append(counts)
            more.append(rates)
            continue
        w = Words(parts)
        n, chars, symbols, letters, *kinds = counted(w)
        starts, ends = w.lines()
        doc = np.searchsorted(w.begin, starts, "right") - 1
        worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        _, again = repeated(doc, segment_hash(w.prefix, starts, ends))
        of = lambda docs: np.bincount(docs, minlength=len(parts))  # noqa: B023, E731
        hashes = w.hashes()
        at = window_docs(w, 8)
        twice = at[repeated(w.doc[at], windows(hashes, 8)[at])[0]] if len(at) else at
        distinct = of(w.doc[~repeated(w.doc, hashes)[1]]) if len(hashes) else of(w.doc)
        counts, rates = measured(n, chars, symbols, of(doc[again & worded]), of(w.doc[covered_words(twice, 8, len(hashes))]), of(doc), of(doc[worded]), distinct, letters, *kinds)
        base.append(counts)
        more.append(rates)
    return np.concatenate(base), np.concatenate(more)


@dataclass
class Trees:
    """Flattened trees: node arrays of feature (-1: leaf), threshold, left child (right is next) and value; roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document."""
        if not len(x):
            return np.zeros(0)
        node = np.repeat(self.roots[:, None], len(x), 1)
        rows = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            f = self.feature[node]
            right = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f < 0, node, self.left[node] + right)
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(0))))


def grow(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48, penalty: float = 2.0, least: int = 20) -> Trees:
    """Newton boosting of logistic loss over quantile bins; a split that breaks a constraint is not taken, and children keep to bounds at its middle."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), bias)
    feature, threshold, left, value, roots = [], [], [], [], []

    def add() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-9
        roots.append(add())
        todo = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            weight = lambda g, h: np.clip(g / (h + penalty), low, high)  # noqa: B023, E731
            value[node] = rate * float(weight(grad[rows].sum(), hess[rows].sum()))
            margin[rows] += value[node]
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-6, None)
            for f in range(x.shape[1]):
                size = len(cuts[f]) + 1
                g, h, n = (np.bincount(binned[rows, f], w, size).cumsum() for w in (grad[rows], hess[rows], None))
                gl, hl, nl = g[:-1], h[:-1], n[:-1]
                gr, hr, nr = g[-1] - gl, h[-1] - hl, n[-1] - nl
                a, b = weight(gl, hl), weight(gr, hr)
                gain_of = lambda w, g_, h_: g_ * w - 0.5 * (h_ + penalty) * w * w
                gain = gain_of(a, gl, hl) + gain_of(b, gr, hr) - gain_of(weight(g[-1], h[-1]), g[-1], h[-1])
                fine = (nl >= least) & (nr >= least)
                if constraints[f]:
                    fine &= constraints[f] * (b - a) >= 0
                gain = np.where(fine, gain, 0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, float(a[k]), float(b[k])))
            if best[1] is None:
                continue
            f, k, a, b = best[1]
            margin[rows] -= value[node]
            one, two = add(), add()
            feature[node], threshold[node], left[node] = f, float(cuts[f][k]), one
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[constraints[f]]
            goes = binned[rows, f] <= k
            todo += [(one, rows[goes], *bounds[0], level + 1), (two, rows[~goes], *bounds[1], level + 1)]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, bias)


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id, the BASE counts and an array of FEATURES of every row."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more = statistics(texts_of(batch))
            at = pa.array(np.arange(0, more.size + 1, len(FEATURES), dtype=np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base.T.copy()), pa.ListArray.from_arrays(at, pa.array(more.ravel()))], ["doc_id", *BASE, "features"])

        return run

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), make, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from at most `sample` labelled documents; None without labels of both kinds."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # At most `sample` rows.
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    labelled = mine.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))
    stats = statistics_of(labelled.select("doc_id", "text")).select("doc_id", "features")
    rows = stats.join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))), "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["features"] for r in rows], float), np.array([r["quality"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    return grow(x, y, [CONSTRAINTS.get(f, 0) for f in FEATURES])


def judge(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the BASE counts, base_failed, score, kept of every row."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more = statistics(texts_of(batch))
            failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
            score = model.score(more) if model else np.ones(len(base))
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["doc_id", *BASE, "base_failed", "score", "kept"])

        return run

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), make, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).drop("score")


def keep_good(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    columns = docs.columns

    def run(batches):
        for whole in batches:
            for batch in small(whole):
                base, more = statistics(texts_of(batch))
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                score = model.score(more) if model else np.ones(len(base))
                yield batch.filter(pa.array(~failed & (score >= 0.5)))

    return docs.select(*columns).mapInArrow(run, docs.schema)
