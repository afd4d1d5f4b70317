"""Checks of candidate rewrites against their source, and the fallback to the source."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioweave.functions.plain import slices, values
from folioweave.functions.text import left_strip, strip
from folioweave.operators.segment import rejoined

MIN_LENGTH_RATIO, MAX_LENGTH_RATIO, MIN_SIMILARITY = 0.90, 1.10, 0.90
# Openings that show that a service explained instead of answering.
EXPLANATIONS = ("düzeltilmiş metin", "temizlenmiş metin", "işte düzeltilmiş", "açıklama:", "analiz:", "gerekçe:")


def ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio(), the same number, sooner.

    difflib walks all pairs of equal characters; here the longest block of a region is found by searches of substrings,
    each for one longer than the best. Characters that difflib thinks popular (over 1 % of a b of 200 and more) start no
    block, as there: only runs without them are searched, and blocks are widened by them.
    """
    if not a and not b or a == b:
        return 1.0
    return 2.0 * matching(a, b) / (len(a) + len(b))


def matching(a: str, b: str) -> int:
    """Characters in the matching blocks."""
    counts = Counter(b)
    if len(b) >= 200:
        most = len(b) // 100 + 1
        popular = [c for c, n in counts.items() if n > most]
        # Popular characters of b become one that a lacks, so that nothing finds them.
        absent = next(chr(i) for i in range(len(a) + 1) if chr(i) not in a)
        searched = b.translate({ord(c): absent for c in popular})
        rare = counts.keys() - set(popular)
    else:
        searched, rare = b, counts.keys()
    starts, ends = runs_of(a, rare)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, n = longest(a, searched, starts, ends, alo, ahi, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        n += common(a, b, i + n, ahi, j + n, bhi)
        if n:
            total += n
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi))
    return total


def runs_of(a: str, rare) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of characters of `rare` in a."""
    starts, ends, inside = [], [], False
    for i, c in enumerate(a):
        if (c in rare) != inside:
            (ends if inside else starts).append(i)
            inside = not inside
    if inside:
        ends.append(len(a))
    return starts, ends


def common(a: str, b: str, i: int, ahi: int, j: int, bhi: int) -> int:
    """Equal characters from i and j on."""
    most, n = min(ahi - i, bhi - j), 0
    while n + 32 <= most and a[i + n : i + n + 32] == b[j + n : j + n + 32]:
        n += 32
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def longest(a: str, b: str, starts: list[int], ends: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest block of a region within one run: the first in a, of those the first in b."""
    besti, bestj, best = alo, blo, 0
    find, width = b.find, bhi - blo
    for r in range(max(0, bisect_right(starts, alo) - 1), len(starts)):
        i, end = starts[r], ends[r]
        if i >= ahi or best >= width:
            break
        i, end = max(i, alo), min(end, ahi)
        while i + best < end:
            # What ends a block one longer than the best: if b lacks it, no block that holds it will do.
            if best >= 24 and find(a[i + best - 15 : i + best + 1], blo, bhi) < 0:
                i += best - 14
                continue
            j = find(a[i : i + best + 1], blo, bhi)
            if j < 0:
                i += 1
            else:
                besti, bestj = i, j
                best += 1 + common(a, b, i + best + 1, end, j + best + 1, bhi)
    return besti, bestj, best


@F.arrow_udf(DoubleType())
def similarity(source: pa.Array, output: pa.Array) -> pa.Array:
    """Matching-blocks ratio of two texts; no built-in function has its order-dependent rule."""
    at, out = 0, []
    for part in slices(source):
        pairs = zip(values(part), values(output.slice(at, len(part))), strict=True)
        out.extend(None if a is None or b is None else ratio(a, b) for a, b in pairs)
        at += len(part)
    return pa.array(out, pa.float64())


def length_ratio(source: Column, output: Column) -> Column:
    return F.length(output) / F.length(source)


def length_change(source: Column, output: Column) -> Column:
    """Change of length in percent, to two places, half to even."""
    return F.bround((F.length(output) - F.length(source)) / F.length(source) * 100, 2)


def explains(output: Column) -> Column:
    # The longest opening has 17 characters; 64 are enough of a text, also where lower case is longer.
    low = F.lower(F.substring(left_strip(output), 1, 64))
    test = F.lit(False)
    for prefix in EXPLANATIONS:
        test = test | low.startswith(prefix)
    return test


def thinks(output: Column) -> Column:
    low = F.lower(output)
    return low.contains("<think>") | low.contains("</think>")


def scored(source: str | None, output: str | None) -> float | None:
    """ratio() of two texts, null where one is missing or empty: the score of services.applied() for validated()."""
    return ratio(source, output) if source and output else None


def validated(df: DataFrame, source: str = "source", output: str = "output", score: str | None = None) -> DataFrame:
    """df with `validation`, a struct; null where source or output is empty, which is an error for a caller.

    Equal texts never reach difflib; the ratio of all others is part of the report, so none can be skipped. Ratios are
    compared unrounded and reported to four places. score: a column with the ratio, if it is known; it goes.
    """
    s, o = F.col(source), F.col(output)
    some = (F.coalesce(F.length(s), F.lit(0)) > 0) & (F.coalesce(F.length(o), F.lit(0)) > 0)
    # Columns of their own, so that each is computed once a row.
    known = F.col(score) if score else similarity(F.when(some, s), F.when(some, o))
    rated = df.withColumns({"__similarity": known, "__explains": explains(o), "__thinks": thinks(o)})
    ratio = length_ratio(s, o)
    tests = (
        (~ratio.between(MIN_LENGTH_RATIO, MAX_LENGTH_RATIO), "length_ratio_out_of_range"),
        (F.col("__similarity") < MIN_SIMILARITY, "similarity_below_threshold"),
        (F.col("__explains"), "model_added_explanation"),
        (F.col("__thinks"), "model_returned_thinking"),
    )
    reasons = F.array_compact(F.array(*[F.when(t, name) for t, name in tests]))
    record = F.struct(
        (F.size(reasons) == 0).alias("valid"),
        F.length(s).cast("long").alias("original_characters"),
        F.length(o).cast("long").alias("cleaned_characters"),
        F.bround(ratio, 4).alias("length_ratio"),
        F.bround("__similarity", 4).alias("similarity_ratio"),
        F.col("__explains").alias("added_explanation"),
        F.col("__thinks").alias("contains_thinking"),
        reasons.alias("reasons"),
    )
    return rated.withColumn("validation", F.when(some, record)).drop("__similarity", "__explains", "__thinks", *([score] if score else []))


def candidates(wanted: DataFrame, stored: DataFrame, *keys: str, source: str = "source") -> DataFrame:
    """wanted with state, output and validation of its stored candidate, read and checked.

    state: missing (no row), unreadable (null text), empty, invalid or valid. output is that of valid ones only;
    invalid ones keep their validation.
    """
    read = stored.select(*keys, strip(F.col("text")).alias("__text"), F.lit(True).alias("__stored"))
    joined = validated(wanted.join(read, list(keys), "left"), source, "__text")
    state = (
        F.when(F.col("__stored").isNull(), "missing")
        .when(F.col("__text").isNull(), "unreadable")
        .when(F.length("__text") == 0, "empty")
        .when(F.coalesce(F.col("validation.valid"), F.lit(False)), "valid")
        .otherwise("invalid")
    )
    return joined.withColumn("state", state).withColumn("output", F.when(F.col("state") == "valid", F.col("__text"))).drop("__text", "__stored")


def with_fallback(df: DataFrame, valid: Column, source: str = "source", output: str = "output") -> DataFrame:
    """df with status, text and rejected_text: a candidate that is not valid is replaced by its source and kept beside it."""
    ok = F.coalesce(valid, F.lit(False))
    return df.withColumns({
        "status": F.when(ok, "cleaned").otherwise("original_fallback"),
        "text": F.when(ok, F.col(output)).otherwise(F.col(source)),
        "rejected_text": F.when(~ok, F.col(output)),
    })


def revalidated(parts: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """Parents with the joined text of their parts, checked again as a whole."""
    whole = rejoined(parts, "sub_no", *keys).withColumnRenamed("text", "output")
    return validated(parents.join(whole, list(keys)), "source", "output")


def reviews(df: DataFrame) -> DataFrame:
    """Rows whose candidate was rejected, for a person to look at."""
    return df.where(~F.coalesce(F.col("validation.valid"), F.lit(False)))
