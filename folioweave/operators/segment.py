"""Paragraphs, sentences, and greedy packing into bounded chunks, as columns of one row.

Documents are independent, so nothing is shuffled. Each function is one pass over a whole text by the rules of
functions/plain.py; packing is linear in the text, whatever the limit.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import plain
from folioweave.functions.plain import ABBREVIATIONS  # noqa: F401  (a rule of this module for its callers)
from folioweave.functions.text import SPACE, collapse

MAX_SPEECH, MIN_SPEECH = 2800, 500
MAX_PRIMARY, MAX_FALLBACK = 5000, 2200


def paragraphs_of(c: Column) -> Column:
    return plain.column(plain.paragraphs, plain.TEXTS, c)


def sentences_of(paragraph: Column, abbreviations: bool = True, word_boundary: bool = False) -> Column:
    """Sentences of one paragraph. A full stop that an abbreviation ends with is no mark, and no sentence starts with one.

    They are known as substrings (so "books." ends with one), or only at word starts.
    """
    return plain.column(partial(plain.sentences, abbreviations=abbreviations, word_boundary=word_boundary), plain.TEXTS, paragraph)


def packed(units: Column, limit: int, gap: str) -> Column:
    """Greedy chunks (array<string>) of (text, force) units."""
    return plain.column(partial(_packed, limit=limit, gap=gap), plain.TEXTS, units)


def _packed(units: list[dict], limit: int, gap: str) -> list[str]:
    return plain.packed(((u["text"], u["force"]) for u in units), limit, gap)


def unit(text: Column, force: Column | bool = False) -> Column:
    return F.struct(text.alias("text"), (F.lit(force) if isinstance(force, bool) else force).alias("force"))


def long_sentence_parts(sentence: Column, limit: int = MAX_SPEECH) -> Column:
    """A sentence over the limit split after clause marks, then at words; a word over the limit stays whole."""
    return plain.column(partial(plain.long_sentence_parts, limit=limit), plain.TEXTS, sentence)


def speech_records(c: Column, limit: int = MAX_SPEECH) -> Column:
    """Array of (sentence, paragraph_end) over all paragraphs of a whole text, long sentences in parts."""
    return plain.column(partial(plain.speech_records, limit=limit), plain.RECORDS, c)


def merged_tail(chunks: Column, limit: int, least: int) -> Column:
    """A last chunk under `least` joined to the one before, if both fit."""
    return plain.column(partial(plain.merged_tail, limit=limit, least=least), plain.TEXTS, chunks)


def _speech(f, kind, c: Column, limit: int, least: int) -> Column:
    if limit < 200 or not 0 <= least < limit:
        raise ValueError("the limit is at least 200, and the least length from 0 to below the limit")
    return plain.column(partial(f, limit=limit, least=least), kind, c)


def speech_chunks(c: Column, limit: int = MAX_SPEECH, least: int = MIN_SPEECH) -> Column:
    """Chunks (array<string>) of a whole text for narration: sentences whole, paragraph ends preferred."""
    return _speech(plain.speech_chunks, plain.TEXTS, c, limit, least)


def speech_counts(c: Column, limit: int = MAX_SPEECH, least: int = MIN_SPEECH) -> Column:
    """Array of (characters, words) of the chunks of speech_chunks(), for callers that need no text of them."""
    return _speech(plain.speech_counts, plain.COUNTS, c, limit, least)


def speech_covered(c: Column, limit: int = MAX_SPEECH, least: int = MIN_SPEECH) -> Column:
    """Whether the chunks of speech_chunks() hold the text, white space apart: an array of one, empty without chunks."""
    return _speech(plain.speech_covered, plain.TRUTHS, c, limit, least)


def service_chunks(c: Column, limit: int = MAX_PRIMARY, cut_words: bool = False) -> Column:
    """Chunks (array<string>) of a whole text for a cleaning service: paragraphs, then sentences, then words.

    cut_words: a word over the limit is cut at it; else it stays whole.
    """
    if cut_words and limit < 500:
        raise ValueError("the limit is at least 500")
    return plain.column(partial(plain.service_chunks, limit=limit, cut_words=cut_words), plain.TEXTS, c)


def chunk_warnings(chunk: Column, limit: int = MAX_SPEECH) -> Column:
    broken = chunk.contains("-") & chunk.rlike(rf"[A-Za-zÇĞİÖŞÜçğıöşü]-{SPACE}*\n[a-zçğıöşü]")
    tests = ((~chunk.rlike(rf"[^{SPACE[1:-1]}]"), "empty"), (F.length(chunk) > limit, "over_limit"), (chunk.contains("­"), "soft_hyphen"), (broken, "broken_word"))
    return F.array_compact(F.array(*[F.when(t, name) for t, name in tests]))


def exploded(df: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """One row a chunk: keys, chunk_no from 1, text."""
    return df.select(*keys, F.posexplode(chunks).alias("p", "text")).select(*keys, (F.col("p") + 1).alias("chunk_no"), "text")


def two_level_chunks(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """keys, chunk_no, sub_no, text: the primary service's chunks cut again for the fallback service."""
    outer = df.select(*keys, F.posexplode(plain.column(partial(plain.two_level_chunks, outer=MAX_PRIMARY, inner=MAX_FALLBACK), plain.LEVELS, F.col(text))).alias("p", "inner"))
    inner = outer.select(*keys, (F.col("p") + 1).alias("chunk_no"), F.posexplode("inner").alias("q", "text"))
    return inner.select(*keys, "chunk_no", (F.col("q") + 1).alias("sub_no"), "text")


def rejoined(parts: DataFrame, order: str, *keys: str) -> DataFrame:
    """Parts of each key joined by an empty line, in order."""
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("all"))
    return rows.select(*keys, F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"))


def counted(df: DataFrame, text: str = "text", key: str = "doc_id", limit: int = MAX_SPEECH, least: int = MIN_SPEECH) -> DataFrame:
    """A row per chunk: key, chunk_no, characters, words."""
    rows = df.select(key, F.posexplode(speech_counts(F.col(text), limit, least)).alias("p", "c"))
    return rows.select(key, (F.col("p") + 1).alias("chunk_no"), "c.characters", "c.words")


def manifest(df: DataFrame, text: str = "text", key: str = "doc_id", limit: int = MAX_SPEECH, least: int = MIN_SPEECH) -> DataFrame:
    """A row per chunk: key, chunk_no, characters, words, audio_file."""
    return counted(df, text, key, limit, least).withColumn("audio_file", F.format_string("tts_chunk_%04d.mp3", "chunk_no"))


def manifest_totals(rows: DataFrame, key: str = "doc_id", limit: int = MAX_SPEECH) -> DataFrame:
    """A row per document of manifest(): maximum_characters, total_chunks, total_characters, total_words."""
    return rows.groupBy(key).agg(F.lit(limit).cast("long").alias("maximum_characters"), F.count(F.lit(1)).alias("total_chunks"), F.sum("characters").alias("total_characters"), F.sum("words").alias("total_words"))


def covered(source: Column, chunks: Column) -> Column:
    """Whether the chunks hold the source's text, white space apart."""
    return collapse(source) == collapse(F.array_join(chunks, " "))
