"""The end-to-end plan: documents to a narration plan, with pluggable services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions.text import precleaned_pages
from folioweave.operators import audio, choose, rewrite, segment
from folioweave.sources import services


def cleaned_chunks(docs: DataFrame, cleaner: services.Cleaner = services.identity_cleaner, key: str = "doc_id") -> DataFrame:
    """key, chunk_no, text, status: service chunks, cleaned where the result passes the checks, else the source."""
    # One expression, so one Python worker takes a text through both steps.
    source = segment.exploded(docs, segment.service_chunks(precleaned_pages(F.col("text"))), key).withColumnRenamed("text", "source")
    done = rewrite.validated(services.applied(source, cleaner, "source", "output", "string", score=("ratio", rewrite.scored)), score="ratio")
    return rewrite.with_fallback(done, F.col("validation.valid")).select(key, "chunk_no", "text", "status")


def narrated(docs: DataFrame, cleaner: services.Cleaner = services.identity_cleaner, minutes: float | None = None, key: str = "doc_id") -> DataFrame:
    """key, chunk_no, characters, words, frames, start_frame, end_frame of the chunks within the budget.

    One exchange: parts of a document meet to be joined; the later windows use the same partitioning by key.
    """
    whole = segment.rejoined(cleaned_chunks(docs, cleaner, key), "chunk_no", key)
    chosen = choose.within_budget(segment.counted(whole, "text", key), F.lit(True), F.col("words"), minutes, job=key)
    planned = audio.concat_plan(chosen.withColumn("frames", F.col("words") * 9600), job=key)
    return planned.select(key, "chunk_no", "characters", "words", "frames", "start_frame", "end_frame")
