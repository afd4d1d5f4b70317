"""Which provider's result a job ends with, as expressions over the errors that its providers gave."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.errors import FALLS_BACK, error_class

#: Errors of the fallback that pause a job until its quota returns, and those that end it with the text alone.
PAUSES, ENDS = ("daily_quota", "rate_limit"), ("authentication", "model_not_found")


def text_route(primary_error: Column, fallback_error: Column) -> Column:
    """struct(provider, status, assembled): where a job's text comes from; errors are messages, null where all went well.

    assembled: the text is put together from the best version of each chunk. status error: the error goes to the caller.
    """
    one, two = error_class(primary_error), error_class(fallback_error)
    outcome = lambda provider, status, assembled=False: F.struct(F.lit(provider).cast("string").alias("provider"), F.lit(status).alias("status"), F.lit(assembled).alias("assembled"))
    return (
        F.when(primary_error.isNull(), outcome("primary", "completed"))
        .when(~one.isin(*FALLS_BACK), outcome(None, "error"))
        .when(fallback_error.isNull(), outcome("fallback", "completed"))
        .when(two.isin(*PAUSES), outcome("mixed_partial", "paused_quota", True))
        .when(two.isin(*ENDS), outcome("source_fallback", "completed_text_only", True))
        .otherwise(outcome(None, "error"))
    )


def speech_route(return_code: Column, status: Column, fallback_error: Column) -> Column:
    """struct(fallback, status, last_error_type): the second narrator is tried after a failure or a pause of the first; a pause outlives its failure."""
    tried = (return_code != 0) | (status == "paused_quota")
    outcome = lambda fallback, state, error=None: F.struct(F.lit(fallback).alias("fallback"), state.alias("status"), F.lit(error).cast("string").alias("last_error_type"))
    return (
        F.when(~tried, outcome(False, status))
        .when(fallback_error.isNull(), outcome(True, F.lit("completed")))
        .when(status == "paused_quota", outcome(True, status))
        .otherwise(outcome(True, F.lit("completed_text_only"), "tts_unavailable"))
    )
