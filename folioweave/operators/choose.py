"""Choosing among versions of ordered chunks: best available, missing, unexpected, valid prefix, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions.text import strip
from folioweave.operators.segment import rejoined


def best_available(source: DataFrame, primary: DataFrame, fallback: DataFrame, job: str = "job", no: str = "chunk_no") -> DataFrame:
    """source with `text` and `provider` of the first valid version: primary, fallback, source.

    primary and fallback hold job, chunk_no, text of valid candidates only.
    """
    keys = [job, no]
    one, two = (d.select(*keys, F.col("text").alias(name)) for d, name in ((primary, "__one"), (fallback, "__two")))
    joined = source.join(one, keys, "left").join(two, keys, "left")
    provider = F.when(F.length("__one") > 0, "primary").when(F.length("__two") > 0, "fallback").otherwise("source")
    text = F.when(F.length("__one") > 0, F.col("__one")).when(F.length("__two") > 0, F.col("__two")).otherwise(F.col("text"))
    return joined.withColumns({"provider": provider, "__text": text}).drop("text", "__one", "__two").withColumnRenamed("__text", "text")


def assembled(chosen: DataFrame, job: str = "job", no: str = "chunk_no") -> DataFrame:
    """A row per job: text, total_chunks, cleaned_chunks, source_fallback_chunks."""
    counts = chosen.groupBy(job).agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("provider") != "source").alias("cleaned_chunks"), F.count_if(F.col("provider") == "source").alias("source_fallback_chunks"))
    return rejoined(chosen, no, job).withColumn("text", strip(F.col("text"))).join(counts, job)


def missing(expected: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return expected.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def unexpected(stored: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    return missing(stored, expected, *keys)


def valid_prefix(df: DataFrame, valid: Column, job: str = "job", no: str = "chunk_no") -> DataFrame:
    """Rows of each job before its first row that is not valid; a partial aggregate and a join, no window over a whole job."""
    bad = df.where(~F.coalesce(valid, F.lit(False))).groupBy(job).agg(F.min(no).alias("__bad"))
    return df.join(bad, job, "left").where(F.col("__bad").isNull() | (F.col(no) < F.col("__bad"))).drop("__bad")


def first_n(df: DataFrame, n: int, job: str = "job", no: str = "chunk_no") -> DataFrame:
    order = Window.partitionBy(job).orderBy(no)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def within_budget(df: DataFrame, absent: Column, words: Column, minutes: float | None = None, per_minute: float = 150.0, limit: int | None = None, job: str = "job", no: str = "chunk_no") -> DataFrame:
    """Rows up to the first absent one that finds the words of earlier absent rows at the target; stored rows are free.

    A limit overrides the target. The stop test is a running maximum, so one window does it.
    """
    if limit is not None:
        return first_n(df, limit, job, no)
    if minutes is None:
        return df
    order = Window.partitionBy(job).orderBy(no)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(absent, F.lit(True))
    counted = df.withColumns({"__gone": gone, "__words": F.when(gone, words).otherwise(0)})
    prior = F.coalesce(F.sum("__words").over(before), F.lit(0))
    stopped = counted.withColumn("__stop", F.col("__gone") & (prior >= F.lit(minutes * per_minute)))
    flagged = stopped.withColumn("__over", F.max("__stop").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return flagged.where(~F.col("__over")).drop("__gone", "__words", "__stop", "__over")


def within_run_budget(df: DataFrame, absent: Column, words: Column, minutes: float | None = None, per_minute: float = 150.0, limit: int | None = None, made: Column | None = None, job: str = "job", no: str = "chunk_no") -> DataFrame:
    """The first `limit` rows, then up to the first absent one that finds the words made in this run at the target.

    made: whether an absent row's result was made (a failure adds no words); the row that stops is not kept.
    """
    rows = df if limit is None else first_n(df, limit, job, no)
    if minutes is None:
        return rows
    counted = F.when(F.lit(True) if made is None else F.coalesce(made, F.lit(False)), words).otherwise(0)
    return within_budget(rows, absent, counted, minutes, per_minute, None, job, no)


def token_budget(text: Column) -> Column:
    """Tokens that a service may answer with for a chunk of text."""
    wanted = F.floor(F.greatest(F.lit(1), F.floor(F.length(text) / 3)) * F.lit(1.35)).cast("long") + 256
    return F.greatest(F.lit(512), F.least(wanted, F.lit(2048))).cast("long")
