"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the base rules or the boosted trees reject go.
2. toxicity: documents that score one half or more go.
3. lines: lines that at least 10 documents share go from every text but the first that holds them, so none is lost;
   a document of which nothing is left repeats others and goes.
4. near_duplicates: of each group of documents linked at similarity 0.8 one stays.
5. packing: what is left is tokenised and packed into sequences.

Stages 1 to 4 return the columns of documents; each reads what the one before
wrote. Labels are read from sf_dir; models are fitted on the stage's own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import linededup, neardup, packing, quality, toxicity
from folioweave.llm.common import materialised, table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.drop_common_lines(docs, keep_first=True)
    left = kept.where((F.col(kept.columns[-1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).drop("cost")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Trees, segments and connected components aren't expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
