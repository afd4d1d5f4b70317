"""Files as tables, and tables as files, through Spark's readers and commit protocol only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions.text import EMPTY_PAGE, strip


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files; a leading byte order mark is dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", F.regexp_replace("text", "\\A\ufeff", ""))


def numbered_chunks(spark: SparkSession, path: str, prefix: str = "chunk", keep_empty: bool = False) -> DataFrame:
    """chunk_no, text of files named prefix_0001.txt and so on."""
    rows = texts(spark, path).withColumn("chunk_no", F.regexp_extract("path", rf"{prefix}_(\d+)[^/]*\.txt$", 1).try_cast("int")).where(F.col("chunk_no").isNotNull())
    rows = rows.select("chunk_no", strip(F.col("text")).alias("text"))
    return rows if keep_empty else rows.where(F.col("text") != "")


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, size, content of files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def marked_pages(pages: DataFrame, first: int, last: int, doc: str = "doc_id") -> DataFrame:
    """doc, text: the pages of a range with a mark before each; the range filter reaches the scan."""
    if first < 1 or last < first:
        raise ValueError("pages start at 1 and end at or after the start")
    mark = F.concat(F.lit("\n\n[[PDF_PAGE_"), F.col("page_no").cast("string"), F.lit("]]\n\n"), strip(F.col("text")))
    rows = pages.where(F.col("page_no").between(first, last)).select(doc, "page_no", mark.alias("text"))
    return _in_order(rows, doc)


def banner_pages(pages: DataFrame, first: int, last: int, doc: str = "doc_id") -> DataFrame:
    """doc, text with banner marks, total_pages, characters and the numbers of empty pages."""
    line = "=" * 68
    body = strip(F.coalesce("text", F.lit("")))
    shown = F.when(body == "", EMPTY_PAGE).otherwise(body)
    banner = F.concat(F.lit(f"\n{line}\nPDF SAYFASI: "), F.col("page_no").cast("string"), F.lit(f"\n{line}\n\n"), shown, F.lit("\n"))
    rows = pages.where(F.col("page_no").between(first, last))
    facts = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("total_pages"), F.sum(F.length(body)).alias("characters"), F.array_sort(F.collect_list(F.when(body == "", F.col("page_no")))).alias("pages_without_text"))
    return _in_order(rows.select(doc, "page_no", banner.alias("text")), doc).join(facts, doc)


def _in_order(rows: DataFrame, doc: str) -> DataFrame:
    all_ = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return all_.select(doc, strip(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text"))


def newest(jobs: DataFrame, modified: Column, *ties: str) -> DataFrame:
    """The most recently changed job: one row by a partial aggregate, no global sort."""
    return jobs.agg(F.max_by(F.struct("*"), F.struct(modified, *ties)).alias("j")).select("j.*")


def first_file(preferred: DataFrame, other: DataFrame, path: str = "path") -> DataFrame:
    """The first path by name of `preferred`, else of `other`."""
    one = preferred.agg(F.min(path).alias("p")).crossJoin(other.agg(F.min(path).alias("q")))  # one row each
    return one.select(F.coalesce("p", "q").alias(path)).where(F.col(path).isNotNull())


def layout(stored: DataFrame, fresh: DataFrame, job: str = "job") -> DataFrame:
    """Stored chunks of jobs that have any with text, fresh chunks of the others."""
    kept = stored.where(F.trim("text") != "")
    return kept.unionByName(fresh.join(kept.select(job).distinct(), job, "left_anti"))


def chunk_conflicts(fresh: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows that an idempotent write must refuse: stored with another text, or stored but not expected."""
    both = fresh.select(*keys, F.col("text").alias("new"), F.lit(True).alias("__new")).join(stored.select(*keys, F.col("text").alias("old"), F.lit(True).alias("__old")), list(keys), "full")
    reason = F.when(F.col("__new").isNull(), "unexpected").when(F.col("__old") & ~F.col("new").eqNullSafe(F.col("old")), "different")
    return both.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*keys, "reason")


def write_once(fresh: DataFrame, path: str, *keys: str) -> None:
    """Write chunks unless the folder holds them already; conflicts raise and change nothing."""
    spark = fresh.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fresh.write.parquet(path)
        return
    stored = spark.read.schema(fresh.schema).parquet(path)
    conflict = chunk_conflicts(fresh, stored, *keys).first()
    if conflict is not None:
        raise ValueError(f"stored chunks differ: {conflict.asDict()}")
    fresh.join(stored.select(*keys), list(keys), "left_anti").write.mode("append").parquet(path)


def write_versioned(fresh: DataFrame, path: str, source_hash: str, *keys: str) -> str:
    """write_once(), or where the folder holds other chunks, the same into a folder named after the source's hash; the folder written."""
    try:
        write_once(fresh, path, *keys)
        return path
    except ValueError:
        other = f"{path.rstrip('/')}_{source_hash[:12]}"
        write_once(fresh, other, *keys)
        return other


def copied_if_absent(legacy: DataFrame, target: DataFrame, name: str = "name") -> DataFrame:
    """Legacy rows whose name the target does not hold."""
    return legacy.join(target.select(name), name, "left_anti")


def output_folder(first: Column, last: Column) -> Column:
    return F.concat_ws("-", first.cast("string"), last.cast("string"))
