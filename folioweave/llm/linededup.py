"""Removal of lines that many documents share, in DataFrame functions alone.

Lines are exploded as 128-bit hashes of their normalised form, once a document,
and counted (partial counts first, so a line found everywhere is one row a
task). A second pass joins line hashes with the frequent ones; Spark can split
that join at a hot line, since each side is a plain exchange. Positions to drop
are grouped by document and joined with the texts, which cross the network once
and are reassembled by position.

Which lines go depends on the text alone, so documents are matched by the
128-bit fingerprint of doc_id and text: repeated doc_ids and null doc_ids
need no care, and identical rows share one entry. Counted is each row as a document.

Defined results: null and empty texts are one empty line, which stays; a text
whose lines all go is empty; drop_common_lines() keeps extra columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

# What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped and with A-Z lower-cased; plain lower() does it where all is ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def free_name(name: str, taken: list[str]) -> str:
    """name, or with underscores after it until no other column is called so."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def drop_common_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with new text, and the columns line_total, line_dropped (long; underscores are added where docs has such a column).

    keep_first: the document of the least doc_id (null last) keeps its common lines, so that no line is lost to the corpus.
    """
    text = text_or_empty()
    lines = lambda t: F.split(t, "\n", -1)
    ident = [F.xxhash64("doc_id", text).alias("d1"), F.xxhash64(F.lit("second"), "doc_id", text).alias("d2")]
    long_enough = lambda k: F.char_length(k) >= min_chars
    hashes = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"))
    keys = F.transform(lines(text), lambda x: line_key(x))

    holder = [F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *ident).alias("holder")] if keep_first else []
    once = docs.select(*holder, F.explode(F.array_distinct(F.filter(keys, long_enough))).alias("k")).select(*["holder"] * keep_first, hashes(F.col("k")).alias("h"))
    first = [F.min("holder").alias("first")] if keep_first else []
    common = once.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n"), *first).where(F.col("n") >= min_documents)
    common = common.select("h1", "h2", *[F.col(f"first.{x}").alias(f"first_{x}") for x in ("d1", "d2")] * keep_first)

    placed = docs.select(*ident, F.posexplode(keys).alias("pos", "k")).where(long_enough(F.col("k")))
    placed = placed.select("d1", "d2", "pos", hashes(F.col("k")).alias("h")).select("d1", "d2", "pos", "h.h1", "h.h2").join(common, ["h1", "h2"])
    if keep_first:
        placed = placed.where("d1 <> first_d1 OR d2 <> first_d2")
    gone = placed.groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))

    # The source row travels as one struct, so that no name of its columns can clash with these.
    joined = docs.select(F.struct("*").alias("row"), text.alias("t"), *ident).join(gone, ["d1", "d2"], "left")
    # A value that lambdas share is the element of an array of one, else each call would split the text again.
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines(F.col("t"))) - 1), F.col("gone"))
    left = F.get(F.transform(F.array(lines(F.col("t"))), lambda x: F.array_join(F.transform(stays, lambda i: F.get(x, i)), "\n")), F.lit(0))
    rest = F.when(F.col("gone").isNull(), F.col("t")).otherwise(left)
    counts = [F.size(lines(F.col("t"))).cast("long").alias(free_name("line_total", docs.columns)), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(free_name("line_dropped", docs.columns))]
    return joined.select(*[rest.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], *counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("line_total").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
