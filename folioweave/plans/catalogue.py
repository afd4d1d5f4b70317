"""The queries over the test tables, each with the DuckDB statement it is held against (None: rows only).

Inputs that the tables lack (page marks, candidates, stored files, states) are
made from them by the same deterministic rules on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import errors, identity, text
from folioweave.operators import audio, choose, jobs, rewrite, segment
from folioweave.plans import sql as q
from folioweave.sources import files, services

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(statement: str | None = None):
    """Register a function of the tables' reader under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if statement:
            ORACLES[f.__name__] = statement
        return f

    return add


# ------------------------------------------------------------------ normalisation

NOISY = "replace(replace(replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || ' '), 'en', 'e' || chr(173) || 'n'), ', ', '  , ')"
def noisy() -> Column:
    return F.expr(NOISY.replace("chr(173)", "'­'"))

PAGED = "replace(text, chr(10), chr(10) || chr(10))"


@query(f"SELECT doc_id, {q.normalised(NOISY)} AS text FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", text.normalised(noisy()).alias("text"))


BROKEN = "replace(replace(text, 'er', 'e-' || chr(10) || ' r'), '. ', chr(10) || repeat('=', 68) || chr(10) || 'PDF sayfası: 12' || chr(10) || repeat('=', 24))"


@query(f"SELECT doc_id, {q.rr(q.no_soft_hyphen(q.line_feeds(BROKEN)), '([' + chr(92) + 'p{L}])-[ ' + chr(92) + 't]*' + chr(10) + '[ ' + chr(92) + 't]*([' + chr(92) + 'p{L}])', chr(92) + '1' + chr(92) + '2')} AS text FROM documents")
def word_break_repair(t):
    return t("documents").select("doc_id", text.word_breaks_repaired(F.expr(BROKEN)).alias("text"))


@query(f"SELECT doc_id, {q.rr(q.rr(BROKEN, '={20,}', chr(10)), '(?i)PDF SAYFAS[Iı]:' + chr(92) + 's*' + chr(92) + 'd+', chr(10))} AS text FROM documents")
def page_marker_strip(t):
    return t("documents").select("doc_id", text.page_banners_removed(F.expr(BROKEN)).alias("text"))


NUMBERED = "replace(text, '. ', chr(10) || (doc_id % 2000)::VARCHAR || chr(10) || '- 9 -' || chr(10))"
NUMBER = r"^(\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])$"
LINES = f"(SELECT doc_id, unnest(string_split({NUMBERED}, chr(10))) AS line, unnest(range(1, len(string_split({NUMBERED}, chr(10))) + 1)) AS line_no FROM documents)"
def numbered() -> Column:
    return F.expr("replace(text, '. ', concat(chr(10), cast(doc_id % 2000 as string), chr(10), '- 9 -', chr(10)))")



@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*)::BIGINT AS kept FROM {LINES} WHERE NOT regexp_matches({q.strip('line')}, '{NUMBER}') GROUP BY doc_id")
def strip_noise_lines(t):
    lines = F.filter(F.split(numbered(), "\n"), lambda x: ~text.is_page_number(x))
    return t("documents").select("doc_id", F.array_join(lines, "\n").alias("text"), F.size(lines).cast("long").alias("kept"))


@query(f"SELECT doc_id, count(*) FILTER ({q.heading('line')})::BIGINT AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def heading_flag(t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), text.is_heading)).cast("long").alias("headings"))


@query(f"SELECT doc_id, {q.rr('translate(upper(replace(text, ' + chr(39) + 'ß' + chr(39) + ', ' + chr(39) + 'ss' + chr(39) + ')), ' + chr(39) + 'İÜŞĞÖÇ' + chr(39) + ', ' + chr(39) + 'IUSGOC' + chr(39) + ')', chr(92) + 's+')} AS header_key FROM documents")
def header_key(t):
    return t("documents").select("doc_id", text.header_key(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("header_key"))


WRAPPED = f"replace(replace(replace(text, '. ', '.' || chr(10)), ', ', '-' || chr(10)), ' of ', chr(10) || '- ')"
def wrapped() -> Column:
    return F.expr("replace(replace(replace(text, '. ', concat('.', chr(10))), ', ', concat('-', chr(10))), ' of ', concat(chr(10), '- '))")

BULLET = r"^[-•]\s+"


def joined_sql(marks: bool) -> str:
    """CTEs from k(doc_id, i, x), lines in order, to j(doc_id, text), paragraphs; with marks bullets and headings are seen."""
    bullet, heading = (f"regexp_matches(x, '{BULLET}')", q.heading("x")) if marks else ("FALSE", "FALSE")
    return f"""kk AS (SELECT *, x = '' AS e, {bullet} AS b, {heading} AS h FROM k),
n AS (SELECT *, lag(x) OVER w AS px, lag(e) OVER w AS pe, lag(h AND NOT b) OVER w AS ph, lead(e OR b OR h) OVER w AS no FROM kk WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, CASE WHEN e THEN '' ELSE CASE WHEN px IS NULL OR pe OR ph OR b OR h THEN chr(10) || chr(10) WHEN px LIKE '%-' THEN '' ELSE ' ' END
  || CASE WHEN x LIKE '%-' AND NOT (h AND NOT b) AND NOT coalesce(no, TRUE) THEN left(x, length(x) - 1) ELSE x END END AS s FROM n),
j AS (SELECT doc_id, regexp_replace(string_agg(s, '' ORDER BY i), '^\\n+', '') AS text FROM p GROUP BY doc_id)"""


def lines_sql(source: str) -> str:
    """CTE l(doc_id, i, x): tidy lines of a text."""
    return f"""w AS (SELECT doc_id, regexp_replace({source}, '\\n$', '') AS w FROM documents),
l AS (SELECT doc_id, i, {q.rr(q.strip('x'), '[ ' + chr(92) + 't]+', ' ')} AS x FROM (SELECT doc_id, unnest(string_split(w, chr(10))) AS x, unnest(range(1, len(string_split(w, chr(10))) + 1)) AS i FROM w))"""


@query(f"""
WITH k AS (SELECT doc_id, {q.strip('unnest(string_split(w, chr(10)))')} AS x, unnest(range(1, len(string_split(w, chr(10))) + 1)) AS i FROM (SELECT doc_id, {WRAPPED} AS w FROM documents)),
{joined_sql(True)}
SELECT doc_id, text FROM j""")
def join_wrapped(t):
    return t("documents").select("doc_id", text.joined_lines(F.split(wrapped(), "\n")).alias("text"))


LOOSE = "replace(replace(replace(text, 'n', 'n' || chr(39) || ' '), ',', '  ,'), '.', ' .' || chr(10) || chr(10) || chr(10) || chr(10))"
LOOSE_SQL = q.rr(q.rr(q.rr(q.no_soft_hyphen(LOOSE), '[ ' + chr(92) + 't]{2,}', ' '), chr(10) + '{3,}', chr(10) * 2), '[ ' + chr(92) + 't]+([,.;:!?])', chr(92) + '1')
# An apostrophe loses the blanks after it between two word characters; a second pass sees those that share one.
APOSTROPHE = (r"([\p{L}\p{N}_])'[ \t]+([\p{L}\p{N}_])", r"\1'\2")


@query(f"SELECT doc_id, {q.strip(q.rr(q.rr(LOOSE_SQL, *APOSTROPHE), *APOSTROPHE))} AS text FROM documents")
def final_cleanup(t):
    return t("documents").select("doc_id", text.finally_clean(F.expr(LOOSE)).alias("text"))


KEY = q.rr("translate(upper(x), 'İÜŞĞÖÇ', 'IUSGOC')", chr(92) + "s+")
BANNERED = f"replace({BROKEN}, ' of ', chr(10) || 'Snop luk' || chr(10) || '- ')"
BANNERS_GONE = q.rr(q.rr(BANNERED, "={20,}", "\n"), "(?i)PDF SAYFAS[Iı]:" + chr(92) + "s*" + chr(92) + "d+", "\n")
MENDED = q.rr(q.no_soft_hyphen(q.line_feeds(BANNERS_GONE)), r"([\p{L}])-[ \t]*\n[ \t]*([\p{L}])", r"\1\2")
TIDIED = q.rr(q.rr(q.rr(q.no_soft_hyphen("text"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"[ \t]+([,.;:!?])", r"\1")


@query(f"""WITH {lines_sql(MENDED)},
k AS (SELECT * FROM l WHERE NOT regexp_matches(x, '{NUMBER}') AND {KEY} <> 'SNOPLUK'),
{joined_sql(True)}
SELECT doc_id, coalesce({q.strip(q.rr(q.rr(TIDIED, *APOSTROPHE), *APOSTROPHE))}, '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN j USING (doc_id)""")
def preclean(t):
    return t("documents").select("doc_id", text.precleaned(F.expr(BANNERED), headers=("SNOPLUK",)).alias("text"))


MARKED = f"'[[PDF_PAGE_1]]' || chr(10) || replace({NUMBERED.replace('::VARCHAR', '')}, ' of ', chr(10) || 'ISBN 12' || chr(10) || 'see www.x.org' || chr(10) || 'Snop luk' || chr(10) || '[[PDF_PAGE_2]]' || chr(10))"
UNMARKED = q.rr(q.no_soft_hyphen(q.line_feeds(MARKED)), r"\[\[PDF_PAGE_\d+\]\]", "\n")


@query(f"""WITH {lines_sql(UNMARKED)},
k AS (SELECT * FROM l WHERE x = '' OR NOT (regexp_matches(x, '^\\d{{1,4}}$') OR {KEY} IN ('STATUENDISESI', 'SNOPLUK', 'SEVGISIZLIK') OR regexp_matches(x, '(?i)\\bISBN\\b') OR regexp_matches(x, '(?i)https?://|www\\.|@[\\p{{L}}\\p{{N}}_]+'))),
{joined_sql(False)}
SELECT doc_id, coalesce({q.strip(q.rr(q.rr('text', '[ ' + chr(92) + 't]{2,}', ' '), chr(10) + '{3,}', chr(10) * 2))}, '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN j USING (doc_id)""")
def preclean_pages(t):
    return t("documents").select("doc_id", text.precleaned_pages(F.expr(MARKED)).alias("text"))


@query(f"""
WITH p AS (SELECT conv_id, turn, unnest(string_split({PAGED}, {q.LF2})) AS p, unnest(range(1, len(string_split({PAGED}, {q.LF2})) + 1)) AS i FROM conversations),
c AS (SELECT conv_id, turn, i, {q.strip('p')} AS p FROM p WHERE {q.strip('p')} <> ''),
b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS block_no, p,
  CASE WHEN p LIKE '- %' THEN 'bullet' WHEN length(p) <= 80 AND ({q.heading('p', 0.75)} OR NOT regexp_matches(p, '[.?!;:]$')) THEN 'heading' ELSE 'body' END AS kind FROM c)
SELECT conv_id, turn, block_no, kind, replace(replace(replace(CASE WHEN kind = 'bullet' THEN {q.strip('p[3:]')} ELSE p END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM b""")
def readaloud_blocks(t):
    rows = t("conversations").select("conv_id", "turn", F.posexplode(text.reading_blocks(F.expr(PAGED))).alias("p", "b"))
    return rows.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("block_no"), "b.kind", "b.text")


ANSWER = "'<think>' || role || chr(10) || '</think> ' || chr(96) || chr(96) || chr(96) || 'text' || chr(10) || 'Çıktı: ' || text || '  .' || chr(10) || chr(96) || chr(96) || chr(96)"
CLEAN = q.strip(q.rr(q.rr(q.rr(q.no_soft_hyphen("a"), r"[ \t]{2,}", " "), r"[ \t]+([,.;:!?])", r"\1"), "\n{3,}", "\n\n"))


@query(f"SELECT conv_id, turn, {CLEAN} AS text, {CLEAN.replace('(a,', '(b,')} AS fenced FROM (SELECT conv_id, turn, {q.strip('text')} || '  .' AS a, 'Çıktı: ' || text || '  .' AS b FROM conversations)")
def response_unwrap(t):
    fence = F.concat(F.lit("```text\nÇıktı: "), "text", F.lit("  .\n```"))
    thought = F.concat(F.lit("<think>"), "role", F.lit("\n</think> "), fence)
    return t("conversations").select("conv_id", "turn", text.thinking_answer_cleaned(thought).alias("text"), text.answer_cleaned(fence).alias("fenced"))


# ------------------------------------------------------------------- segmentation


def sentence_sql(mask: bool) -> str:
    masks = q.masks(segment.ABBREVIATIONS)
    inside = q.masked(q.strip("text"), masks) if mask else q.strip("text")
    out = q.masked("s", masks, back=True) if mask else "s"
    return f"""WITH s AS (SELECT doc_id, unnest({q.marked_sentences(inside)}) AS s, unnest(range(1, len({q.marked_sentences(inside)}) + 1)) AS i FROM documents),
c AS (SELECT doc_id, i, {q.collapse(out)} AS sentence FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sentence_no, sentence FROM c WHERE sentence <> ''"""


def sentence_rows(docs: DataFrame, mask: bool) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(segment.sentences_of(F.col("text"), mask)).alias("p", "sentence"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("sentence_no"), "sentence")


@query(sentence_sql(False))
def sentences(t):
    return sentence_rows(t("documents"), False)


@query(sentence_sql(True))
def sentences_masked(t):
    return sentence_rows(t("documents"), True)


def paragraph_sql(source: str) -> str:
    """CTEs pa(doc_id, g, p) of paragraphs of normalised text and se(k, i, t, pe) of their masked sentences."""
    masks = q.masks(segment.ABBREVIATIONS)
    marked = q.marked_sentences(q.masked("p", masks))
    return f"""pa AS (SELECT doc_id, g, {q.strip('p')} AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(n, '\\n\\s*\\n')) AS p, unnest(range(1, len(regexp_split_to_array(n, '\\n\\s*\\n')) + 1)) AS g FROM (SELECT doc_id, {q.normalised(source)} AS n FROM documents)) WHERE {q.strip('p')} <> ''),
s0 AS (SELECT doc_id, g, unnest({marked}) AS s, unnest(range(1, len({marked}) + 1)) AS j FROM pa),
s1 AS (SELECT doc_id, g, j, {q.collapse(q.masked('s', masks, back=True))} AS t FROM s0),
se AS (SELECT doc_id AS k, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) AS i, t, j = max(j) OVER (PARTITION BY doc_id, g) AS pe FROM s1 WHERE t <> '')"""


def long_sql(limit: int) -> str:
    """CTEs up to lp(k, i, t, pe): sentences with long ones cut."""
    clause = f"string_split({q.rr('t', '([;:,])' + chr(92) + 's+', chr(92) + '1' + chr(30))}, chr(30))"
    return f"""lo AS (SELECT k || '/' || i AS k, k AS d, i AS si, t FROM se WHERE length(t) > {limit}),
cl AS (SELECT k, unnest({clause}) AS t, unnest(range(1, len({clause}) + 1)) AS p FROM lo),
{q.word_units('lu', 'cl', limit)},
{q.greedy('lg', 'lu', limit, 1)},
lc AS (SELECT lo.d AS k, lo.si, c, string_agg(lg.t, ' ' ORDER BY lg.i) AS t FROM lg JOIN lo USING (k) GROUP BY ALL),
lp0 AS (SELECT k, i AS si, 0 AS c, t, pe FROM se WHERE length(t) <= {limit}
  UNION ALL SELECT lc.k, lc.si, lc.c, lc.t, se.pe AND lc.c = max(lc.c) OVER (PARTITION BY lc.k, lc.si) FROM lc JOIN se ON se.k = lc.k AND se.i = lc.si),
lp AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY si, c) AS i, t, FALSE AS force, pe FROM lp0)"""


def speech_sql(source: str, limit: int, least: int) -> str:
    """CTEs up to ch(doc_id, chunk_no, text): speech chunks with a small tail merged."""
    return f"""WITH RECURSIVE {paragraph_sql(source)},
{long_sql(limit)},
{q.greedy('sp', 'lp', limit, 1, least)},
sc AS (SELECT k, c, {q.strip("string_agg(t || CASE WHEN pe THEN chr(10) || chr(10) ELSE '' END, ' ' ORDER BY i)")} AS t FROM sp GROUP BY k, c),
sn AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY c) AS no, count(*) OVER (PARTITION BY k) AS n, t, lead(t) OVER (PARTITION BY k ORDER BY c) AS nt FROM sc),
sm AS (SELECT k, no, n, t, nt, n >= 2 AND no = n - 1 AND length(nt) < {least} AND length(t) + 2 + length(nt) <= {limit} AS m FROM sn),
ch AS (SELECT k AS doc_id, no AS chunk_no, CASE WHEN m THEN t || chr(10) || chr(10) || nt ELSE t END AS text FROM sm a WHERE NOT (no = n AND EXISTS (SELECT 1 FROM sm b WHERE b.k = a.k AND b.m)))
"""


def speech_rows(t, source: str, limit: int, least: int) -> DataFrame:
    return segment.exploded(t("documents"), segment.speech_chunks(F.expr(source), limit, least), "doc_id").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


@query(speech_sql("text", segment.MAX_SPEECH, segment.MIN_SPEECH) + "SELECT doc_id, chunk_no, text FROM ch")
def tts_chunks(t):
    return speech_rows(t, "text", segment.MAX_SPEECH, segment.MIN_SPEECH)


@query(speech_sql(PAGED, 300, 120) + "SELECT doc_id, chunk_no, text FROM ch")
def tts_chunks_small(t):
    return speech_rows(t, PAGED, 300, 120)


WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(speech_sql(PAGED, segment.MAX_SPEECH, segment.MIN_SPEECH) + f"SELECT doc_id, chunk_no, length(text)::BIGINT AS characters, {WORDS}::BIGINT AS words, 'tts_chunk_' || lpad(chunk_no::VARCHAR, 4, '0') || '.mp3' AS audio_file FROM ch")
def tts_manifest(t):
    rows = segment.manifest(t("documents").select("doc_id", F.expr(PAGED).alias("text")))
    return rows.withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(f"WITH RECURSIVE {paragraph_sql('text')},\n{long_sql(60)}\nSELECT k AS doc_id, i AS part_no, t AS part, pe AS paragraph_end FROM lp")
def long_sentence_parts(t):
    rows = t("documents").select("doc_id", F.posexplode(segment.speech_records(F.col("text"), 60)).alias("p", "r"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("part_no"), F.col("r.sentence").alias("part"), F.col("r.paragraph_end").alias("paragraph_end"))


def service_sql(source: str, limit: int, cut: bool, table: str = "documents") -> str:
    end = f"string_split({q.rr('p', '([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(30))}, chr(30))"
    whole = q.strip(q.line_feeds(source) if cut else source)
    return f"""WITH RECURSIVE pa AS (SELECT doc_id || '/' || g AS k, doc_id, g, {q.strip('p')} AS p FROM (SELECT doc_id, unnest(regexp_split_to_array({whole}, '\\n\\s*\\n')) AS p, unnest(range(1, len(regexp_split_to_array({whole}, '\\n\\s*\\n')) + 1)) AS g FROM {table}) WHERE {q.strip('p')} <> ''),
cl AS (SELECT k, {q.strip(f'unnest({end})')} AS t, unnest(range(1, len({end}) + 1)) AS p FROM pa WHERE length(p) > {limit}),
{q.word_units('lu', 'cl', limit, cut)},
{q.greedy('lg', 'lu', limit, 1)},
lc AS (SELECT pa.doc_id, pa.g, c, string_agg(lg.t, ' ' ORDER BY lg.i) AS t FROM lg JOIN pa USING (k) GROUP BY ALL),
un AS (SELECT doc_id AS k, row_number() OVER (PARTITION BY doc_id ORDER BY g, c) AS i, t, FALSE AS force, FALSE AS pe FROM (SELECT doc_id, g, 0 AS c, p AS t FROM pa WHERE length(p) <= {limit} UNION ALL SELECT * FROM lc)),
{q.greedy('pk', 'un', limit, 2)}
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY c) AS chunk_no, {q.strip(f"string_agg(t, {q.LF2} ORDER BY i)")} AS text FROM pk GROUP BY k, c"""


def service_rows(t, source: Column, limit: int, cut: bool) -> DataFrame:
    return segment.exploded(t("documents"), segment.service_chunks(source, limit, cut), "doc_id").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


@query(service_sql("text", segment.MAX_PRIMARY, False))
def llm_chunks_5000(t):
    return service_rows(t, F.col("text"), segment.MAX_PRIMARY, False)


@query(service_sql("text", segment.MAX_FALLBACK, True))
def llm_chunks_2200(t):
    return service_rows(t, F.col("text"), segment.MAX_FALLBACK, True)


LONG_WORDS = "replace(replace(text, chr(10), chr(10) || chr(10)), ' and ', repeat('x', 620))"


@query(service_sql(LONG_WORDS, 500, True))
def llm_chunks_cut_words(t):
    return service_rows(t, F.expr(LONG_WORDS), 500, True)


LEVELS = f"""WITH outer_chunks AS MATERIALIZED ({service_sql('text', segment.MAX_PRIMARY, False)}),
keyed AS MATERIALIZED (SELECT doc_id || '/' || chunk_no AS doc_id, text FROM outer_chunks),
inner_chunks AS ({service_sql('text', segment.MAX_FALLBACK, True, 'keyed')})
SELECT split_part(doc_id, '/', 1)::BIGINT AS doc_id, split_part(doc_id, '/', 2)::BIGINT AS chunk_no, chunk_no AS sub_no, text FROM inner_chunks"""


@query(LEVELS)
def two_level_chunks(t):
    rows = segment.two_level_chunks(t("documents"), "text", "doc_id")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("chunk_no", "sub_no")})


FAULTY = """CASE chunk_no % 4 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN replace(text, 'a', 'a' || chr(173)) WHEN 2 THEN replace(text, 'er', 'e-' || chr(32) || chr(10) || 'r') ELSE text END"""


@query(speech_sql(PAGED, 300, 120) + f"""SELECT doc_id, chunk_no, concat_ws(',', CASE WHEN NOT regexp_matches(x, '\\S') THEN 'empty' END, CASE WHEN length(x) > 200 THEN 'over_limit' END,
CASE WHEN contains(x, chr(173)) THEN 'soft_hyphen' END, CASE WHEN regexp_matches(x, '[A-Za-zÇĞİÖŞÜçğıöşü]-\\s*\\n[a-zçğıöşü]') THEN 'broken_word' END) AS warnings, length(x)::BIGINT AS characters FROM (SELECT doc_id, chunk_no, {FAULTY} AS x FROM ch)""")
def chunk_warnings(t):
    rows = speech_rows(t, PAGED, 300, 120).withColumn("text", F.expr(FAULTY.replace("chr(173)", "'\u00ad'")))
    return rows.select("doc_id", "chunk_no", F.array_join(segment.chunk_warnings(F.col("text"), 200), ",").alias("warnings"), F.length("text").cast("long").alias("characters"))


@query(speech_sql("text", segment.MAX_SPEECH, segment.MIN_SPEECH) + f"SELECT d.doc_id, {q.collapse('d.text')} = {q.collapse('c.all_')} AS covered FROM documents d JOIN (SELECT doc_id, string_agg(text, ' ' ORDER BY chunk_no) AS all_ FROM ch GROUP BY doc_id) c USING (doc_id)")
def coverage_check(t):
    # A generator, unlike a filter, makes Spark evaluate the chunks once.
    return t("documents").select("doc_id", F.explode(segment.speech_covered(F.col("text"))).alias("covered"))


# ------------------------------------------------------------- rewrites and quality

REWRITE = "regexp_replace(CASE WHEN doc_id % 3 = 0 THEN left(text, length(text) * 4 // 5) ELSE text END, '[ \\t]+', ' ', 'g')"
def rewrite_of() -> Column:
    return F.regexp_replace(F.when(F.col("doc_id") % 3 == 0, F.substring("text", F.lit(1), F.floor(F.length("text") * 4 / 5).cast("int"))).otherwise(F.col("text")), r"[ \t]+", " ")



@query(f"SELECT doc_id, round_even(exact, 2)::DOUBLE AS change_percent, abs(exact) > 10 AS warn FROM (SELECT doc_id, (length(o) - length(text)) / length(text) * 100 AS exact FROM (SELECT doc_id, text, {REWRITE} AS o FROM documents WHERE text <> ''))")
def length_change(t):
    change = rewrite.length_change(F.col("text"), rewrite_of())
    exact = (F.length(rewrite_of()) - F.length("text")) / F.length("text") * 100
    return t("documents").where("text <> ''").select("doc_id", change.alias("change_percent"), (F.abs(exact) > 10).alias("warn"))


def pairs(t) -> DataFrame:
    """Chunks with a rewrite each, made by swapping, cutting or announcing."""
    rows = t("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("source"), (F.col("turn") % 4).alias("m"))
    out = F.when(F.col("m") == 0, F.col("source")).when(F.col("m") == 1, F.translate("source", "aeio", "AEIO")).when(F.col("m") == 2, F.concat(F.lit("Analiz: "), "source")).otherwise(F.replace("source", F.lit("e"), F.lit("")))
    return rows.select("id", "source", out.alias("output"))


@query()
def quality_gate(t):
    return rewrite.validated(pairs(t)).select("id", "validation")


PAIRS = """SELECT conv_id || '/' || turn AS id, text AS s, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN translate(text, 'aeio', 'AEIO') WHEN 2 THEN 'Analiz: ' || text ELSE replace(text, 'e', '') END AS o FROM conversations"""


@query(f"""SELECT id, length(s)::BIGINT AS original_characters, length(o)::BIGINT AS cleaned_characters, round_even(length(o) / length(s), 4)::DOUBLE AS length_ratio,
starts_with(lower({q.strip('o')}), 'analiz:') AS added_explanation, contains(lower(o), '<think>') OR contains(lower(o), '</think>') AS contains_thinking,
concat_ws(',', CASE WHEN length(o) / length(s) NOT BETWEEN 0.9 AND 1.1 THEN 'length_ratio_out_of_range' END, CASE WHEN starts_with(lower({q.strip('o')}), 'analiz:') THEN 'model_added_explanation' END,
CASE WHEN contains(lower(o), '<think>') OR contains(lower(o), '</think>') THEN 'model_returned_thinking' END) AS reasons, CASE WHEN o = s THEN 1.0 END::DOUBLE AS similarity_of_equals FROM ({PAIRS}) WHERE s <> '' AND o <> ''""")
def quality_gate_rules(t):
    """All rules of the gate but the ratio of unequal texts, which SQL lacks."""
    rows = rewrite.validated(pairs(t)).where("validation IS NOT NULL")
    v = lambda name: F.col(f"validation.{name}")
    others = F.array_join(F.filter(v("reasons"), lambda r: r != "similarity_below_threshold"), ",")
    equal = F.when(F.col("source") == F.col("output"), v("similarity_ratio"))
    return rows.select("id", v("original_characters"), v("cleaned_characters"), v("length_ratio"), v("added_explanation"), v("contains_thinking"), others.alias("reasons"), equal.alias("similarity_of_equals"))


@query(f"SELECT doc_id, CASE WHEN ok THEN 'cleaned' ELSE 'original_fallback' END AS status, sha256(CASE WHEN ok THEN o ELSE text END) AS text_hash, NOT ok AS kept_rejected FROM (SELECT doc_id, text, o, length(o) / length(text) BETWEEN 0.9 AND 1.1 AS ok FROM (SELECT doc_id, text, {REWRITE} AS o FROM documents WHERE text <> ''))")
def original_fallback(t):
    rows = t("documents").where("text <> ''").select("doc_id", F.col("text").alias("source"), rewrite_of().alias("output"))
    done = rewrite.with_fallback(rows, rewrite.length_ratio(F.col("source"), F.col("output")).between(0.9, 1.1))
    return done.select("doc_id", "status", identity.text_hash(F.col("text")).alias("text_hash"), F.col("rejected_text").isNotNull().alias("kept_rejected"))


@query("SELECT doc_id, greatest(512, least(floor(greatest(1, length(text) // 3) * 1.35::DOUBLE)::BIGINT + 256, 2048))::BIGINT AS tokens FROM documents")
def token_budget(t):
    return t("documents").select("doc_id", choose.token_budget(F.col("text")).alias("tokens"))


# ------------------------------------------------------------------ identity, cache


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def text_hash(t):
    return t("documents").select("doc_id", identity.text_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, left(sha256(concat_ws(':', sha256(text), doc_id::VARCHAR, (doc_id + 9)::VARCHAR, '1')), 20) AS job_id FROM documents")
def job_id(t):
    return t("documents").select("doc_id", identity.job_id(identity.text_hash(F.col("text")), F.col("doc_id"), F.col("doc_id") + 9).alias("job_id"))


@query("""SELECT doc_id, sha256('{"max_chars":' || n_chars || ',"model":"m' || doc_id % 3 || '","voice":"' || lang || '"}') AS fingerprint FROM documents""")
def settings_fingerprint(t):
    made = identity.settings_fingerprint(voice=F.col("lang"), model=F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")), max_chars=F.col("n_chars"))
    return t("documents").select("doc_id", made.alias("fingerprint"))



# ------------------------------------------------------------------------ selection


def chunks(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("chunk_no"), "text")


VERSIONS = """v AS (SELECT conv_id AS job, turn, CASE WHEN turn % 3 = 0 THEN 'A' || text WHEN turn % 5 = 0 THEN 'B' || text ELSE text END AS s,
  CASE WHEN turn % 3 = 0 THEN 'primary' WHEN turn % 5 = 0 THEN 'fallback' ELSE 'source' END AS p FROM conversations)"""


@query(f"""WITH {VERSIONS} SELECT job, sha256({q.strip(f"string_agg(s, {q.LF2} ORDER BY turn, s)")}) AS text_hash, count(*)::BIGINT AS total_chunks,
count(*) FILTER (p <> 'source')::BIGINT AS cleaned_chunks, count(*) FILTER (p = 'source')::BIGINT AS source_fallback_chunks FROM v GROUP BY job""")
def best_available(t):
    source = chunks(t)
    primary = source.where("chunk_no % 3 = 0").withColumn("text", F.concat(F.lit("A"), "text"))
    fallback = source.where("chunk_no % 5 = 0").withColumn("text", F.concat(F.lit("B"), "text"))
    done = choose.assembled(choose.best_available(source, primary, fallback))
    return done.withColumn("text_hash", identity.text_hash(F.col("text"))).drop("text")


@query("SELECT conv_id AS job, turn AS chunk_no FROM conversations WHERE turn % 3 = 0")
def missing_chunks(t):
    rows = chunks(t).select("job", "chunk_no")
    return choose.missing(rows, rows.where("chunk_no % 3 <> 0"), "job", "chunk_no")


@query("SELECT conv_id AS job, turn + 1000 AS chunk_no FROM conversations WHERE turn % 4 = 0")
def unexpected_chunks(t):
    rows = chunks(t).select("job", "chunk_no")
    stored = rows.unionByName(rows.where("chunk_no % 4 = 0").withColumn("chunk_no", F.col("chunk_no") + 1000))
    return choose.unexpected(stored, rows, "job", "chunk_no")


BAD = "(conv_id * 7 + turn) % 4 <> 0"


@query(f"SELECT conv_id AS job, turn AS chunk_no FROM (SELECT *, min(CASE WHEN NOT ({BAD}) THEN turn END) OVER (PARTITION BY conv_id) AS b FROM conversations) WHERE b IS NULL OR turn < b")
def valid_prefix(t):
    rows = chunks(t).select("job", "chunk_no")
    return choose.valid_prefix(rows, (F.col("job") * 7 + F.col("chunk_no")) % 4 != 0)


@query(f"""WITH c AS (SELECT conv_id AS job, turn AS chunk_no, turn % 3 <> 0 AS gone, {WORDS} AS words FROM conversations),
p AS (SELECT *, coalesce(sum(CASE WHEN gone THEN words ELSE 0 END) OVER (PARTITION BY job ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c),
s AS (SELECT *, max(CASE WHEN gone AND prior >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY chunk_no) AS over FROM p)
SELECT job, chunk_no, words::BIGINT AS words FROM s WHERE over = 0""")
def word_budget(t):
    rows = chunks(t).select("job", "chunk_no", text.word_count(F.col("text")).alias("words"))
    return choose.within_budget(rows, F.col("chunk_no") % 3 != 0, F.col("words"), minutes=0.2)


@query("SELECT job, chunk_no FROM (SELECT conv_id AS job, turn AS chunk_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2")
def first_n(t):
    return choose.first_n(chunks(t).select("job", "chunk_no"), 2)


# --------------------------------------------------------------------- errors, jobs

# Messages of each class for the queries, by event id.
MESSAGES = (
    "429 TPD limit: tokens per day exhausted; please try again in 7m49.152s",
    "429 rate limit; retry in 2.5s",
    "401 API_KEY_INVALID",
    "404 model_not_found",
    "413 request too large",
    "503 service unavailable, retry in 850ms",
    "connection reset by peer; retry after 12.5s",
    "no retry advice",
    "try again in 5m",
    "HTTP 4290 odd code; Please retry in 30s",
)
MESSAGE_SQL = "[" + ", ".join(f"'{m}'" for m in MESSAGES) + "][(event_id % 10)::INT + 1]"
def message() -> Column:
    return F.get(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % 10).cast("int"))



def class_sql(m: str) -> str:
    low = f"lower({m})"
    code = f"regexp_extract({m}, '\\b({'|'.join(map(str, errors.CODES['any']))})\\b', 1)"
    cases = []
    for name, codes, markers in errors.CLASSES:
        tests = [f"{code} = '{c}'" for c in codes] + [f"contains({low}, '{x}')" for x in markers]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'unknown' END"


@query(f"SELECT event_id, {class_sql(MESSAGE_SQL)} AS error_class, try_cast(nullif(regexp_extract({MESSAGE_SQL}, '\\b({'|'.join(map(str, errors.CODES['any']))})\\b', 1), '') AS INT) AS code FROM events")
def error_class(t):
    return t("events").select("event_id", errors.error_class(message()).alias("error_class"), errors.status_code(message()).alias("code"))


ADVISED = rf"""(?i)(?:try again|retry)(?:\s+in|\s+after)?\s+"""


@query(f"""SELECT event_id, coalesce(coalesce(try_cast(nullif(regexp_extract(m, '{ADVISED}([0-9.]+)m[0-9.]+s', 1), '') AS DOUBLE), 0) * 60 + try_cast(nullif(regexp_extract(m, '{ADVISED}(?:[0-9.]+m)?([0-9.]+)s', 1), '') AS DOUBLE),
try_cast(nullif(regexp_extract(m, '{ADVISED}([0-9.]+)ms', 1), '') AS DOUBLE) / 1000, try_cast(nullif(regexp_extract(m, '{ADVISED}([0-9]+)\\b', 1), '') AS DOUBLE))::DOUBLE AS seconds FROM (SELECT event_id, {MESSAGE_SQL} AS m FROM events)""")
def retry_after(t):
    return t("events").select("event_id", errors.retry_after(message()).alias("seconds"))


@query("""SELECT event_id, CASE m WHEN 1 THEN 15.0 WHEN 6 THEN 17.5 WHEN 9 THEN 35.0 ELSE greatest(15.0, least(120.0, pow(2, a))) END::DOUBLE AS primary_delay,
CASE m WHEN 1 THEN 3.5 WHEN 5 THEN 1.6 WHEN 6 THEN 13.5 WHEN 9 THEN 31.0 ELSE least(60.0, pow(2, a)) END::DOUBLE AS fallback_delay FROM (SELECT event_id, event_id % 10 AS m, event_id % 8 AS a FROM events)""")
def retry_delay_base(t):
    n = F.col("event_id") % 8
    return t("events").select("event_id", errors.retry_delay(message(), n, "primary").alias("primary_delay"), errors.retry_delay(message(), n, "fallback").alias("fallback_delay"))


@query("SELECT event_id, m IN (0, 1, 5, 6, 9) AS primary_retry, m IN (0, 1, 5, 6) AS fallback_retry, m IN (0, 1, 5, 6, 9) AS speech_retry, m = 2 AS authentication, m = 3 AS model, m = 4 AS too_large, m = 0 AS speech_quota FROM (SELECT event_id, event_id % 10 AS m FROM events)")
def retryable(t):
    kinds = {"authentication": "authentication", "model": "model", "too_large": "too_large", "speech_quota": "speech_daily_quota"}
    return t("events").select("event_id", *[errors.is_retryable(message(), c).alias(f"{c}_retry") for c in ("primary", "fallback", "speech")], *[errors.is_specific(message(), k).alias(n) for n, k in kinds.items()])


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def job_latest_state(t):
    rows = t("events").select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), "event_id")
    return jobs.latest(rows, "user_id", "updated_at", "event_id")


@query("SELECT event_id, 'paused_quota' AS status, 'text_chunk_' || lpad((event_id % 97)::VARCHAR, 4, '0') || '_subchunk_' || lpad((event_id % 7)::VARCHAR, 3, '0') AS paused_at, 'daily_quota' AS last_error_type FROM events WHERE event_id % 10 = 0")
def resume_points(t):
    rows = t("events").where(errors.error_class(message()) == "daily_quota")
    label = jobs.resume_label(F.col("event_id") % 97, F.col("event_id") % 7)
    done = jobs.paused(rows, F.lit("text_cleaning"), F.lit("groq"), label, message=message())
    return done.select("event_id", "status", "paused_at", "last_error_type")


STATUS = ("generated", "skipped", "generated", "skipped", "generated", "failed", "pending", "paused_quota", "failed_configuration")
def status_of() -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATUS]), F.least(F.col("event_id") % 9, F.col("user_id") % 9).cast("int"))

STATUS_SQL = "[" + ", ".join(f"'{s}'" for s in STATUS) + "][least(event_id % 9, user_id % 9)::INT + 1]"
COUNTS = "count(*) FILTER (s = 'generated')::BIGINT AS generated, count(*) FILTER (s = 'skipped')::BIGINT AS skipped, count(*) FILTER (s IN ('failed', 'failed_configuration'))::BIGINT AS failed, count(*) FILTER (s = 'paused_quota')::BIGINT AS paused"


@query(f"""WITH r AS (SELECT user_id, {STATUS_SQL} AS s FROM events), c AS (SELECT user_id, {COUNTS}, count(*) FILTER (s = 'failed_configuration') AS k, count(*) AS n FROM r GROUP BY user_id)
SELECT user_id, generated, skipped, failed, paused, CASE WHEN paused > 0 THEN 'paused_quota' WHEN k > 0 THEN 'failed_configuration' WHEN user_id % 10 = 3 THEN 'daily_target_reached'
WHEN generated + skipped = n THEN 'completed' WHEN failed > 0 THEN 'partially_failed' ELSE 'incomplete' END AS status FROM c""")
def status_rollup(t):
    rows = t("events").select("user_id", status_of().alias("status"))
    return jobs.rolled_up(rows, "user_id", target_reached=F.col("user_id") % 10 == 3)


@query(f"SELECT {COUNTS} FROM (SELECT {STATUS_SQL} AS s FROM events)")
def status_counts(t):
    rows = t("events").select(F.lit(1).alias("all"), status_of().alias("status"))
    return jobs.rolled_up(rows, "all").drop("all", "status")


@query("SELECT user_id, count(*)::BIGINT AS total_chunks, count(*) FILTER (m = 0)::BIGINT AS existing_primary, count(*) FILTER (m = 1)::BIGINT AS existing_fallback, count(*) FILTER (m = 2)::BIGINT AS newly_cleaned, count(*) FILTER (m = 3)::BIGINT AS invalid_candidates, sum(m)::BIGINT AS fallback_subchunks, round_even(sum(o) / sum(s), 4)::DOUBLE AS length_ratio FROM (SELECT user_id, event_id % 4 AS m, event_id % 700 + 100 AS s, event_id % 500 + 150 AS o FROM events) GROUP BY user_id")
def cleaning_report(t):
    m = (F.col("event_id") % 4).cast("int")
    rows = t("events").select("user_id", F.get(F.array(*map(F.lit, ("primary", "fallback", "new", "invalid"))), m).alias("origin"), m.cast("long").alias("fallback_subchunks"), (F.col("event_id") % 700 + 100).alias("source_characters"), (F.col("event_id") % 500 + 150).alias("output_characters"))
    return jobs.cleaning_report(rows, "user_id")


FRAMES = f"{WORDS} * 160"


@query(f"""SELECT job, chunk_no, frames::BIGINT AS frames, start_frame::BIGINT AS start_frame, (start_frame + frames)::BIGINT AS end_frame FROM (
SELECT *, coalesce(sum(frames + 10800) OVER (PARTITION BY job ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_frame
FROM (SELECT conv_id AS job, turn AS chunk_no, {FRAMES} AS frames FROM conversations))""")
def audio_concat_plan(t):
    rows = chunks(t).select("job", "chunk_no", (text.word_count(F.col("text")) * 160).alias("frames"))
    return audio.concat_plan(rows)


@query(f"""SELECT job, 1 AS channels, 2 AS sample_width, 24000 AS sample_rate, frames, round_even(frames / 24000, 3)::DOUBLE AS duration_seconds, (44 + 2 * frames)::BIGINT AS file_size_bytes, NULL::VARCHAR AS fault
FROM (SELECT conv_id AS job, (sum(greatest({WORDS}, 1) * 160) + (count(*) - 1) * 10800)::BIGINT AS frames FROM conversations GROUP BY conv_id)""")
def audio_joined(t):
    spoken = services.applied(chunks(t), services.tone_speaker, "text", "pcm", "binary").select("job", "chunk_no", audio.pcm_as_wav(F.col("pcm")).alias("content"))
    joined = audio.joined_wav(spoken)
    return joined.select("job", audio.wav_details(F.col("content")).alias("audio"), audio.wav_fault(F.col("content")).alias("fault")).select("job", "audio.*", "fault").drop("audio")


@query("SELECT user_id, ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def best_job(t):
    return files.newest(t("events").select("user_id", "ts", "event_id"), F.col("ts"), "event_id")


@query()
def narration(t):
    """The whole chain on documents: preclean, clean by a stand-in service, chunk, budget, speak, plan the audio."""
    from folioweave.plans.narrate import narrated

    return narrated(t("documents"))


from folioweave.plans import flow  # noqa: E402, F401  (registers its queries here)
