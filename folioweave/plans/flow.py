"""Queries of what controls a run: caches, candidates, budgets, routes, reports. They register in the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import identity, text
from folioweave.operators import caching, choose, jobs, rewrite, routes, segment
from folioweave.plans import sql as q
from folioweave.plans.catalogue import PAGED, WORDS, chunks, class_sql, message, MESSAGE_SQL, query, speech_sql
from folioweave.sources import services

# ------------------------------------------------------------------------- caches

FINGERPRINT = """sha256('{"max_chars":' || n_chars || ',"voice":"' || lang || '"}')"""


def changed() -> Column:
    return F.translate("text", "aeio", "AEIO")


def settings() -> dict[str, Column]:
    return {"voice": F.col("lang"), "max_chars": F.col("n_chars")}


def stored_metadata(t) -> DataFrame:
    """Metadata of all documents, each of eleven kinds broken in its own way."""
    m = F.col("doc_id") % 11
    rows = t("documents").where(m != 1)
    made = caching.metadata(rows, "doc_id", source="text", output_hash=identity.text_hash(changed()), provider=F.lit("p"), model=F.lit("m"), **settings())
    wrong = lambda k, c: F.when(m == k, F.concat(F.lit("other"), c)).otherwise(F.col(c))
    return made.withColumns({"invalid": m == 2, **{c: wrong(k, c) for k, c in ((3, "source_hash"), (4, "provider"), (5, "model"), (6, "settings_fingerprint"), (8, "output_hash"))}})


@query(f"SELECT doc_id, sha256(text) AS source_hash, sha256(translate(text, 'aeio', 'AEIO')) AS output_hash, 'p' AS provider, 'm' AS model, {FINGERPRINT} AS settings_fingerprint, '{{}}' AS validation FROM documents WHERE doc_id % 3 <> 0")
def cache_write(t):
    output = F.when(F.col("doc_id") % 3 != 0, identity.text_hash(changed()))
    return caching.metadata(t("documents"), "doc_id", source="text", output_hash=output, provider=F.lit("p"), model=F.lit("m"), **settings()).drop("created_at", "settings")


LOOKUP = f"""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 7 THEN sha256(translate(text, 'aeio', 'AEIO')) END AS h FROM documents WHERE doc_id % 11 <> 0),
md AS (SELECT doc_id, doc_id % 11 = 2 AS invalid, CASE WHEN doc_id % 11 = 3 THEN 'other' ELSE '' END || sha256(text) AS sh, CASE WHEN doc_id % 11 = 4 THEN 'other' ELSE '' END || 'p' AS pr,
  CASE WHEN doc_id % 11 = 5 THEN 'other' ELSE '' END || 'm' AS mo, CASE WHEN doc_id % 11 = 6 THEN 'other' ELSE '' END || {FINGERPRINT} AS fp, CASE WHEN doc_id % 11 = 8 THEN 'other' ELSE '' END || sha256(translate(text, 'aeio', 'AEIO')) AS oh FROM documents WHERE doc_id % 11 <> 1),
r AS (SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'output_missing' WHEN md.doc_id IS NULL THEN 'metadata_missing' WHEN md.invalid THEN 'metadata_invalid' WHEN md.sh <> sha256(d.text) THEN 'source_hash_mismatch'
  WHEN md.pr <> 'p' THEN 'provider_mismatch' WHEN md.mo <> 'm' THEN 'model_mismatch' WHEN md.fp <> {FINGERPRINT} THEN 'settings_fingerprint_mismatch' WHEN o.h IS NULL THEN 'output_unreadable' WHEN md.oh <> o.h THEN 'output_hash_mismatch' ELSE 'valid' END AS reason
  FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN md ON md.doc_id = d.doc_id)
"""


def looked_up(t) -> DataFrame:
    m = F.col("doc_id") % 11
    outputs = t("documents").where(m != 0).select("doc_id", F.when(m != 7, identity.text_hash(changed())).alias("hash"))
    return caching.looked_up(t("documents"), outputs, stored_metadata(t), "doc_id", source=F.col("text"), provider=F.lit("p"), model=F.lit("m"), fingerprint=identity.settings_fingerprint(**settings()))


@query(LOOKUP + "SELECT doc_id, reason, reason = 'valid' AS valid FROM r")
def cache_lookup(t):
    return looked_up(t).select("doc_id", "reason", (F.col("reason") == "valid").alias("valid"))


SOUND = "doc_id % 5 <> 0"


@query(LOOKUP + f""", p AS (SELECT *, {SOUND} AS sound FROM r)
SELECT doc_id, CASE WHEN reason = 'output_missing' THEN 'generate' WHEN reason IN ('valid', 'metadata_missing') THEN CASE WHEN sound THEN 'reuse' ELSE 'generate' END ELSE 'error' END AS primary_text,
CASE WHEN reason = 'output_missing' OR NOT sound THEN 'generate' ELSE 'reuse' END AS fallback_text,
CASE WHEN reason = 'valid' AND sound THEN 'reuse' ELSE 'generate' END AS fallback_part,
CASE WHEN reason = 'output_missing' THEN 'generate' WHEN reason IN ('valid', 'metadata_missing') AND sound THEN 'reuse' ELSE 'error' END AS primary_speech,
CASE WHEN reason = 'output_missing' THEN 'generate' WHEN reason IN ('valid', 'metadata_missing') AND sound THEN 'reuse' ELSE 'error' END AS fallback_speech FROM p""")
def cache_policies(t):
    return looked_up(t).select("doc_id", *[caching.action(F.col("reason"), stage, F.expr(SOUND)).alias(stage) for stage in caching.POLICIES])


@query("SELECT doc_id, 'tts_chunks_' || left(sha256(text), 12) AS name FROM documents")
def chunk_set_name(t):
    return t("documents").select("doc_id", identity.chunk_set_name("tts_chunks", F.col("text")).alias("name"))


# --------------------------------------------------------------------- candidates


@query("""SELECT conv_id AS job, turn AS chunk_no, CASE WHEN m = 0 THEN 'missing' WHEN m = 1 THEN 'unreadable' WHEN m = 2 THEN 'empty' WHEN m = 3 AND length(text) / length(text || text) < 0.9 THEN 'invalid' ELSE 'valid' END AS state,
CASE WHEN m > 3 THEN text END AS output, m >= 3 AS checked FROM (SELECT conv_id, turn, text, (conv_id + turn) % 6 AS m FROM conversations WHERE regexp_matches(text, '^\\S') AND regexp_matches(text, '\\S$') AND NOT contains(lower(text), 'think>') AND length(text) > 20)""")
def candidate_states(t):
    m = (F.col("job") + F.col("chunk_no")) % 6
    rows = chunks(t).where(F.col("text").rlike(r"^\S") & F.col("text").rlike(r"\S\z") & ~F.lower("text").contains("think>") & (F.length("text") > 20)).withColumnRenamed("text", "source")
    stored = F.when(m == 1, None).when(m == 2, "  ").when(m == 3, F.concat("source", "source")).otherwise(F.concat(F.lit(" "), "source"))
    found = rewrite.candidates(rows, rows.where(m != 0).select("job", "chunk_no", stored.alias("text")), "job", "chunk_no")
    return found.select("job", "chunk_no", "state", "output", F.col("validation").isNotNull().alias("checked"))


# ------------------------------------------------------------------ budgets, routes


@query(f"""WITH c AS (SELECT conv_id AS job, turn AS chunk_no, turn % 3 <> 0 AS gone, turn % 4 <> 1 AS made, {WORDS} AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
p AS (SELECT *, coalesce(sum(CASE WHEN gone AND made THEN words ELSE 0 END) OVER (PARTITION BY job ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c WHERE r <= 6),
s AS (SELECT *, max(CASE WHEN gone AND prior >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY chunk_no) AS over FROM p)
SELECT job, chunk_no, words::BIGINT AS words FROM s WHERE over = 0""")
def run_budget(t):
    rows = chunks(t).select("job", "chunk_no", text.word_count(F.col("text")).alias("words"))
    return choose.within_run_budget(rows, F.col("chunk_no") % 3 != 0, F.col("words"), minutes=0.2, limit=6, made=F.col("chunk_no") % 4 != 1)


OTHER_SQL = MESSAGE_SQL.replace("event_id % 10", "(event_id // 10) % 10")


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN {class_sql(MESSAGE_SQL)} END AS a, CASE WHEN event_id % 4 <> 0 THEN {class_sql(OTHER_SQL)} END AS b FROM events),
k AS (SELECT event_id, CASE WHEN a IS NULL THEN 1 WHEN a NOT IN ('daily_quota', 'rate_limit', 'authentication', 'model_not_found', 'temporary') THEN 2 WHEN b IS NULL THEN 3 WHEN b IN ('daily_quota', 'rate_limit') THEN 4 WHEN b IN ('authentication', 'model_not_found') THEN 5 ELSE 2 END AS k FROM e)
SELECT event_id, CASE k WHEN 1 THEN 'primary' WHEN 3 THEN 'fallback' WHEN 4 THEN 'mixed_partial' WHEN 5 THEN 'source_fallback' END AS provider,
CASE k WHEN 2 THEN 'error' WHEN 4 THEN 'paused_quota' WHEN 5 THEN 'completed_text_only' ELSE 'completed' END AS status, k IN (4, 5) AS assembled FROM k""")
def text_routes(t):
    rows = t("events").withColumns({"one": F.when(F.col("event_id") % 3 != 0, message()), "id": F.col("event_id")})
    rows = rows.withColumn("event_id", F.floor(F.col("id") / 10)).withColumn("two", F.when(F.col("id") % 4 != 0, message()))
    return rows.select(F.col("id").alias("event_id"), routes.text_route(F.col("one"), F.col("two")).alias("r")).select("event_id", "r.*")


@query("""SELECT event_id, (c <> 0 OR p) AS fallback, CASE WHEN NOT (c <> 0 OR p) THEN s WHEN ok THEN 'completed' WHEN p THEN s ELSE 'completed_text_only' END AS status,
CASE WHEN c <> 0 AND NOT ok AND NOT p THEN 'tts_unavailable' END AS last_error_type FROM (SELECT event_id, event_id % 2 AS c, event_id % 3 = 0 AS p, CASE WHEN event_id % 3 = 0 THEN 'paused_quota' ELSE 'completed' END AS s, event_id % 5 <> 0 AS ok FROM events)""")
def speech_routes(t):
    n = F.col("event_id")
    status = F.when(n % 3 == 0, "paused_quota").otherwise("completed")
    return t("events").select("event_id", routes.speech_route(n % 2, status, F.when(n % 5 == 0, F.lit("no audio"))).alias("r")).select("event_id", "r.*")


@query("""SELECT conv_id AS job, turn AS chunk_no, CASE WHEN m < 2 THEN text || '!' END AS value, CASE m WHEN 2 THEN '413 request too large' WHEN 3 THEN '503 timeout' END AS error, CASE m WHEN 2 THEN 'request_too_large' WHEN 3 THEN 'temporary' END AS error_class,
CASE m WHEN 1 THEN 2 WHEN 3 THEN 6 ELSE 1 END::BIGINT AS attempts FROM (SELECT *, length(text) % 4 AS m FROM conversations WHERE text <> '')""")
def service_attempts(t):
    """A stand-in service that fails by the length of a text: once, for good, or at every attempt."""

    def service(texts: list[str]) -> list[dict]:
        tries: dict[str, int] = {}

        def call(given: str) -> str:
            tries[given] = tries.get(given, 0) + 1
            kind = len(given) % 4
            if kind == 2:
                raise RuntimeError("413 request too large")
            if kind == 3 or kind == 1 and tries[given] % 2:
                raise RuntimeError("503 timeout")
            return given + "!"

        return services.attempted(call, sleep=lambda s: None)(texts)

    rows = services.applied(chunks(t).where("text <> ''"), service, "text", "r", "struct<value:string,error:string,error_class:string,attempts:bigint>")
    return rows.select("job", "chunk_no", "r.*")


# ------------------------------------------------------------------------- reports


@query(speech_sql(PAGED, segment.MAX_SPEECH, segment.MIN_SPEECH) + f"SELECT doc_id, {segment.MAX_SPEECH}::BIGINT AS maximum_characters, count(*)::BIGINT AS total_chunks, sum(length(text))::BIGINT AS total_characters, sum({WORDS})::BIGINT AS total_words FROM ch GROUP BY doc_id")
def manifest_totals(t):
    return segment.manifest_totals(segment.manifest(t("documents").select("doc_id", F.expr(PAGED).alias("text"))))


@query(f"""SELECT conv_id AS job, 'incomplete' AS status, 'm' AS model, count(*)::BIGINT AS total_chunks, sum(length(text))::BIGINT AS source_characters,
'[' || string_agg('{{"job":' || conv_id || ',"chunk_no":' || turn || ',"characters":' || length(text) || '}}', ',' ORDER BY turn) || ']' AS chunks FROM conversations GROUP BY conv_id""")
def progress_report(t):
    rows = chunks(t).select("job", "chunk_no", F.length("text").cast("long").alias("characters"))
    return jobs.progress(rows, "job", F.lit("incomplete"), model=F.lit("m"))


@query(f"SELECT doc_id, len(lines)::BIGINT AS n_lines FROM (SELECT doc_id, string_split({q.rr(q.line_feeds('text'), chr(10) + '$')}, chr(10)) AS lines FROM documents)")
def line_counts(t):
    return t("documents").select("doc_id", F.greatest(F.size(text.lines_of(text.line_feeds(F.col("text")))), F.lit(1)).cast("long").alias("n_lines"))
