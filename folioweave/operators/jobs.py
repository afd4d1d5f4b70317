"""Job state and reports: latest state, pause, checkpoint, roll-up, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_DDL = (
    "job_id string, pdf_file string, pdf_sha256 string, start_page long, end_page long, status string, stage string, pipeline_version string, "
    "text_provider_primary string, text_provider_fallback string, tts_provider_primary string, tts_provider_fallback string, "
    "text_chunks_total long, text_chunks_completed long, tts_chunks_total long, tts_chunks_completed long, paused_at string, paused_provider string, "
    "resume_after timestamp, last_error_type string, last_error_message string, outputs map<string,string>, created_at timestamp, updated_at timestamp"
)
STATE_FIELDS = tuple(x.split()[0] for x in STATE_DDL.split(", "))


def latest(states: DataFrame, key: str = "job_id", at: str = "updated_at", tie: str | None = None) -> DataFrame:
    """The newest row of each key, by a partial aggregate."""
    order = F.struct(at, tie) if tie else F.col(at)
    return states.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("s")).select("s.*")


def upserted(stored: DataFrame, new: DataFrame, key: str = "job_id") -> DataFrame:
    """Stored rows stay; new ones come in only where their key is unknown."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))


def checkpointed(states: DataFrame, **changes: Column) -> DataFrame:
    """states with fields changed and updated_at stamped; an unknown field is an error."""
    unknown = set(changes) - set(STATE_FIELDS)
    if unknown:
        raise ValueError(f"unknown state fields: {', '.join(sorted(unknown))}")
    return states.withColumns({**changes, "updated_at": F.current_timestamp()})


def paused(states: DataFrame, stage: Column, provider: Column, paused_at: Column, resume_after: Column | None = None, message: Column | None = None) -> DataFrame:
    nothing = F.lit(None)
    return checkpointed(
        states,
        status=F.lit("paused_quota"),
        stage=stage,
        paused_at=paused_at,
        paused_provider=provider,
        resume_after=(nothing if resume_after is None else resume_after).cast("timestamp"),
        last_error_type=F.lit("daily_quota"),
        last_error_message=(nothing if message is None else message).cast("string"),
    )


def speech_checkpoint(states: DataFrame, status: str, total: Column, completed: Column, final_file: Column | None = None, paused_at: Column | None = None, message: Column | None = None) -> DataFrame:
    """Counters of narration; a pause keeps the stage, any other status clears the pause."""
    counted = states.withColumns({"tts_chunks_total": total.cast("long"), "tts_chunks_completed": completed.cast("long")})
    if status == "paused_quota":
        return paused(counted, F.lit("tts_generating"), F.lit("gemini_tts"), F.lit("next_incomplete_tts_chunk") if paused_at is None else paused_at, message=message)
    if final_file is not None:
        added = F.map_concat(F.map_filter(F.coalesce("outputs", F.create_map().cast("map<string,string>")), lambda k, v: k != "podcast"), F.create_map(F.lit("podcast"), final_file))
        counted = counted.withColumn("outputs", F.when(final_file.isNotNull(), added).otherwise(F.col("outputs")))
    empty = {c: F.lit(None).cast("timestamp" if c == "resume_after" else "string") for c in ("paused_at", "paused_provider", "resume_after", "last_error_type", "last_error_message")}
    return checkpointed(counted, status=F.lit(status), stage=F.lit(status), **empty)


def resume_label(chunk_no: Column, sub_no: Column | None = None) -> Column:
    return F.format_string("text_chunk_%04d", chunk_no) if sub_no is None else F.format_string("text_chunk_%04d_subchunk_%03d", chunk_no, sub_no)


def rolled_up(rows: DataFrame, job: str, total: Column | None = None, target_reached: Column | None = None) -> DataFrame:
    """A row per job: status by precedence, and counters. rows: job, status of each reported chunk; total: chunks in all."""
    s = F.col("status")
    agg = rows.groupBy(job).agg(
        F.count_if(s == "generated").alias("generated"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s.isin("failed", "failed_configuration")).alias("failed"),
        F.count_if(s == "paused_quota").alias("paused"),
        F.count_if(s == "failed_configuration").alias("__configuration"),
        (F.count(F.lit(1)) if total is None else F.max(total)).alias("__total"),
        F.max(F.lit(False) if target_reached is None else target_reached).alias("__target"),
    )
    done = F.col("generated") + F.col("skipped") == F.col("__total")
    status = (
        F.when(F.col("paused") > 0, "paused_quota")
        .when(F.col("__configuration") > 0, "failed_configuration")
        .when(F.col("__target"), "daily_target_reached")
        .when(done, "completed")
        .when(F.col("failed") > 0, "partially_failed")
        .otherwise("incomplete")
    )
    return agg.withColumn("status", status).drop("__configuration", "__total", "__target")


def cleaning_report(rows: DataFrame, job: str) -> DataFrame:
    """A row per job of the hybrid cleaner: chunks by origin, rejected ones, subchunk fallbacks, overall length ratio.

    rows: job, origin (primary, fallback, new, invalid), fallback_subchunks, source_characters, output_characters.
    """
    o = F.col("origin")
    of = lambda name: F.count_if(o == name)
    return rows.groupBy(job).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        of("primary").alias("existing_primary"),
        of("fallback").alias("existing_fallback"),
        of("new").alias("newly_cleaned"),
        of("invalid").alias("invalid_candidates"),
        F.sum("fallback_subchunks").alias("fallback_subchunks"),
        F.bround(F.sum("output_characters") / F.sum("source_characters"), 4).alias("length_ratio"),
    )


def as_json(rows: DataFrame, job: str) -> DataFrame:
    """A JSON report per job."""
    return rows.groupBy(job).agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("report"))


def progress(rows: DataFrame, job: str, status: Column, **facts: Column) -> DataFrame:
    """A row per job: status, total_chunks, source_characters, further facts of the job, and the rows as `chunks`, a JSON array in order.

    rows: job, chunk_no, characters and whatever else a chunk reports.
    """
    chunks = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.struct("*").alias("r")))), lambda x: x["r"]))
    given = {"status": status, **facts}
    return rows.groupBy(job).agg(*[F.first(c).alias(k) for k, c in given.items()], F.count(F.lit(1)).alias("total_chunks"), F.sum("characters").alias("source_characters"), chunks.alias("chunks"))


def may_fall_back(error_class: Column) -> Column:
    from folioweave.functions.errors import FALLS_BACK

    return error_class.isin(*FALLS_BACK)
