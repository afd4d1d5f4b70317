"""Stored outputs and their metadata: rows to write, lookups by key, and what each stage does with what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.identity import cache_reason, settings_fingerprint, text_hash

#: What a stage does when stored metadata is valid, absent, or does not fit; "check" leaves it to a check of the output itself.
POLICIES: dict[str, tuple[str, str, str]] = {
    "primary_text": ("reuse", "reuse", "error"),
    "fallback_text": ("check", "check", "check"),
    "fallback_part": ("reuse", "generate", "generate"),
    "primary_speech": ("check", "check", "error"),
    "fallback_speech": ("check", "check", "error"),
}
#: Stages that refuse an output that fails its check; the others make it anew.
STRICT = ("primary_speech", "fallback_speech")


def metadata(rows: DataFrame, *keys: str, source: str, output_hash: Column, provider: Column, model: Column, validation: Column | None = None, **settings: Column) -> DataFrame:
    """Metadata to append once the output exists; rows without output (a null hash) get none."""
    return rows.where(output_hash.isNotNull()).select(
        *keys,
        text_hash(F.col(source)).alias("source_hash"),
        output_hash.alias("output_hash"),
        provider.alias("provider"),
        model.alias("model"),
        F.to_json(F.struct(*[settings[k].alias(k) for k in sorted(settings)])).alias("settings") if settings else F.lit("{}").alias("settings"),
        settings_fingerprint(**settings).alias("settings_fingerprint"),
        (F.lit("{}") if validation is None else validation).alias("validation"),
        F.current_timestamp().alias("created_at"),
    )


def looked_up(wanted: DataFrame, outputs: DataFrame, stored: DataFrame, *keys: str, source: Column, provider: Column, model: Column, fingerprint: Column) -> DataFrame:
    """wanted with `reason`: the first check that a row's stored output fails, or valid.

    outputs: keys, hash (null: unreadable); stored: keys, invalid and the fields of metadata(). Both are joined by key.
    """
    out = outputs.select(*keys, F.struct("hash").alias("__output"))
    meta = stored.select(*keys, F.struct("invalid", "source_hash", "provider", "model", "settings_fingerprint", "output_hash").alias("__metadata"))
    joined = wanted.join(out, list(keys), "left").join(meta, list(keys), "left")
    reason = cache_reason(F.col("__output"), F.col("__metadata"), source, provider, model, fingerprint)
    return joined.withColumn("reason", reason).drop("__output", "__metadata")


def action(reason: Column, stage: str, sound: Column) -> Column:
    """What a stage does with a stored output: reuse, generate or error.

    sound: whether the output passes the stage's own check (a text that is not empty or is a valid rewrite, audio that plays).
    """
    valid, absent, differs = POLICIES[stage]
    checked = F.when(sound, "reuse").otherwise("error" if stage in STRICT else "generate")
    what = lambda name: checked if name == "check" else F.when(sound, "reuse").otherwise("generate") if name == "reuse" else F.lit(name)
    return (
        F.when(reason == "output_missing", "generate")
        .when(reason == "valid", what(valid))
        .when(reason == "metadata_missing", what(absent))
        .otherwise(what(differs))
    )
