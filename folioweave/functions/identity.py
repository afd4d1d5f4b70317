"""Content hashes, fingerprints and cache validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIPELINE_VERSION = "1"


def text_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def settings_fingerprint(**settings: Column) -> Column:
    """Hash of the settings as JSON with sorted keys, no blanks and raw Unicode; nulls stay."""
    fields = [settings[k].alias(k) for k in sorted(settings)]
    return text_hash(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}"))


def job_id(content_hash: Column, start: Column, end: Column, version: str | Column = PIPELINE_VERSION) -> Column:
    version = F.lit(version) if isinstance(version, str) else version
    return F.substring(text_hash(F.concat_ws(":", content_hash, start.cast("string"), end.cast("string"), version)), 1, 20)


def chunk_set_name(base: str, text: Column) -> Column:
    """Name for a chunk set whose text differs from the stored one."""
    return F.concat(F.lit(f"{base}_"), F.substring(text_hash(text), 1, 12))


def cache_reason(output: Column, metadata: Column, source: Column, provider: Column, model: Column, fingerprint: Column) -> Column:
    """The first failing check, or valid.

    output: struct<hash> of what is stored, with a null hash if it can't be read, or null; metadata:
    struct<invalid, source_hash, provider, model, settings_fingerprint, output_hash> or null.
    """
    differs = lambda a, b: ~a.eqNullSafe(b)
    return (
        F.when(output.isNull(), "output_missing")
        .when(metadata.isNull(), "metadata_missing")
        .when(F.coalesce(metadata["invalid"], F.lit(False)), "metadata_invalid")
        .when(differs(metadata["source_hash"], text_hash(source)), "source_hash_mismatch")
        .when(differs(metadata["provider"], provider), "provider_mismatch")
        .when(differs(metadata["model"], model), "model_mismatch")
        .when(differs(metadata["settings_fingerprint"], fingerprint), "settings_fingerprint_mismatch")
        .when(output["hash"].isNull(), "output_unreadable")
        .when(differs(metadata["output_hash"], output["hash"]), "output_hash_mismatch")
        .otherwise("valid")
    )
