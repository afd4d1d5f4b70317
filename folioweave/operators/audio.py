"""Audio as data: WAV headers, validity, and the plan and bytes of a concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, CHANNELS, WIDTH, GAP_MS = 24_000, 1, 2, 450
MIN_MP3_BYTES = 100


def little_endian(content: Column, at: int, size: int) -> Column:
    """An unsigned number of `size` bytes at offset `at`."""
    pairs = F.hex(F.substring(content, at + 1, size))
    swapped = F.array_join(F.transform(F.sequence(F.lit(size), F.lit(1), F.lit(-1)), lambda i: F.substring(pairs, i * 2 - 1, F.lit(2))), "")
    return F.conv(swapped, 16, 10).cast("long")


def wav_details(content: Column) -> Column:
    """Details of a canonical WAV file (44-byte header), or null if it is not one."""
    frames = F.floor(little_endian(content, 40, 4) / (CHANNELS * WIDTH)).cast("long")
    riff = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645")
    details = F.struct(
        little_endian(content, 22, 2).cast("int").alias("channels"),
        (little_endian(content, 34, 2) / 8).cast("int").alias("sample_width"),
        little_endian(content, 24, 4).cast("int").alias("sample_rate"),
        frames.alias("frames"),
        F.bround(frames / little_endian(content, 24, 4), 3).alias("duration_seconds"),
        F.length(content).cast("long").alias("file_size_bytes"),
    )
    return F.when((F.length(content) > 44) & riff, details)


def wav_fault(content: Column) -> Column:
    """Why a file is no valid narration WAV, or null."""
    d = wav_details(content)
    return (
        F.when(content.isNull(), "missing")
        .when(F.length(content) <= 44, "too_small")
        .when(d.isNull(), "not_wav")
        .when(d["channels"] != CHANNELS, "channels")
        .when(d["sample_width"] != WIDTH, "sample_width")
        .when(d["sample_rate"] != RATE, "sample_rate")
        .when(d["frames"] <= 0, "duration")
    )


def is_mp3(content: Column) -> Column:
    return F.coalesce(F.length(content) >= MIN_MP3_BYTES, F.lit(False))


def silence_frames(gap_ms: Column | int = GAP_MS) -> Column:
    return F.floor(F.lit(RATE) * gap_ms / 1000).cast("long")


def concat_plan(chunks: DataFrame, frames: str = "frames", job: str = "job", no: str = "chunk_no", gap_ms: int = GAP_MS) -> DataFrame:
    """chunks with start_frame and end_frame in the joined audio, silence between neighbours."""
    before = Window.partitionBy(job).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(frames) + silence_frames(gap_ms)).over(before), F.lit(0))
    return chunks.withColumn("start_frame", start.cast("long")).withColumn("end_frame", (F.col("start_frame") + F.col(frames)).cast("long"))


def concat_totals(chunks: DataFrame, frames: str = "frames", job: str = "job", no: str = "chunk_no", gap_ms: int = GAP_MS) -> DataFrame:
    """A row per job: input_files, total_frames, duration_seconds, has_gap (a chunk number is missing between)."""
    n = F.count(F.lit(1))
    total = F.sum(frames) + (n - 1) * silence_frames(gap_ms)
    return chunks.groupBy(job).agg(n.alias("input_files"), total.cast("long").alias("total_frames"), F.bround(total / RATE, 3).alias("duration_seconds"), (F.max(no) - F.min(no) + 1 > n).alias("has_gap"))


def pcm_as_wav(pcm: Column) -> Column:
    """16-bit mono PCM with a WAV header."""
    size = F.length(pcm)
    number = lambda c, bytes_: F.unhex(F.array_join(F.transform(F.sequence(F.lit(bytes_), F.lit(1), F.lit(-1)), lambda i: F.substring(F.lpad(F.hex(c), bytes_ * 2, "0"), i * 2 - 1, F.lit(2))), ""))
    ascii_ = lambda s: F.lit(s.encode())
    head = [ascii_("RIFF"), number(size + 36, 4), ascii_("WAVEfmt "), number(F.lit(16), 4), number(F.lit(1), 2), number(F.lit(CHANNELS), 2), number(F.lit(RATE), 4), number(F.lit(RATE * CHANNELS * WIDTH), 4), number(F.lit(CHANNELS * WIDTH), 2), number(F.lit(8 * WIDTH), 2), ascii_("data"), number(size, 4)]
    return F.concat(*head, pcm)


def joined_wav(chunks: DataFrame, content: str = "content", job: str = "job", no: str = "chunk_no", gap_ms: int = GAP_MS) -> DataFrame:
    """A WAV per job of its chunks' frames in order with silence between; a job's audio is one value, as its file is."""
    gap = "00" * (int(RATE * gap_ms / 1000) * CHANNELS * WIDTH)
    parts = chunks.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(no, F.substring(F.col(content), F.lit(45), F.length(content)).alias("pcm")))).alias("all"))
    return parts.select(job, pcm_as_wav(F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["pcm"])), gap))).alias("content"))
