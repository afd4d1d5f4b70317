import io
import wave

import pytest
from pyspark.sql import functions as F

from folioweave.functions import errors, identity
from folioweave.operators import audio, choose, jobs, rewrite
from folioweave.sources import files, services

MESSAGES = [
    ("429 TPD limit: tokens per day exhausted; please try again in 7m49.152s", "daily_quota", 469.152),
    ("429 rate limit; retry in 2.5s", "rate_limit", 2.5),
    ("401 API_KEY_INVALID", "authentication", None),
    ("404 model_not_found", "model_not_found", None),
    ("413 request too large", "request_too_large", None),
    ("retry in 850ms", "unknown", 0.85),
    ("retry after 12.5s", "unknown", 12.5),
    ("no retry advice", "unknown", None),
    ("try again in 5m", "unknown", None),
    ("retry in 1h2m3s", "unknown", None),
    ("x4291 timeout", "temporary", None),
]


def test_error_classes_and_waits(spark):
    rows = spark.createDataFrame([(m,) for m, *_ in MESSAGES], "m string").select("m", errors.error_class(F.col("m")).alias("c"), errors.retry_after(F.col("m")).alias("s")).collect()
    assert [(r.m, r.c, r.s) for r in rows] == MESSAGES
    typed = spark.createDataFrame([("oops", 503)], "m string, code int").select(errors.error_class(F.col("m"), F.col("code"))).first()[0]
    assert typed == "temporary"


@pytest.mark.parametrize("client,message,attempt,delay", [
    ("fallback", "retry in 850ms", 1, 1.6), ("fallback", "retry in 2.5s", 1, 3.5), ("fallback", "retry in 100ms", 1, 1.5), ("fallback", "?", 9, 60.0),
    ("primary", "retry in 2.5s", 1, 15.0), ("primary", "retry in 30s", 1, 35.0), ("primary", "?", 9, 120.0), ("speech", "?", 3, 8.0),
])
def test_delays(spark, client, message, attempt, delay):
    assert spark.range(1).select(errors.retry_delay(F.lit(message), F.lit(attempt), client)).first()[0] == delay


def test_identity(spark):
    ids = spark.createDataFrame([("abc123", 8, 334), ("abc123", 8, 334), ("abc123", 9, 334)], "h string, a int, b int").select(identity.job_id(F.col("h"), F.col("a"), F.col("b")).alias("i")).collect()
    assert ids[0].i == ids[1].i != ids[2].i and len(ids[0].i) == 20
    import hashlib
    import json

    got = spark.range(1).select(identity.settings_fingerprint(voice=F.lit("Köre"), b=F.lit(None).cast("string"), a=F.lit(1)).alias("f")).first().f
    assert got == hashlib.sha256(json.dumps({"voice": "Köre", "b": None, "a": 1}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spark.range(1).select(identity.chunk_set_name("tts_chunks", F.lit("x"))).first()[0] == "tts_chunks_" + hashlib.sha256(b"x").hexdigest()[:12]


SOURCE = "Bu bir ornek metindir. Ikinci cumle burada. Ucuncu cumle de var."


def test_quality_gate(spark):
    rows = [(1, SOURCE, SOURCE.replace("ornek", "örnek")), (2, SOURCE, "Bambaşka sözcüklerle yeniden yazılmış bir metin bu; uzunluğu ya"), (3, SOURCE, "Analiz: <think>" + SOURCE), (4, "", "x"), (5, SOURCE, None)]
    got = {r.id: r.validation for r in rewrite.validated(spark.createDataFrame(rows, "id int, source string, output string")).collect()}
    assert got[1].valid and not got[2].valid and got[2].similarity_ratio < 0.9 and "similarity_below_threshold" in got[2].reasons
    assert got[3].reasons == ["length_ratio_out_of_range", "similarity_below_threshold", "model_added_explanation", "model_returned_thinking"]
    assert got[4] is None and got[5] is None


def test_fallback_to_source(spark):
    df = rewrite.with_fallback(spark.createDataFrame([(1, "a", "b", True), (2, "a", "b", None)], "id int, source string, output string, ok boolean"), F.col("ok"))
    assert [(r.status, r.text, r.rejected_text) for r in df.orderBy("id").collect()] == [("cleaned", "b", None), ("original_fallback", "a", "b")]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "job int, chunk_no int, text string")


def test_best_available(spark):
    source = chunks(spark, [(1, 1, "birinci"), (1, 2, "İkinci.")])
    done = choose.assembled(choose.best_available(source, chunks(spark, [(1, 1, "Birinci.")]), chunks(spark, [(1, 1, "no")]))).first()
    assert (done.text, done.total_chunks, done.cleaned_chunks, done.source_fallback_chunks) == ("Birinci.\n\nİkinci.", 2, 1, 1)


def test_budget_and_prefix(spark):
    rows = spark.createDataFrame([(1, n, n != 2, 5) for n in range(1, 5)], "job int, chunk_no int, gone boolean, words int")
    kept = lambda **k: [r.chunk_no for r in choose.within_budget(rows, F.col("gone"), F.col("words"), **k).orderBy("chunk_no").collect()]
    assert kept(minutes=0.05, per_minute=100) == [1, 2] and kept(limit=3, minutes=0.0) == [1, 2, 3] and kept() == [1, 2, 3, 4]
    assert [r.chunk_no for r in choose.valid_prefix(rows, F.col("chunk_no") != 3).orderBy("chunk_no").collect()] == [1, 2]


def test_token_budget(spark):
    got = spark.createDataFrame([(n,) for n in (300, 3000, 6000)], "n int").select(choose.token_budget(F.repeat(F.lit("x"), F.col("n"))).alias("t"))
    assert [r.t for r in got.collect()] == [512, 1606, 2048]


def states(spark, *rows):
    base = dict.fromkeys(jobs.STATE_FIELDS)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], jobs.STATE_DDL)


def test_state(spark):
    stored, new = states(spark, {"job_id": "a", "status": "text_cleaning", "text_chunks_completed": 2}), states(spark, {"job_id": "a", "status": "created"}, {"job_id": "b", "status": "created"})
    assert {r.job_id: r.status for r in jobs.upserted(stored, new).collect()} == {"a": "text_cleaning", "b": "created"}
    p = jobs.speech_checkpoint(stored, "paused_quota", F.lit(307), F.lit(14), paused_at=F.lit("tts_chunk_0015")).first()
    assert (p.status, p.stage, p.paused_at, p.tts_chunks_completed, p.last_error_type) == ("paused_quota", "tts_generating", "tts_chunk_0015", 14, "daily_quota")
    d = jobs.speech_checkpoint(jobs.paused(stored, F.lit("x"), F.lit("y"), F.lit("z")), "completed", F.lit(3), F.lit(3), F.lit("out.wav")).first()
    assert (d.status, d.stage, d.paused_at, d.outputs) == ("completed", "completed", None, {"podcast": "out.wav"}) and d.updated_at is not None
    with pytest.raises(ValueError):
        jobs.checkpointed(stored, nonsense=F.lit(1))
    assert spark.range(1).select(jobs.resume_label(F.lit(7), F.lit(2))).first()[0] == "text_chunk_0007_subchunk_002"


@pytest.mark.parametrize("given,total,target,status", [
    (["generated", "failed"], 2, False, "partially_failed"), (["skipped", "skipped"], 3, False, "incomplete"), (["generated", "skipped"], 2, False, "completed"),
    (["generated"], 3, True, "daily_target_reached"), (["failed_configuration", "generated"], 2, True, "failed_configuration"), (["paused_quota", "failed_configuration"], 2, True, "paused_quota"),
])
def test_roll_up(spark, given, total, target, status):
    rows = spark.createDataFrame([(1, s) for s in given], "job int, status string")
    assert jobs.rolled_up(rows, "job", F.lit(total), F.lit(target)).first().status == status


def wav(frames, rate=24000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\x01\x00" * frames * channels)
    return out.getvalue()


def test_audio(spark):
    rows = [(1, bytearray(wav(2400))), (2, bytearray(wav(2400)))]
    df = spark.createDataFrame([(1, *r) for r in rows], "job int, chunk_no int, content binary")
    joined = audio.joined_wav(df, gap_ms=100).first()
    with wave.open(io.BytesIO(bytes(joined.content))) as w:
        assert (w.getnframes(), w.getframerate()) == (7200, 24000)
    counted = df.withColumn("frames", audio.wav_details(F.col("content"))["frames"])
    total = audio.concat_totals(counted, gap_ms=100).first()
    assert (total.total_frames, total.duration_seconds, total.has_gap) == (7200, 0.3, False)
    assert [(r.start_frame, r.end_frame) for r in audio.concat_plan(counted, gap_ms=100).orderBy("chunk_no").collect()] == [(0, 2400), (4800, 7200)]
    bad = spark.createDataFrame([(1, bytearray(wav(5, rate=16000))), (2, bytearray(wav(5, channels=2))), (3, bytearray(b"x" * 60)), (4, bytearray(b"x")), (5, None), (6, bytearray(wav(0) + b"\0\0"))], "i int, c binary")
    assert [r.f for r in bad.select(audio.wav_fault(F.col("c")).alias("f")).collect()] == ["sample_rate", "channels", "not_wav", "too_small", "missing", "duration"]
    pcm = spark.createDataFrame([(bytearray(b"\x01\x00" * 2400),)], "p binary").select(audio.pcm_as_wav(F.col("p")).alias("w")).first().w
    assert bytes(pcm) == wav(2400)


def test_files(spark, tmp_path):
    for k, t in ((1, "﻿bir"), (2, " "), (10, "on")):
        (tmp_path / f"chunk_{k:04d}.txt").write_text(t, encoding="utf-8")
    got = files.numbered_chunks(spark, str(tmp_path)).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.text) for r in got] == [(1, "bir"), (10, "on")]
    pages = spark.createDataFrame([("d", n, f" p{n} " if n != 3 else "") for n in range(1, 6)], "doc_id string, page_no long, text string")
    assert files.marked_pages(pages, 2, 4).first().text == "[[PDF_PAGE_2]]\n\np2\n\n[[PDF_PAGE_3]]\n\n\n\n[[PDF_PAGE_4]]\n\np4"
    b = files.banner_pages(pages, 2, 4).first()
    assert (b.total_pages, b.characters, b.pages_without_text) == (3, 4, [3]) and "[Bu sayfadan" in b.text


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "set")
    one, two = chunks(spark, [(1, 1, "a"), (1, 2, "b")]), chunks(spark, [(1, 1, "a")])
    files.write_once(one, path, "job", "chunk_no")
    files.write_once(one, path, "job", "chunk_no")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        files.write_once(two, path, "job", "chunk_no")
    with pytest.raises(ValueError):
        files.write_once(chunks(spark, [(1, 1, "A"), (1, 2, "b")]), path, "job", "chunk_no")
    assert spark.read.parquet(path).count() == 2


def test_services_skip_done_rows(spark):
    rows = chunks(spark, [(1, 1, "a  b"), (1, 2, "c")])
    done = services.applied(rows, services.identity_cleaner, "text", "out", "string", rows.where("chunk_no = 2"), ("job", "chunk_no"))
    assert [(r.chunk_no, r.out) for r in done.collect()] == [(1, "a b")]


def test_streams(spark, tmp_path):
    from folioweave.operators.segment import exploded, speech_chunks
    from folioweave.streaming.chunks import arriving, chunk_stream, write_stream

    docs = spark.createDataFrame([(i, "Bir cümle. " * 400) for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = chunk_stream(arriving(spark, str(tmp_path / "in"), "doc_id long, text string", 1))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = exploded(docs, speech_chunks(F.col("text")), "doc_id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_attempts_retry_end_and_abort():
    from folioweave.sources import services

    waits, tries = [], {}

    def call(text):
        tries[text] = tries.get(text, 0) + 1
        if text == "busy" and tries[text] < 3:
            raise RuntimeError("503 service unavailable")
        if text == "down":
            raise RuntimeError("429 rate limit")
        if text == "large":
            raise RuntimeError("413 request too large")
        if text == "quota":
            raise RuntimeError("tokens per day exhausted")
        return "" if text == "none" else text.upper()

    run = services.attempted(call, "fallback", wait=lambda message, attempt: 2.0**attempt, sleep=waits.append)
    got = run(["a", "busy", "down", "large", "none", "quota", "b"])
    assert [(r["value"], r["error_class"], r["attempts"]) for r in got] == [("A", None, 1), ("BUSY", None, 3), (None, "rate_limit", 4), (None, "request_too_large", 1), (None, "unknown", 1), (None, "daily_quota", 1), (None, None, 0)]
    assert waits == [2.0, 4.0, 2.0, 4.0, 8.0]
    assert tries == {"a": 1, "busy": 3, "down": 4, "large": 1, "none": 1, "quota": 1}


def test_model_error_of_speech_is_asked_once():
    from folioweave.sources import services

    calls = []

    def call(text):
        calls.append(text)
        raise RuntimeError("404 model_not_found")

    got = services.attempted(call, "primary_speech")(["a", "b", "c"])
    assert calls == ["a"] and [r["attempts"] for r in got] == [1, 0, 0]


def test_merged_files_follow_the_chunk_order(spark):
    from folioweave.sources import services

    rows = spark.createDataFrame([("j", n, bytes([n]) * 3) for n in (2, 1, 10)] + [("k", 1, b"x")], "job string, chunk_no int, content binary")
    assert {r.job: bytes(r.content) for r in services.merged(rows).collect()} == {"j": b"\x01\x01\x01\x02\x02\x02\x0a\x0a\x0a", "k": b"x"}
    assert {r.job: bytes(r.content) for r in services.merged(rows, lambda parts: b"%d" % len(parts)).collect()} == {"j": b"3", "k": b"1"}


def test_versioned_chunks_keep_the_old_folder(spark, tmp_path):
    from folioweave.sources import files

    rows = lambda t: spark.createDataFrame([(1, t), (2, "same")], "chunk_no int, text string")
    base = f"{tmp_path}/tts_chunks"
    assert files.write_versioned(rows("one"), base, "a" * 64, "chunk_no") == base
    assert files.write_versioned(rows("one"), base, "a" * 64, "chunk_no") == base
    assert files.write_versioned(rows("two"), base, "b" * 64, "chunk_no") == base + "_" + "b" * 12
    assert {r.text for r in spark.read.parquet(base).collect()} == {"one", "same"}
    assert {r.text for r in spark.read.parquet(base + "_" + "b" * 12).collect()} == {"two", "same"}


def test_discovery_folders_and_reviews(spark, tmp_path):
    from folioweave.functions import identity
    from folioweave.operators import audio, rewrite
    from folioweave.sources import files, services

    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    assert files.first_file(paths("b.pdf", "a.pdf"), paths("0.pdf")).first().path == "a.pdf"
    assert files.first_file(paths("z").limit(0), paths("c.pdf")).first().path == "c.pdf" and files.first_file(paths("z").limit(0), paths("z").limit(0)).isEmpty()
    stored = spark.createDataFrame([("j", "kept"), ("k", "  ")], "job string, text string")
    fresh = spark.createDataFrame([("j", "new"), ("k", "new"), ("l", "new")], "job string, text string")
    assert sorted((r.job, r.text) for r in files.layout(stored, fresh).collect()) == [("j", "kept"), ("k", "new"), ("l", "new")]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [r.name for r in files.copied_if_absent(names("a", "b"), names("b")).collect()] == ["a"]
    one = spark.range(1)
    assert one.select(files.output_folder(F.lit(8), F.lit(334))).first()[0] == "8-334"
    assert one.select(audio.is_mp3(F.lit(b"x" * 100)), audio.is_mp3(F.lit(b"x")), audio.is_mp3(F.lit(None).cast("binary"))).first()[:] == (True, False, False)
    assert one.select(identity.file_hash(F.lit(b"abc"))).first()[0].startswith("ba7816bf")
    models = spark.createDataFrame([("m1", ["generateContent", "x"]), ("m2", ["embed"])], "name string, actions array<string>")
    assert [r.name for r in services.listing(models).collect()] == ["m1"]
    texts = spark.createDataFrame([(1, "a" * 100, "a" * 100), (2, "a" * 100, "b" * 100), (3, "a" * 100, None)], "id int, source string, output string")
    assert sorted(r.id for r in rewrite.reviews(rewrite.validated(texts)).collect()) == [2, 3]
    parts = spark.createDataFrame([(1, 2, "b" * 50), (1, 1, "a" * 50)], "id int, sub_no int, text string")
    parents = spark.createDataFrame([(1, "a" * 50 + "\n\n" + "b" * 50)], "id int, source string")
    assert rewrite.revalidated(parts, parents, "id").first().validation.valid
