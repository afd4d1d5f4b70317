"""Whole texts are taken in one plain pass: no pattern is replaced or split in Spark's array functions, and no run is walked twice."""

import difflib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioweave.functions import plain, text
from folioweave.operators import rewrite, segment
from folioweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
ONE_PASS = [
    "narration",
    "tts_manifest",
    "long_sentence_parts",
    "two_level_chunks",
    "coverage_check",
    "preclean",
    "llm_chunks_cut_words",
    "chunk_warnings",
    "manifest_totals",
    "tts_chunks_small",
    "tts_chunks",
    "preclean_pages",
    "llm_chunks_2200",
    "quality_gate",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_whole_texts_take_one_pass(spark, name):
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan


def test_steps_of_narration_share_a_worker(spark):
    plan = catalogue.QUERIES["narration"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("MapInArrow") == 1


def test_trimming_knows_all_white_space(spark):
    space = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert set(text.SPACES) == set(space)
    row = spark.createDataFrame([(f"{space}a b{space}", None)], "x string, y string").select(text.strip(F.col("x")), text.right_strip(F.col("x")), text.left_strip(F.col("x")), text.strip(F.col("y"))).first()
    assert tuple(row) == ("a b", f"{space}a b", f"a b{space}", None)


def test_texts_that_are_no_unicode():
    array = pa.array([b"a\xff", None, b"b"], pa.binary()).view(pa.string())
    assert plain.values(array) == ["a�", None, "b"]


def test_slices_are_bounded():
    array = pa.array(["x" * 10] * 5 + [None] + ["y" * 100] * 2 + ["z"])
    parts = list(plain.slices(array, 4, 50))
    assert [len(p) for p in parts] == [4, 2, 1, 1, 1] and pa.concat_arrays(parts).equals(array)
    assert [len(p) for p in plain.slices(pa.array([], pa.string()))] == [0]


def test_long_runs_of_marks_and_blanks():
    assert plain.sentences("Bir" + "." * 100_000 + "x. İki") == ["Bir" + "." * 100_000 + "x.", "İki"]
    assert plain.normalised("a" + " \t" * 100_000 + "\n" * 100_000 + "b") == "a\n\nb"
    assert plain.finally_clean("a" + " \t" * 100_000 + "b") == "a b"
    assert plain.precleaned("=" * 100_000 + "-" * 100_000, (), "") == "-" * 100_000


def test_counts_are_those_of_the_chunks(spark):
    df = spark.createDataFrame([("Bir cümle. " * 70 + "\n\nİki üç, " * 90,), ("",), (None,)], "x string")
    rows = df.select(segment.speech_chunks(F.col("x"), 300, 120).alias("t"), segment.speech_counts(F.col("x"), 300, 120).alias("c")).collect()
    assert [[(len(t), len(t.split())) for t in r.t] if r.t is not None else None for r in rows] == [[tuple(c) for c in r.c] if r.c is not None else None for r in rows]
    assert len(rows[0].c) > 3 and rows[1].c == [] and rows[2].c is None


def test_parts_end_a_paragraph_once(spark):
    got = spark.createDataFrame([("Bir iki, üç dört; beş altı yedi. Son\n\n" + "y" * 30 + " z",)], "x string").select(segment.speech_records(F.col("x"), 20)).first()[0]
    assert [tuple(r) for r in got] == [("Bir iki, üç dört;", False), ("beş altı yedi.", False), ("Son", True), ("y" * 30, False), ("z", True)]


def test_coverage_of_odd_texts(spark):
    rows = spark.createDataFrame([("Bir.\u2003İki\n\nüç",), ("so\xadft",), (" \n",), (None,)], "x string").select("x", F.explode(segment.speech_covered(F.col("x"))).alias("y"))
    assert [(r.x, r.y) for r in rows.collect()] == [("Bir.\u2003İki\n\nüç", True), ("so\xadft", False)]


def test_ratio_is_that_of_difflib():
    rng = random.Random(5)

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 15)):
            p, z = rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)
            t[p : p + rng.randint(0, 20)] = rng.choice((t[z : z + rng.randint(0, 40)], ["x"], []))
        return "".join(t)

    for alphabet in ("ab", "abc ", "etaoinshrdlu ", "etaoinshrdlucmfwypvbgkqjxz ABCDEFGH.,\n", "şığüöç aeio\U0001F600中文"):
        for size in (0, 1, 7, 60, 199, 200, 201, 450, 1300):
            for _ in range(4):
                a = "".join(rng.choices(alphabet, [1 / (i + 1) for i in range(len(alphabet))], k=size))
                for b in (changed(a), a.translate(str.maketrans("aeio", "AEIO")), a.replace("e", ""), "".join(rng.choices(alphabet, k=rng.randint(0, 300)))):
                    assert rewrite.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_explanations_and_thoughts_of_odd_answers(spark):
    given = ["\u2003\n Açıklama: x", "Analiz", "Düzeltilmiş  metin", " DÜZELTİLMİŞ METİN", "a <THINK>", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = {r.i: (r.a, r.b) for r in rows.select("i", rewrite.explains(F.col("x")).alias("a"), rewrite.thinks(F.col("x")).alias("b")).collect()}
    assert [got[i] for i in range(7)] == [(True, False), (False, False), (False, False), (False, False), (False, True), (False, False), (None, None)]
