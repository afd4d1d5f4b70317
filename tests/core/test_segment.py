import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions.text import normalised
from folioweave.operators import segment


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given,expected", [
    ("Prof. Dr. Ali geldi. Sonra gitti.", ["Prof. Dr. Ali geldi.", "Sonra gitti."]),
    ("Geldi. Dr. Ali sustu.", ["Geldi. Dr. Ali sustu."]),
    ("He reads books. Then he left.", ["He reads books. Then he left."]),
    ("Geldi. sonra gitti.", ["Geldi. sonra gitti."]),
    ("“Geldi!” Sonra\n gitti…  ?! 3 kişi", ["“Geldi!”", "Sonra gitti… ?!", "3 kişi"]),
    ("! Abc. Def", ["! Abc.", "Def"]),
    ("  ", []),
])
def test_sentences(spark, given, expected):
    assert one(spark, given, segment.sentences_of) == expected


def test_word_boundary_option(spark):
    assert one(spark, "He reads books. Then he left.", lambda c: segment.sentences_of(c, word_boundary=True)) == ["He reads books.", "Then he left."]


def test_speech_fixtures(spark):
    assert one(spark, "Kısa.\n\nDevam.", segment.speech_chunks) == ["Kısa.\n\n Devam."]
    chunks = one(spark, "Birinci cümle. İkinci cümle. " * 30, lambda c: segment.speech_chunks(c, 300, 100))
    assert [(len(x), len(x.split())) for x in chunks] == [(289, 40)] * 3
    assert one(spark, "", segment.speech_chunks) == []
    with pytest.raises(ValueError):
        segment.speech_chunks(F.lit("x"), 100, 10)


def test_small_tail(spark):
    tail = spark.createDataFrame([(["a" * 900, "b" * 40],)], "x array<string>").select(segment.merged_tail(F.col("x"), 2800, 500)).first()[0]
    assert [len(x) for x in tail] == [942]


def greedy(parts, limit, gap):
    """Plain greedy packing of (text, force) units."""
    out = []
    for t, force in parts:
        if out and not force and len(out[-1]) + len(gap) + len(t) <= limit:
            out[-1] += gap + t
        else:
            out.append(t)
    return out


def test_packing_by_brute_force(spark):
    rng = random.Random(1)
    for _ in range(20):
        words = ["w" * rng.randint(1, 60) for _ in range(rng.randint(0, 60))]
        limit = rng.randint(20, 80)
        df = spark.createDataFrame([(words,)], "x array<string>").select(segment.packed(F.transform("x", lambda w: segment.unit(w)), limit, "\n\n").alias("y"))
        assert df.first().y == greedy([(w, False) for w in words], limit, "\n\n")


def test_exact_multiple_of_limit_is_not_repeated(spark):
    given = "kısa " + "x" * 1000
    assert one(spark, given, lambda c: segment.service_chunks(c, 500, True)) == ["kısa", "x" * 500, "x" * 500]
    parts = one(spark, "A" * 600 + "\n\n" + "B" * 600, lambda c: segment.service_chunks(c, 700, True))
    assert parts == ["A" * 600, "B" * 600] and "\n\n".join(parts) == "A" * 600 + "\n\n" + "B" * 600


def test_oversize_words_stay_whole(spark):
    given = "bir iki, " + "y" * 300 + " üç; dört"
    parts = one(spark, given, lambda c: segment.long_sentence_parts(c, 200))
    assert parts == ["bir iki,", "y" * 300, "üç; dört"]


def test_long_paragraphs_keep_all_words(spark):
    rng = random.Random(2)
    given = "\n\n".join(" ".join("abc"[: rng.randint(1, 3)] + rng.choice(["", ".", ",", ";", "!"]) for _ in range(900)) for _ in range(3))
    for f in (segment.speech_chunks, lambda c: segment.service_chunks(c, 700), lambda c: segment.service_chunks(c, 700, True)):
        assert " ".join(one(spark, given, f)).split() == one(spark, given, normalised).split()


def test_warnings(spark):
    assert one(spark, "seri-\nler ­" + "x" * 300, lambda c: segment.chunk_warnings(c, 100)) == ["over_limit", "soft_hyphen", "broken_word"]
    assert one(spark, " ", segment.chunk_warnings) == ["empty"]


def test_two_levels_and_rejoin(spark):
    df = spark.createDataFrame([(1, ("Bir cümle. " * 150 + "\n\n") * 4)], "doc_id int, text string")
    parts = segment.two_level_chunks(df, "text", "doc_id")
    whole = segment.rejoined(parts, "sub_no", "doc_id", "chunk_no").orderBy("chunk_no").collect()
    assert " ".join(r.text for r in whole).split() == df.first().text.split()
