import pytest
from pyspark.sql import functions as F

from folioweave.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


CASES = [
    (text.normalised, "a \t b\r\n\r\n\r\n c­ ", "a b\n\nc"),
    (text.word_breaks_repaired, "seri-\nliyorken", "seriliyorken"),
    (text.word_breaks_repaired, "12-\n3", "12-\n3"),
    (text.page_banners_removed, "=" * 68 + "\npdf sayfası: 7\n[Bu sayfadan okunabilir metin çıkarılamadı.]", "\n\n\n\n"),
    (text.header_key, "Sevgi sizliĞ i", "SEVGISIZLIGI"),
    (text.is_heading, "GİRİŞ", True),
    (text.is_heading, "Kısa satır", False),
    (text.is_heading, "123", False),
    (text.precleaned_pages, "top­\nlumsal", "top lumsal"),
    (text.precleaned_pages, "[[PDF_PAGE_1]]\nbir\niki-\nüç\n12\nISBN 1\nhttp://x\nSevgisizlik\n[[PDF_PAGE_2]]\ndört\xa0", "bir ikiüç\n\ndört"),
    (text.precleaned, "GİRİŞ\nbir\niki\n• madde\ndevam\n- 9 -\n\nson-\nra", "GİRİŞ\n\nbir iki\n\n• madde devam\n\nsonra"),
    (text.finally_clean, "a  ,b\n\n\n\nc' d", "a,b\n\nc'd"),
    (text.answer_cleaned, " ```text\nBir  iki ,\n``` ", "Bir iki,"),
    (text.thinking_answer_cleaned, "<think>x\ny</think>\nÇIKTI: metin", "metin"),
    (text.thinking_answer_cleaned, "İşte düzeltilmiş metin: a\r\nb", "a\nb"),
    (text.thinking_answer_cleaned, "<think>no end", None),
    (text.xml_escaped, "a<b>&c", "a&lt;b&gt;&amp;c"),
    (text.word_count, " bir\xa0iki\n üç ", 3),
]


@pytest.mark.parametrize("f,given,expected", CASES)
def test_rules(spark, f, given, expected):
    assert one(spark, given, f) == expected


def test_page_numbers(spark):
    lines = ["9", "337", "- 9 -", "— 12 —", "12345", "", "٣", "a1"]
    df = spark.createDataFrame([(lines,)], "x array<string>")
    assert df.select(F.filter("x", lambda x: ~text.is_page_number(x))).first()[0] == ["12345", "", "a1"]


def test_lines_at_unicode_ends(spark):
    given = "a\r\nb\x0bc\x1dd e\n"
    assert one(spark, given, text.lines_of) == given.splitlines()
    assert one(spark, "", text.lines_of) == []


def test_reading_blocks(spark):
    given = "- madde\n\nGİRİŞ\n\nKısa satır\n\nBu bir\r\ncümledir.\n\n\n\n" + "UZUN " * 30
    got = [(b.kind, b.text) for b in one(spark, given, text.reading_blocks)]
    assert got == [("bullet", "madde"), ("heading", "GİRİŞ"), ("heading", "Kısa satır"), ("body", "Bu bir cümledir."), ("body", ("UZUN " * 30).strip())]


def test_job_name(spark):
    row = spark.createDataFrame([("My book (2).v1", 8, 34)], "s string, a int, b int")
    assert row.select(text.job_name(F.col("s"), F.col("a"), F.col("b"))).first()[0] == "My_book_2_v1_pages_8_34"
