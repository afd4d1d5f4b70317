"""Text normalisation as Column -> Column functions.

Rules of lines, words and answers are expressions and run in the JVM; rules of whole texts are plain.py's.
Java's and RE2's \\s, \\w and \\d are ASCII, the text model here is Unicode, so
patterns use the explicit classes below.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions import plain

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same characters, for trim functions: they look at the ends alone.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"(?:\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"
DIGITS = r"\p{Nd}{1,4}"
SOFT_HYPHEN = "­"

# Page marks, placeholder and header keys of the source documents.
PAGE_MARK = r"\[\[PDF_PAGE_\d+\]\]"
EMPTY_PAGE = "[Bu sayfadan okunabilir metin çıkarılamadı.]"
BOOK_HEADERS = ("STATUENDISESI", "SNOPLUK", "SEVGISIZLIK")
# Prefixes that a service may put before its answer.
ANSWER_PREFIXES = ("Düzeltilmiş metin:", "Temizlenmiş metin:", "Çıktı:", "Düzeltilmiş hali:", "İşte düzeltilmiş metin:")


def replaced(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def right_strip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def left_strip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Any white space run to one space, ends stripped."""
    return strip(replaced(c, (rf"{SPACE}+", " ")))


def line_feeds(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit(SOFT_HYPHEN), F.lit(""))


def normalised(c: Column) -> Column:
    """Line feeds, no soft hyphens, single blanks, no blanks around line feeds, at most one empty line."""
    return plain.column(plain.normalised, plain.TEXT, c)


def word_breaks_repaired(c: Column) -> Column:
    return plain.column(plain.word_breaks_repaired, plain.TEXT, c)


def page_banners_removed(c: Column) -> Column:
    return plain.column(partial(plain.page_banners_removed, empty_page=EMPTY_PAGE), plain.TEXT, c)


def header_key(c: Column) -> Column:
    """A line's key for header comparison: upper case, six letters unmarked, no white space."""
    return replaced(F.translate(F.upper(c), "İÜŞĞÖÇ", "IUSGOC"), (rf"{SPACE}+", ""))


def lines_of(c: Column) -> Column:
    """Lines at any Unicode line end; a final line end opens no line."""
    whole = replaced(c, (rf"{LINE_END}\z", ""))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, LINE_END))


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(rf"\A(?:{DIGITS}|[-–—]{SPACE}*{DIGITS}{SPACE}*[-–—])\z")


def upper_share(c: Column) -> Column:
    """Upper-case letters per letter, 0 without letters."""
    letters = F.length(replaced(c, (r"[^\p{L}]", "")))
    return F.when(letters > 0, F.length(replaced(c, (r"[^\p{Lu}]", ""))) / letters).otherwise(F.lit(0.0))


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 80) & (upper_share(line) > 0.80)


def joined_lines(lines: Column, marks: bool = True) -> Column:
    """Paragraphs from wrapped lines, without a fold: what stands between two lines depends on these two alone.

    An empty line parts paragraphs; with marks a bullet opens one, and a heading is one. A final hyphen
    is dropped where the next line continues its word. Paragraphs are joined by an empty line.
    """
    return plain.column(partial(plain.joined_lines, marks=marks), plain.TEXT, lines)


def finally_clean(c: Column) -> Column:
    return plain.column(plain.finally_clean, plain.TEXT, c)


def precleaned(c: Column, headers: tuple[str, ...] = ()) -> Column:
    """Banner pages to paragraphs: marks, word breaks, page numbers and headers go, wrapped lines are joined."""
    return plain.column(partial(plain.precleaned, headers=headers, empty_page=EMPTY_PAGE), plain.TEXT, c)


def precleaned_pages(c: Column, headers: tuple[str, ...] = BOOK_HEADERS) -> Column:
    """Marked pages to paragraphs: noise lines go, lines are joined without regard to bullets and headings."""
    return plain.column(partial(plain.precleaned_pages, headers=headers, mark=PAGE_MARK), plain.TEXT, c)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unfenced(c: Column) -> Column:
    """The inside of a text that is one code fence; a last line is dropped only if it is a bare fence."""
    def inside(inner: Column) -> Column:
        kept = F.when(strip(F.element_at(inner, -1)) == "```", F.slice(inner, F.lit(1), F.size(inner) - 1)).otherwise(inner)
        return F.when(F.size(inner) == 0, "").otherwise(strip(F.array_join(kept, "\n")))

    rest = bound(lines_of(c), lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))
    return F.when(c.startswith("```") & c.endswith("```"), bound(rest, inside)).otherwise(c)


LOOSE_BLANKS = ((r"[ \t]{2,}", " "), (r"[ \t]+([,.;:!?])", "$1"), (r"\n{3,}", "\n\n"))


def answer_cleaned(c: Column) -> Column:
    """A service's answer without code fence, soft hyphens and loose blanks."""
    return bound(strip(c), lambda x: strip(replaced(without_soft_hyphens(unfenced(x)), *LOOSE_BLANKS)))


def without_thoughts(c: Column) -> Column:
    return strip(replaced(strip(c), (r"(?is)<think>.*?</think>", "")))


def is_only_thought(c: Column) -> Column:
    """An answer whose thought never ends; its cleaning is an error."""
    return F.lower(without_thoughts(c)).startswith("<think>")


def thinking_answer_cleaned(c: Column) -> Column:
    """answer_cleaned() for services that think aloud and announce; null where only a thought came back."""
    announced = "|".join(p.replace(".", r"\.") for p in ANSWER_PREFIXES)

    def clean(x: Column) -> Column:
        bare = replaced(unfenced(x), (rf"(?iu)\A(?:{announced}){SPACE}*", ""))
        rest = strip(replaced(line_feeds(without_soft_hyphens(bare)), *LOOSE_BLANKS))
        return F.when(F.lower(x).startswith("<think>"), F.lit(None).cast("string")).otherwise(rest)

    return bound(without_thoughts(c), clean)


def job_name(stem: Column, start: Column, end: Column) -> Column:
    safe = replaced(stem, (r"[^A-Za-z0-9ÇĞİÖŞÜçğıöşü_-]+", "_"), (r"\A_+|_+\z", ""))
    return F.concat(safe, F.lit("_pages_"), start.cast("string"), F.lit("_"), end.cast("string"))


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words_of(c)).cast("long")


def reading_blocks(c: Column) -> Column:
    """Array of (kind, text) blocks for a read-aloud page: bullet, heading or body."""
    paragraphs = F.transform(F.split(line_feeds(c), "\n\n"), lambda p: F.array_join(F.filter(F.transform(lines_of(strip(p)), strip), lambda x: x != ""), " "))

    def block(p: Column) -> Column:
        heading = (F.length(p) <= 80) & ((upper_share(p) > 0.75) | ~p.rlike(r"[.?!;:]\z"))
        kind = F.when(p.startswith("- "), "bullet").when(heading, "heading").otherwise("body")
        return F.struct(kind.alias("kind"), xml_escaped(F.when(p.startswith("- "), strip(F.substring(p, F.lit(3), F.length(p)))).otherwise(p)).alias("text"))

    return F.transform(F.filter(paragraphs, lambda p: p != ""), block)
