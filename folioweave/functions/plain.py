"""The rules of text.py and segment.py on one text, in plain Python, and columns of them.

Spark interprets patterns inside array functions at microseconds a character, and Java's patterns test a class of white
space at each of them; str has the same text model (white space, line ends, letters) and tests it at memory speed. So
whole texts go to Python once, by Arrow, a few at a time; what stands for parts of a text stays an expression.
Nothing here looks at a character more than a fixed number of times, runs of marks and blanks included.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, StringType, StructField, StructType

SOFT_HYPHEN, BREAK = "\xad", "\x1e"
TEXTS = ArrayType(StringType())
RECORDS = ArrayType(StructType([StructField("sentence", StringType()), StructField("paragraph_end", BooleanType())]))
COUNTS = ArrayType(StructType([StructField("characters", LongType()), StructField("words", LongType())]))
LEVELS = ArrayType(TEXTS)
TEXT, TRUTHS = StringType(), ArrayType(BooleanType())


# ------------------------------------------------------------------------- columns


def values(part: pa.Array) -> list:
    """Python values; bytes that are no UTF-8 become replacement characters, as in the JVM."""
    try:
        return part.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in part.cast(pa.binary()).to_pylist()]


def slices(array: pa.Array, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices of at most `rows` rows and about `size` bytes, so that Python objects of few texts live at once."""
    weights = pc.fill_null(pc.binary_length(array), 0).to_pylist() if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else [0] * len(array)
    start = held = 0
    for i, n in enumerate(weights):
        if i > start and (i - start == rows or held + n > size):
            yield array.slice(start, i - start)
            start, held = i, 0
        held += n
    yield array.slice(start)


def column(f: Callable, kind: DataType, c: Column) -> Column:
    """f of each value, null for null."""
    made = to_arrow_type(kind)

    def run(given: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else f(x) for x in values(part)], type=made) for part in slices(given)]
        out = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
        del parts
        pa.default_memory_pool().release_unused()
        return out

    run.__annotations__ = {"given": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(c)


# ------------------------------------------------------------------- normalisation


def shrunk(t: str, run: str, to: str) -> str:
    """t with `run` replaced until it is gone."""
    while run in t:
        t = t.replace(run, to)
    return t


def line_feeds(t: str) -> str:
    return t.replace("\r\n", "\n").replace("\r", "\n")


def normalised(t: str) -> str:
    t = shrunk(line_feeds(t).replace(SOFT_HYPHEN, "").replace("\t", " "), "  ", " ")
    return shrunk(t.replace(" \n", "\n").replace("\n ", "\n"), "\n\n\n", "\n\n").strip()


def one_blank(t: str) -> str:
    """Runs of blanks and tabs to one blank."""
    return shrunk(t.replace("\t", " "), "  ", " ")


LONG_BLANKS = re.compile(r"[ \t][ \t]+")
BLANKS_BEFORE_MARK = re.compile(r"[ \t]+([,.;:!?])")
BLANKS_AFTER_APOSTROPHE = re.compile(r"(?<=\w')[ \t]+(?=\w)")
BANNER = re.compile("={20,}")
# The letters that Java takes for those of PDF SAYFASI where case does not count.
PAGE_LINE = re.compile(r"[Pp][Dd][Ff] [Ssſ][Aa][Yy][Ff][Aa][Ssſ][Iiıİ]:\s*\d+")
BROKEN_WORD = re.compile(r"-[ \t]*\n[ \t]*")
PAGE_NUMBER = re.compile(r"\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—]")
ISBN = re.compile("[Iiıİ][Ssſ][Bb][Nn]")
LINK = re.compile(r"(?i:https?://|www\.)|@\w")
HEADER_LETTERS = str.maketrans("İÜŞĞÖÇ", "IUSGOC")
LOWER, UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without_long_blanks(t: str) -> str:
    """Runs of two or more blanks or tabs to one blank; a single tab stays."""
    return LONG_BLANKS.sub(" ", t) if "\t" in t else shrunk(t, "  ", " ")


def finally_clean(t: str) -> str:
    t = shrunk(without_long_blanks(t.replace(SOFT_HYPHEN, "")), "\n\n\n", "\n\n")
    if "\t" in t:
        t = BLANKS_BEFORE_MARK.sub(r"\1", t)
    else:
        for mark in ",.;:!?":
            t = t.replace(" " + mark, mark)
    return (BLANKS_AFTER_APOSTROPHE.sub("", t) if "' " in t or "'\t" in t else t).strip()


def is_letter(c: str) -> bool:
    """A letter, or a number that is no decimal digit."""
    return c.isalnum() and not c.isdecimal()


def word_breaks_repaired(t: str) -> str:
    """A letter that ends one repair opens no other, as in a pattern that takes both letters."""
    t = line_feeds(t).replace(SOFT_HYPHEN, "")
    out, at, free = [], 0, 0
    for m in BROKEN_WORD.finditer(t):
        start, end = m.span()
        if start > free and end < len(t) and is_letter(t[start - 1]) and is_letter(t[end]):
            out.append(t[at:start])
            at, free = end, end + 1
    return "".join(out) + t[at:] if out else t


def page_banners_removed(t: str, empty_page: str) -> str:
    return PAGE_LINE.sub("\n", BANNER.sub("\n", t)).replace(empty_page, "")


def is_heading(x: str) -> bool:
    if len(x) > 80:
        return False
    if x.isascii():
        b = x.encode()
        upper = len(b) - len(b.translate(None, UPPER))
        letters = upper + len(b) - len(b.translate(None, LOWER))
    else:
        found = [c for c in x if c.isalpha()]
        letters, upper = len(found), sum(c.isupper() for c in found)
    return letters > 0 and upper / letters > 0.80


def is_bullet(x: str) -> bool:
    return x[:1] in ("-", "•") and x[1:2].isspace()


def is_page_number(x: str) -> bool:
    return bool(x) and (x[0] in "-–—" or x[0].isdecimal()) and PAGE_NUMBER.fullmatch(x) is not None


def is_header(x: str, headers: tuple[str, ...], longest: int) -> bool:
    bare = "".join(x.split())
    return len(bare) <= longest and "".join(bare.upper().translate(HEADER_LETTERS).split()) in headers


def is_word(c: str) -> bool:
    """Java's word character where it knows Unicode."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Me", "Mc", "Nd", "Pc", "Nl") or c in "\u200c\u200d" or "Ⓐ" <= c <= "ⓩ"


def names_isbn(x: str) -> bool:
    return any((m.start() == 0 or not is_word(x[m.start() - 1])) and (m.end() == len(x) or not is_word(x[m.end()])) for m in ISBN.finditer(x))


def is_noise_line(x: str, headers: tuple[str, ...], longest: int) -> bool:
    if len(x) <= 4 and x.isdecimal() or is_header(x, headers, longest) or names_isbn(x):
        return True
    return ("@" in x or "://" in x or "." in x) and LINK.search(x) is not None


def joined_lines(lines: Iterable[str | None], marks: bool = True) -> str:
    """See text.joined_lines()."""
    all_ = [(x or "").strip() for x in lines]
    bullets = [marks and is_bullet(x) for x in all_]
    headings = [marks and is_heading(x) for x in all_]
    out, ended, last = [], True, len(all_) - 1
    for i, x in enumerate(all_):
        if not x:
            ended = True
            continue
        alone = headings[i] and not bullets[i]
        opens = headings[i] or bullets[i]
        out.append("\n\n" if ended or opens else "" if all_[i - 1].endswith("-") else " ")
        follows = i < last and all_[i + 1] != "" and not (headings[i + 1] or bullets[i + 1])
        out.append(x[:-1] if follows and not alone and x.endswith("-") else x)
        ended = alone
    return "".join(out).lstrip("\n")


def tidy_lines(t: str) -> list[str]:
    return [one_blank(x.strip()) for x in t.splitlines()]


def precleaned(t: str, headers: tuple[str, ...], empty_page: str) -> str:
    longest = max(map(len, headers), default=0)
    lines = [x for x in tidy_lines(word_breaks_repaired(page_banners_removed(t, empty_page))) if not is_page_number(x) and not (headers and is_header(x, headers, longest))]
    return finally_clean(joined_lines(lines))


def precleaned_pages(t: str, headers: tuple[str, ...], mark: str) -> str:
    longest = max(map(len, headers), default=0)
    lines = [x for x in tidy_lines(re.sub(mark, "\n", line_feeds(t).replace(SOFT_HYPHEN, ""))) if not x or not is_noise_line(x, headers, longest)]
    return shrunk(without_long_blanks(joined_lines(lines, False)), "\n\n\n", "\n\n").strip()


# ------------------------------------------------------------------- segmentation

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = ("Dr.", "Doç.", "Prof.", "Sn.", "Bay.", "Bayan.", "Bkz.", "bkz.", "vb.", "vs.", "örn.", "Örn.", "çev.", "Çev.", "haz.", "Haz.", "No.", "no.", "s.", "ss.", "M.", "Mr.", "Mrs.", "Ms.", "St.", "Ltd.", "Inc.")
STEMS = "|".join(a[:-1] for a in ABBREVIATIONS)
# Marks, what may close a sentence, white space before what the next one may start with.
MARKS = r"([.!?][.!?]*+[\"”’')\]]*+)"
STARTS = '\\s++(?=[A-ZÇĞİÖŞÜ0-9"“‘(])'
ENDS = {True: re.compile(rf"{MARKS}(?:{STARTS}(?!(?:{STEMS})\.))?"), False: re.compile(rf"{MARKS}(?:{STARTS})?")}
EMPTY_LINE = re.compile(r"\n\s*\n")
AFTER_CLAUSE, AFTER_MARK = re.compile(r"(?<=[;:,])\s+"), re.compile(r"(?<=[.!?])\s+")


def paragraphs(t: str) -> list[str]:
    return [p for p in map(str.strip, EMPTY_LINE.split(t.strip())) if p]


def is_abbreviation(t: str, end: int, word_boundary: bool) -> bool:
    if not word_boundary:
        return t.endswith(ABBREVIATIONS, 0, end)
    return any(t.endswith(a, 0, end) and not (end > len(a) and (t[end - len(a) - 1].isalnum() or t[end - len(a) - 1] == "_")) for a in ABBREVIATIONS)


def sentences(paragraph: str, abbreviations: bool = True, word_boundary: bool = False) -> list[str]:
    """A full stop that an abbreviation ends with is no mark, nor is a text's first character, and no sentence starts with
    an abbreviation. A run of marks is seen once: only its first can be either."""
    t = paragraph.strip()
    out, at = [], 0
    for m in ENDS[abbreviations].finditer(t):
        start, end = m.span(1)
        if m.end() == end or t[start + 1] not in ".!?" and (start == 0 or abbreviations and t[start] == "." and is_abbreviation(t, start + 1, word_boundary)):
            continue
        out.append(t[at:end])
        at = m.end()
    out.append(t[at:])
    if BREAK in t:
        out = BREAK.join(out).split(BREAK)
    return [s for s in (" ".join(x.split()) for x in out) if s]


def units(parts: Iterable[str], limit: int, cut_words: bool) -> Iterator[tuple[str, bool]]:
    """(text, cut before) of parts: a part within the limit whole, a longer one word by word after a forced cut."""
    for p in map(str.strip, parts):
        if len(p) <= limit:
            if p:
                yield p, False
            continue
        force = True
        for w in p.split():
            for k in range(0, len(w), limit) if cut_words else (0,):
                yield w[k : k + limit] if cut_words else w, force
                force = False


def packed(parts: Iterable[tuple[str, bool]], limit: int, gap: str) -> list[str]:
    """Greedy chunks of units: one that would pass the limit opens a chunk."""
    out: list[str] = []
    run: list[str] = []
    held = 0
    for t, force in parts:
        longer = held + (len(gap) if held else 0) + len(t)
        if held and (force or longer > limit):
            out.append(gap.join(run).strip())
            run, held = [t], len(t)
        else:
            run.append(t)
            held = longer
    if run:
        out.append(gap.join(run).strip())
    return out


def long_sentence_parts(sentence: str, limit: int) -> list[str]:
    return [sentence] if len(sentence) <= limit else packed(units(AFTER_CLAUSE.split(sentence), limit, False), limit, " ")


def speech_records(t: str, limit: int) -> list[tuple[str, bool]]:
    """(sentence, paragraph_end) over all paragraphs of a text, long sentences in parts."""
    out = []
    for p in paragraphs(normalised(t)):
        at = len(out)
        for s in sentences(p):
            if len(s) <= limit:
                out.append((s, False))
            else:
                out.extend((x, False) for x in long_sentence_parts(s, limit))
        if len(out) > at:
            out[-1] = out[-1][0], True
    return out


def merged_tail(chunks: list[str], limit: int, least: int) -> list[str]:
    if len(chunks) > 1 and len(chunks[-1]) < least:
        both = chunks[-2].rstrip() + "\n\n" + chunks[-1].lstrip()
        if len(both) <= limit:
            return chunks[:-2] + [both]
    return chunks


def speech_chunks(t: str, limit: int, least: int) -> list[str]:
    """Sentences are packed; a paragraph's end closes a chunk of at least `least`, else adds a gap of two line feeds."""
    out: list[str] = []
    run: list[str] = []
    held = 0
    for s, end in speech_records(t, limit):
        longer = held + (1 if held else 0) + len(s)
        if held and longer > limit:
            out.append(" ".join(run).strip())
            run, held = [], len(s)
        else:
            held = longer
        run.append(s + "\n\n" if end else s)
        if end and held >= least:
            out.append(" ".join(run).strip())
            run, held = [], 0
        elif end:
            held += 2
    if run:
        out.append(" ".join(run).strip())
    return merged_tail([x for x in out if x], limit, least)


def speech_counts(t: str, limit: int, least: int) -> list[tuple[int, int]]:
    """(characters, words) of each chunk; the chunks' texts stay here."""
    return [(len(x), len(x.split())) for x in speech_chunks(t, limit, least)]


def speech_covered(t: str, limit: int, least: int) -> list[bool]:
    """Whether the chunks hold all words of the text in order; empty without chunks."""
    chunks = speech_chunks(t, limit, least)
    return [t.split() == " ".join(chunks).split()] if chunks else []


def service_chunks(t: str, limit: int, cut_words: bool) -> list[str]:
    whole: list[tuple[str, bool]] = []
    for p in paragraphs(line_feeds(t) if cut_words else t):
        parts = [p] if len(p) <= limit else packed(units(AFTER_MARK.split(p), limit, cut_words), limit, " ")
        whole.extend((x, False) for x in parts)
    return [x for x in packed(whole, limit, "\n\n") if x]


def two_level_chunks(t: str, outer: int, inner: int) -> list[list[str]]:
    return [service_chunks(x, inner, True) for x in service_chunks(t, outer, False)]
