"""Vectorised text primitives shared by the Python-side operators.

Everything works on bounded chunks of whole texts: a chunk is a run of texts
(or of segments of one long text, cut where no word can span the cut) that is
joined into one buffer and handled with numpy, so that Python-level work is
done once per *distinct* piece of a chunk and never once per character or word.

Hashes are polynomial prefix hashes modulo 2**64 over per-symbol random 64-bit
values; the odd base has an inverse, so any segment's hash is two lookups.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

#: Characters of a chunk that is cut into pieces, and of one whose words are hashed; a character takes some 60 bytes meanwhile.
CHUNK_CHARS = 1_000_000
HASH_CHARS = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
SEP, LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3, 4

# The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contraction endings of the published split pattern.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")


@lru_cache(None)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(None)
def _mix(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, size=n, dtype=np.uint64) * _U(2) + _U(1)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n; only those for one chunk are kept."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_CHARS + 2)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[key] = out
    return _powers["p"], _powers["i"]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol value times power, with a leading 0."""
    p, _ = _power(len(symbols))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * p[: len(symbols)], out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = _power(len(prefix))
    return finish((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def finish(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbouring values (hashes), in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + values[k : k + n]) * _U(_BASE)
    return finish(out + _U(width))


def chunked(texts: list[str], size: int = CHUNK_CHARS, break_at: str = r"(?<=\S)(?=\s)"):
    """Yield (document numbers, segments) of about `size` characters.

    A longer text is cut at a place matching `break_at`, where no piece can
    span the cut; its segments come in order and repeat its number.
    """
    numbers, parts, held = [], [], 0
    for i, text in enumerate(texts):
        segments = [text]
        if len(text) > size:
            segments, at = [], 0
            while len(text) - at > size:
                found = re.compile(break_at).search(text, at + size // 2)
                if not found:
                    break
                segments.append(text[at : found.start()])
                at = found.start()
            segments.append(text[at:])
        for segment in segments:
            if parts and held + len(segment) > size:
                yield numbers, parts
                numbers, parts, held = [], [], 0
            numbers.append(i)
            parts.append(segment)
            held += len(segment)
    if parts:
        yield numbers, parts


# ---------------------------------------------------------------- tokenizers


def split_pieces(texts: list[str], style: str):
    """Pre-tokenise joined texts: (joined, starts, ends, pieces before each text).

    style "spaced": runs of letters, numbers or other characters with one
    leading space, contractions, white-space runs. style "words": runs of
    letters or others, single numbers, contractions; white space is dropped.
    """
    joined = "\n".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    cls = _classes()[cp]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)]
    cls[begin[1:] - 1] = SEP
    if not n:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    if style == "spaced":
        end = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != SEP)) + 1
        start[end - 1] = True
        start[end] = cp[end - 1] != 32
    else:
        start |= cls == NUMBER
    quote = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (cls[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in CONTRACTIONS_1])
        long = np.zeros(len(quote), bool)
        for a, b in CONTRACTIONS_2:
            long |= (one == ord(a)) & (two == ord(b))
        long &= (np.where(quote + 2 < n, cls[np.minimum(quote + 2, n - 1)], SEP) == LETTER)
        start[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long & ~short] + 3])
        start[after[after < n]] = True
    bounds = np.flatnonzero(start)
    kind = cls[bounds]
    ends = np.append(bounds[1:], n)
    keep = kind != SEP if style == "spaced" else (kind != SEP) & (kind != SPACE)
    bounds, ends = bounds[keep], ends[keep]
    return joined, bounds, ends, np.append(np.searchsorted(bounds, begin), len(bounds))


def numbered_pieces(parts: list[str], style: str, longest: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of joined texts, the number of each piece in turn, pieces before each text, starts and ends.

    Pieces of over `longest` characters are not hashed but each its own.
    """
    joined, starts, ends, before = split_pieces(parts, style)
    if not len(starts):
        return [], np.zeros(0, np.int64), before, starts, ends
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = segment_hash(prefix_hash(_mix(0x110000)[cp]), starts, ends)
    long = np.flatnonzero(ends - starts > longest)
    h[long] = finish(np.arange(len(long), dtype=np.uint64))
    codes, uniq = pd.factorize(h)
    first = np.empty(len(uniq), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], codes, before, starts, ends


class PieceEncoder:
    """Byte-pair encoding of whole texts, with the merges run once per distinct piece.

    kind "json_spaced", "json_words" or "ranks": the vocabulary files of
    byte-level BPE (leading spaces), of BPE with word ends, and of ranks.
    Ids are the file's own; results equal the libraries'.
    """

    CACHE = 150_000

    def __init__(self, path: str, kind: str):
        import tiktoken

        self.words = kind == "json_words"
        self.added: dict[str, int] = {}
        if kind == "ranks":
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        else:
            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            model = file["model"]
            for x in file.get("added_tokens") or []:
                if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
                    raise ValueError(f"added token {x['content']} has options that are not supported")
                self.added[x["content"]] = x["id"]
            ranks = byte_ranks(model["vocab"], model.get("end_of_word_suffix") or "")
        self.core = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cache: dict[str, list[int]] = {}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def piece(self, text: str) -> list[int]:
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            data = text.encode("utf-8", "surrogatepass")
            got = self.core.encode_single_piece(data + b"\xff" if self.words else data)
            if len(text) < 64:
                self.cache[text] = got
        return got

    def normal(self, text: str) -> str:
        if not self.words:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; tokens that the file adds to its model are cut out of the raw text first."""
        if self.cut is None or not any(map(self.cut.search, texts)):
            return self._plain(texts)
        cut = [self.cut.split(x) for x in texts]  # plain, token, plain, ...
        plain = iter(self._plain([y for x in cut for y in x[::2]]))
        return [np.concatenate([np.array([self.added[y]], np.uint32) if k % 2 else next(plain) for k, y in enumerate(x)]) for x in cut]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, parts in chunked(texts):
            flat, offsets = self._chunk([self.normal(x) for x in parts])
            for k, i in enumerate(numbers):
                out[i].append(flat[offsets[k] : offsets[k + 1]])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _chunk(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, codes, before, _, _ = numbered_pieces(parts, "words" if self.words else "spaced", 200)
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(len(parts) + 1, np.int64)
        ids = [self.piece(x) for x in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        at = np.cumsum(size) - size
        count = size[codes]
        ends_at = np.cumsum(count)
        tokens = flat[np.repeat(at[codes] - (ends_at - count), count) + np.arange(int(ends_at[-1]))]
        return tokens, np.concatenate([[0], ends_at])[before]


def byte_ranks(vocab: dict[str, int], suffix: str) -> dict[bytes, int]:
    """Bytes of each token by the usual printable stand-ins of bytes; a word end becomes the byte FF, which UTF-8 never has."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    out = {}
    for token, i in vocab.items():
        ended = bool(suffix) and token.endswith(suffix)
        out[bytes(back[c] for c in (token[: -len(suffix)] if ended else token)) + b"\xff" * ended] = i
    return out


@lru_cache(None)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder a Python worker, kept between tasks."""
    return PieceEncoder(path, kind)


# ------------------------------------------------------- words, lines, shingles

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a chunk of texts, as arrays over its UTF-8 bytes."""

    def __init__(self, texts: list[str], lower: bool = False):
        coded = [x.encode("utf-8", "surrogatepass") for x in texts]
        data = np.frombuffer(b"\n".join(coded), np.uint8)
        self.data = _LOWER[data] if lower else data
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])[: len(texts)]
        self.end = self.begin + size
        self.inside = ~_IS_SPACE[self.data]
        edge = np.diff(np.concatenate([[0], self.inside.view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.before = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        self.counts = np.diff(self.before)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self._prefix = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_hash(_mix(256)[self.data])
        return self._prefix

    def hashes(self) -> np.ndarray:
        return segment_hash(self.prefix, self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.end] - total[self.begin]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of \\n-split lines, over all texts of the chunk."""
        cut = np.flatnonzero(self.data == 10)
        return np.concatenate([[0], cut + 1]), np.append(cut, len(self.data))


def window_docs(words: Words, width: int) -> np.ndarray:
    """Which word positions begin a window that stays within its text."""
    n = len(words.starts) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])


#: Where a text can be cut without cutting a word.
WORD_END = r"(?<=[^ \t-\r])(?=[ \t-\r])"


def long_words(text: str, lower: bool = False):
    """Words of a text over one chunk, segment by segment, so that a character's arrays never cover the whole text."""
    for _, parts in chunked([text], HASH_CHARS, WORD_END):
        for part in parts:
            yield Words([part], lower)


def _long_set(text: str, width: int) -> np.ndarray:
    h = np.concatenate([w.hashes() for w in long_words(text, lower=True)])
    return np.unique(windows(h, min(width, len(h)))) if len(h) else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased word shingles of each text: (hashes sorted within texts, offsets).

    A text with fewer words has its whole sequence as one shingle; without words, none.
    """
    sets: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, parts in ((range(k, k + len(p)), p) for k, p in _whole_chunks(texts)):
        if len(parts[0]) > HASH_CHARS:
            sets[numbers[0]] = _long_set(parts[0], width)
            continue
        w = Words(parts, lower=True)
        h = w.hashes()
        at = window_docs(w, width)
        docs, values = w.doc[at], windows(h, width)[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((w.counts > 0) & (w.counts < width))
        extra = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short):
            mine = h[w.before[i] : w.before[i + 1]]
            extra[k] = windows(mine, len(mine))[0]
        docs, values = np.concatenate([docs, short]), np.concatenate([values, extra])
        order = np.lexsort((values, docs))
        docs, values = docs[order], values[order]
        keep = np.ones(len(docs), bool)
        keep[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
        docs, values = docs[keep], values[keep]
        cut = np.searchsorted(docs, np.arange(len(parts) + 1))
        for k, i in enumerate(numbers):
            sets[i] = values[cut[k] : cut[k + 1]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)).astype(np.uint64), np.concatenate([[0], np.cumsum(size)])


def _whole_chunks(texts: list[str], size: int = HASH_CHARS):
    """Runs of whole texts of at most `size` characters, a longer text by itself: (number of the first, texts)."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if i > at and held + len(text) > size:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, texts[at:]
