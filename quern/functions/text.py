"""Column functions on text: words, keywords, chunks, overlap, tokens of code, and 64-bit SimHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning in a query.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must "
    "of in to for with on at by from as into about between through during before after above below up down out off over under "
    "again further then once here there when where why how all each every both few more most other some such no nor not only own "
    "same so than too very just but and or if because until while that which who whom this these those what it its i me my we our "
    "you your he him his she her they them their"
).split()

#: What separates words of the text index.
NO_WORD = r"[^\p{L}\p{N}]+"
#: What the text of a record is, in this order.
TEXT_FIELDS = ("full_text", "content", "text", "description", "message", "summary", "fact", "error", "statement")


def once(value: Column, use) -> Column:
    """use(value) with value computed once a row, where its uses (in lambdas above all) would each compute it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(text: Column) -> Column:
    """Lower-cased, with single spaces between words and none around."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def searchable(columns: list[str]) -> Column:
    """The text of a record: the first text field that it has, else all given fields one after the other."""
    there = [F.col(c) for c in TEXT_FIELDS if c in columns]
    return F.coalesce(*there) if there else F.concat_ws(" ", *(F.col(c) for c in columns))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def keywords(text: Column) -> Column:
    """Words without punctuation around them, of two bytes or more, that aren't stop words; repeats stay."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: (F.octet_length(w) > 1) & ~w.isin(STOP_WORDS))


def query_keywords(query: str) -> list[str]:
    """keywords() of one text, on the driver."""
    bare = ("".join(w) for w in (_bare(w) for w in query.lower().split()))
    return [w for w in bare if len(w.encode()) > 1 and w not in STOP_WORDS]


def _bare(word: str) -> str:
    while word and not word[0].isalnum():
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    return word


def chunks(text: Column, size: int, overlap: int) -> Column:
    """An array of pieces of so many characters, each with the last `overlap` of the one before; short text is one piece."""
    step = max(1, size - min(overlap, size - 1))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(step))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))))


def keyword_overlap(text: Column, wanted: list[str], size: int = 1600, overlap: int = 400) -> Column:
    """The best share of wanted words that a chunk of the text holds as substrings."""
    if not wanted:
        return F.lit(0.0)

    def share(chunk: Column) -> Column:
        low = F.lower(chunk)
        return sum((F.contains(low, F.lit(w)).cast("int") for w in wanted[1:]), F.contains(low, F.lit(wanted[0])).cast("int")) / len(wanted)

    return F.coalesce(F.array_max(F.transform(chunks(text, size, overlap), share)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Distinct words in both by distinct words in either; 0 of two empty texts."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def code_tokens(text: Column) -> Column:
    """Lower-cased parts of identifiers: camelCase, acronyms before words and snake_case apart; digits stay with the part they end."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+[0-9]*|[0-9]+"), F.lit(0))
    return F.transform(parts, lambda p: F.lower(p))


def ngrams(items: Column, n: int) -> Column:
    """n neighbouring items of an array at a time, joined by a space."""
    at = F.sequence(F.lit(1), F.size(items) - n + 1)
    return F.when(F.size(items) >= n, F.transform(at, lambda i: F.concat_ws(" ", F.slice(items, i, n)))).otherwise(F.array().cast("array<string>"))


def snippet(text: Column, term: str, width: int = 150) -> Column:
    """A window of the text around the first occurrence of a term, which is set in <b>; the text's start where there is none."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - (width - len(term)) // 2)
    window = F.substring(text, start, F.lit(width))
    return F.when(at > 0, F.regexp_replace(window, f"(?i)({_quoted(term)})", "<b>$1</b>")).otherwise(F.substring(text, 1, width))


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def levenshtein_transposed(a: Column, b: Column, most: int) -> Column:
    """Whether a becomes b in at most `most` edits, of which a swap of two neighbours is one (for most up to 2)."""
    near = F.levenshtein(a, b) <= most
    at = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = F.transform(at, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return near | F.coalesce((F.length(a) > 1) & F.exists(swapped, lambda s: F.levenshtein(s, b) <= most - 1), F.lit(False))


_FNV_PRIME = np.uint64(0x100000001B3)
_FNV_START = np.uint64(0xCBF29CE484222325)


def _simhash(text: str) -> int:
    """Bits set in most FNV-1a hashes of the text's 4-character grams (of a shorter text: of all of it)."""
    if not text:
        return 0
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) < 4:
        h = _FNV_START
        for byte in text.encode():
            h = (h ^ np.uint64(byte)) * _FNV_PRIME
        return int(np.uint64(h).view(np.int64))
    votes, n = np.zeros(64, np.int64), len(codes) - 3
    for a in range(0, n, 1 << 15):
        grams = np.lib.stride_tricks.sliding_window_view(codes[a : min(a + (1 << 15), n) + 3], 4)
        h = np.full(len(grams), _FNV_START, np.uint64)
        for k in range(4):
            c = grams[:, k].astype(np.uint64)
            for shift, lead, least in _utf8(c):
                byte = lead | ((c >> np.uint64(shift)) & np.uint64(0x3F if lead != 0 else 0x7F))
                h = np.where(least, (h ^ byte) * _FNV_PRIME, h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def _utf8(c: np.ndarray) -> Iterator[tuple[int, np.uint64, np.ndarray]]:
    """The UTF-8 bytes of code points, first to last: (shift, lead bits, which code points have such a byte)."""
    one, two, three = c < 0x80, c < 0x800, c < 0x10000
    yield 0, np.uint64(0), one
    yield 18, np.uint64(0xF0), ~three
    yield 12, np.uint64(0xE0), ~two & three
    yield 12, np.uint64(0x80), ~three
    yield 6, np.uint64(0xC0), ~one & two
    yield 6, np.uint64(0x80), ~two
    yield 0, np.uint64(0x80), ~one


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of normalised text, as a signed long; 0 of empty or null text."""
    return texts.map(lambda t: _simhash(" ".join(t.lower().split())) if t else 0)


@F.pandas_udf(T.DoubleType())
def deflate_ratio(texts: pd.Series) -> pd.Series:
    """Compressed by raw bytes at level 1; 1 of empty text."""
    import zlib

    return texts.map(lambda t: len(zlib.compress(t.encode(), 1)) / len(t.encode()) if t else 1.0)
