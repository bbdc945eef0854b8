"""Texts as flat numpy arrays: the per-character work of the text operators, without Python loops.

A batch of texts becomes one array of code points. Lookup tables give each code point a kind and a folded
letter (lower case, without diacritics and hooks), so that lines, words and their 64-bit hashes come from a
few array operations. Hashes are multilinear (a fixed pseudo-random factor for each position).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SIZE = 0x30000  # planes 0 to 2; code points beyond are treated as the last of these
OTHER, LETTER, DIGIT, SPACE, MARK = 0, 1, 2, 3, 4
POSITIONS = 1 << 16
CHUNK_CHARS = 200_000  # arrays of this many items stay in the processor's cache

# fixed values: letters without a canonical decomposition, and the plain letters they stand for
HOOKED = {"ɓ": "b", "ɗ": "d", "ƙ": "k", "ƴ": "y", "ŋ": "n", "đ": "d", "ø": "o", "ł": "l", "ħ": "h", "ı": "i", "ɖ": "d", "ɛ": "e", "ɔ": "o", "ə": "e", "ƒ": "f", "ɣ": "g", "ʋ": "v"}


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, fold, value, factor, upper, canon) by code point; factor by position.

    canon: the sum of the values of the canonical decomposition in lower case. Summed over a letter and the
    marks that follow it, it is the same for every canonically equivalent spelling.
    """
    kind, fold = np.zeros(SIZE, np.uint8), np.zeros(SIZE, np.uint32)
    values = splitmix(np.arange(SIZE)) | np.uint64(1)
    canon = values.copy()
    upper = np.zeros(SIZE, bool)
    category, decompose = unicodedata.category, unicodedata.normalize
    for c in range(SIZE):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        cat = category(ch)
        if ch.isspace():
            kind[c] = SPACE
        elif cat[0] == "L":
            if cat == "Lm":
                continue  # modifier letters such as the turned comma are punctuation here
            low = ch.lower()[:1]
            base = decompose("NFD", low)[:1] if c > 127 and not 0x3400 <= c <= 0xD7A3 else low
            kind[c], fold[c] = LETTER, ord(HOOKED.get(base, base))
            upper[c] = cat in ("Lu", "Lt")
            if 0x1160 <= c <= 0x11FF:
                kind[c] = MARK  # vowels and final consonants of decomposed syllables
            if (parts := decompose("NFD", ch.lower())) != ch:
                canon[c] = sum(int(values[min(ord(x), SIZE - 1)]) for x in parts) & 0xFFFFFFFFFFFFFFFF
        elif cat[0] == "N":
            kind[c], fold[c] = DIGIT, (48 + unicodedata.digit(ch)) if cat == "Nd" else c
        elif cat[0] == "M":
            kind[c] = MARK
    factors = splitmix(np.arange(POSITIONS) + (1 << 40)) | np.uint64(1)
    return kind, fold, values, factors, upper, canon


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together at most ``most`` characters, or of one longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(cp, SIZE - 1) if len(cp) and cp.max() >= SIZE else cp


def segment_hash(terms: np.ndarray, offsets: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of segments of ``terms`` (a 64-bit value for each symbol) between offsets; an empty one gives 0.

    ``place``: each symbol's place in its segment, by default counted.
    """
    factors = tables()[3]
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        first, size = offsets[:-1][full], lengths[full]
        if place is None:
            place = np.arange(len(terms)) - np.repeat(first, size)
        else:
            size = 0  # the number of symbols depends on the spelling
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(terms * factors[place & (POSITIONS - 1)], first)
            out[full] = splitmix(sums + np.asarray(size, np.uint64)) | np.uint64(1)
    return out


class Flat:
    """Texts joined by newlines. ``cp``: code points; ``kind``: their kinds; ``starts``: each text's first place and the end."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.n = len(texts)
        self.text = "\n".join(texts)
        self.cp = code_points(self.text)
        self.kind = tables()[0][self.cp]
        self.starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
        self.starts[-1] = max(self.starts[-1] - 1, 0) + 1


class Words:
    """Words of a Flat: what lies between white space, without punctuation and marks, folded; signs alone are no words.

    ``hash``: 64-bit; ``at``: place of its first letter or digit; ``length``: letters and digits; ``offsets``: of
    each text's words; ``letters_only``: digits count as punctuation.
    """

    def __init__(self, flat: Flat, letters_only: bool = False):
        _, fold, values, *_ = tables()
        kind = flat.kind
        kept = np.flatnonzero(kind == LETTER) if letters_only else np.flatnonzero((kind == LETTER) | (kind == DIGIT))
        ends = np.searchsorted(kept, np.flatnonzero(kind == SPACE))
        cuts = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        offsets = np.r_[0, cuts[(cuts > 0) & (cuts < len(kept))], len(kept)] if len(kept) else np.zeros(1, np.int64)
        self.kept, self.n = kept, len(offsets) - 1
        self.first, self.length = offsets[:-1], np.diff(offsets)
        self.at = kept[self.first]
        self.hash = segment_hash(values[fold[flat.cp[kept]]], offsets)
        self.offsets = np.searchsorted(self.at, flat.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def line_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines per text, key of each line, hash of each line as written).

    Lines end with newlines only. A key depends on the line's letters and their marks, whatever their Unicode
    form and case; it is 0 for a line without a letter.
    """
    texts = [t or "" for t in texts]
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    kinds, _, values, _, _, canon = tables()
    cp = code_points("\n".join(texts))
    kind = kinds[cp]
    newline = np.flatnonzero(cp == 10)
    letter = kind == LETTER
    kept = np.flatnonzero(letter | (kind == MARK))
    offsets = np.r_[0, np.searchsorted(kept, newline), len(kept)]
    nth = np.cumsum(letter[kept], dtype=np.int32)  # marks share the place of their letter
    before = np.r_[np.int32(0), nth][offsets[:-1]]
    keys = segment_hash(canon[cp[kept]], offsets, nth - np.repeat(before, np.diff(offsets)))
    keys[np.r_[np.int32(0), nth][offsets[1:]] == before] = 0
    starts = np.r_[0, newline + 1, len(cp) + 1]  # the last line is hashed with a newline, as all others are
    return counts, keys, segment_hash(values[np.r_[cp, cp.dtype.type(10)]], starts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
