"""Texts as flat numpy arrays: words and runs of words of a whole batch, without Python loops over characters or words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PLACES = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64's), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(white space by code point up to U+3000, odd factors by place)."""
    return np.array([chr(c).isspace() for c in range(0x3001)]), mix64(np.arange(PLACES)) | np.uint64(1)


class Runs:
    """White-space words of a batch of texts: ``size`` in characters, ``hash``, the ``doc`` of each; runs of words by ``grams``."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        spaces, factors = tables()
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = spaces[np.minimum(cp, 0x3000)] & (cp <= 0x3000)
        edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        self.docs, self.n = len(texts), len(start)
        self.size = stop - start
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(text_at, start, "right") - 1
        self.hash = np.zeros(self.n, np.uint64)
        if self.n:
            first = np.cumsum(self.size) - self.size
            place = np.arange(int(self.size.sum())) - np.repeat(first, self.size)
            with np.errstate(over="ignore"):
                self.hash = mix64(np.add.reduceat(mix64(cp[~space]) * factors[place & (PLACES - 1)], first) + self.size.astype(np.uint64))
        self.upto = np.r_[0, np.cumsum(self.size)]  # characters of the words before each

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, self.docs)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first, count) of every run of ``n`` words within a text, equal runs of a text side by side in order of place.

        first: whether it is the first of its kind in its text; count: how many of its kind the text has.
        """
        m = self.n - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = mix64(self.doc[:m] + (1 << 40))
            for k in range(n):
                h = h + self.hash[k : k + m] * tables()[1][k]
        place = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        place = place[np.argsort(h[place], kind="stable")]
        h = h[place]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        return place, first, np.repeat(np.diff(np.r_[at, len(h)]), np.diff(np.r_[at, len(h)])) if len(h) else at
