"""Hashed character n-grams of whole texts, counted with numpy a chunk of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Odd multipliers of the hash of an n-gram, one for each place in it, and of the hash of its length.
MULTIPLIERS = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
#: Code points of one pass; a longer text is a pass of its own.
PASS = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, list[int]]:
    """All code points of the texts, each followed by a 0, and where each text starts (and the end)."""
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 1
    return points, [*starts, at]


def passes(ids: list, texts: list[str], limit: int = PASS) -> Iterator[tuple[list, list[str]]]:
    """Runs of texts of together at most ``limit`` code points, or of one text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield ids[lo:i], texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def slices(text: str, limit: int = PASS) -> Iterator[str]:
    """The text in parts of about ``limit`` code points that end before a space; a text without spaces is one part."""
    at = 0
    while True:
        end = text.find(" ", at + limit)
        if end < 0:
            yield text[at:]
            return
        yield text[at:end]
        at = end


def buckets(points: np.ndarray, starts: list[int], orders: Sequence[int], bits: int) -> Iterator[np.ndarray]:
    """Per text, the bucket of every n-gram of the given orders."""
    shift = np.uint32(32 - bits)
    hashed = []
    with np.errstate(over="ignore"):
        for n in orders:
            size = len(points) - n + 1
            if size <= 0:
                hashed.append(np.zeros(0, dtype=np.uint32))
                continue
            h = points[:size] * MULTIPLIERS[0]
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * MULTIPLIERS[k] + points[k : k + size] * MULTIPLIERS[0]
            h = (h + np.uint32(n)) * MULTIPLIERS[4]
            h ^= h >> np.uint32(13)
            h *= MULTIPLIERS[1]
            hashed.append(h >> shift)
    for a, b in zip(starts, starts[1:], strict=False):
        yield np.concatenate([h[a : max(a, b - n)] for n, h in zip(orders, hashed, strict=True)])


def counts(text_buckets: np.ndarray, bits: int) -> np.ndarray:
    return np.bincount(text_buckets, minlength=1 << bits)
