"""Words of whole texts as 64-bit hashes, vectorised over code points; shingles as hashes of word hashes.

A word is a run of letters and digits, lower-cased code point by code point. Equal words have equal hashes; what a
hash finds is meant to be verified on the words themselves (``words``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points worked on at once; a longer text goes in pieces, cut between words.
PORTION = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form; whether it is a letter or a digit."""
    points = [chr(c) for c in range(0x110000)]
    lower = np.array([ord(s) if len(s := c.lower()) == 1 else i for i, c in enumerate(points)], np.uint32)
    return lower, np.array([unicodedata.category(c)[0] in "LN" for c in points], bool)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def words(text: str | None) -> list[str]:
    lower, wordy = _tables()
    codes = lower[_codes(text or "")]
    flags = np.concatenate(([False], wordy[codes], [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
    line = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [line[a:b] for a, b in zip(edges[::2], edges[1::2])]


def _pieces(text: str) -> Iterator[str]:
    """Parts of a long text; a cut is made only where neither a letter nor a digit stands."""
    start = 0
    while len(text) - start > PORTION:
        end = start + PORTION
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and which text each is from."""
    lower, wordy = _tables()
    codes = lower[_codes("\n".join(texts))]
    flags = np.concatenate(([False], wordy[codes], [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letters = codes[flags[1:-1]].astype(np.uint64)
    first = np.cumsum(end - begin) - (end - begin)
    place = (np.arange(len(letters)) - np.repeat(first, end - begin)).astype(np.uint64)
    hashes = mix(np.add.reduceat(mix(letters * _A + (place + np.uint64(1)) * _B), first))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(starts, begin, side="right") - 1


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Place and word hashes of every text, in order; what is held at once is bounded but for one text's hashes."""
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        hashes, own = _hashed(held)
        cuts = np.searchsorted(own, np.arange(len(held) + 1))
        for k, owner in enumerate(owners):
            yield owner, hashes[cuts[k]:cuts[k + 1]]

    for place, text in enumerate(texts):
        text = text or ""
        if len(text) > PORTION:
            yield from flush()
            held, owners, size = [], [], 0
            yield place, np.concatenate([_hashed([piece])[0] for piece in _pieces(text)])
            continue
        held.append(text)
        owners.append(place)
        size += len(text)
        if size >= PORTION:
            yield from flush()
            held, owners, size = [], [], 0
    if held:
        yield from flush()


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; none if there are fewer."""
    count = len(hashes) - width + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(width):
        total = total * _B + hashes[k:k + count]
    return mix(total)


def shingles(text: str | None, width: int) -> set[str]:
    found = words(text)
    return {" ".join(found[i:i + width]) for i in range(len(found) - width + 1)}
