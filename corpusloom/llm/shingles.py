"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased.  The set of a text
holds its distinct 5-word shingles; with one to four words, the whole sequence is one shingle.
"""

from __future__ import annotations

import re

import numpy as np

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_GAP = re.compile(rb"[\x20\x09-\x0d]+")
_powers: dict = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def forget() -> None:
    """Drop the tables of powers; they are made again when needed."""
    for name in _powers:
        _powers[name] = _powers[name][:1].copy()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the places where they start."""
    joined = np.frombuffer(data, np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((_LOWER[joined] + np.uint64(1)) * _power("up", _BASE, len(joined)), dtype=np.uint64, out=total[1:])
    words = (total[ends] - total[starts]) * _power("down", _INVERSE, len(joined))[starts]
    return mix(words + (ends - starts).astype(np.uint64)), starts


def _set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a sequence of words."""
    n = len(words) - WORDS + 1
    if n > 0:
        rolling = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolling = rolling * _STEP + words[k : n + k]
        return np.unique(mix(rolling))
    if not len(words):
        return words
    h = len(words)
    for w in words.tolist():
        h = (h * 0xA24BAED4963EE407 + w) & ((1 << 64) - 1)
    return mix(np.array([h], np.uint64))


def shingle_sets(texts: list[bytes], chunk: int = 1 << 19) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Texts are read about ``chunk`` bytes at a time, and longer ones in parts: hashing takes some 50 bytes
    of memory for each byte that is read at once.
    """
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) >= chunk:
            out += _sets_at_once(texts[start:i], chunk)
            start, held = i, 0
        held += len(t) + 1
    return out + _sets_at_once(texts[start:], chunk)


def _sets_at_once(texts: list[bytes], chunk: int) -> list[np.ndarray]:
    long = {i for i, t in enumerate(texts) if len(t) > chunk}
    words, starts = _words(b"\n".join(b"" if i in long else t for i, t in enumerate(texts)))
    stops = np.cumsum([1 + (0 if i in long else len(t)) for i, t in enumerate(texts)])
    at = np.searchsorted(starts, np.concatenate([[0], stops])) if texts else [0]
    return [_set(_long_words(t, chunk) if i in long else words[at[i] : at[i + 1]]) for i, t in enumerate(texts)]


def _long_words(text: bytes, chunk: int) -> np.ndarray:
    found, start = [], 0
    while start < len(text):
        # parts end at white space
        m = _GAP.search(text, min(start + chunk, len(text)))
        stop = m.start() if m else len(text)
        found.append(_words(text[start:stop])[0])
        start = stop
        if m:
            start = m.end()
    return np.concatenate(found)
