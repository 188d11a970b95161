"""Words and word shingles of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Longer texts are hashed in parts, cut at blanks.
PART = 1 << 18

# A word's hash is the sum of its bytes' values times powers of BASE, modulo 2**64. BASE is odd, so
# the sums up to the word's end and start give it with one multiplication.
BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(PART, BASE, np.uint64)))
_INVERSE = np.cumprod(np.append(np.uint64(1), np.full(PART, pow(BASE, -1, 2**64), np.uint64)))
_VALUES = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_LETTER = np.ones(256, bool)  # 32 and 9 to 13 are the blanks
_LETTER[[32, *range(9, 14)]] = False
_VALUES[~_LETTER] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on each bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, in order."""
    data, parts = (text or "").encode().lower(), []
    while len(data) > PART:
        cut = max(data.rfind(c, 0, PART) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if cut < 0:
            break  # a word longer than that
        parts.append(data[:cut])
        data = data[cut:]
    parts.append(data)
    return np.concatenate([_hashed(np.frombuffer(x, np.uint8)) for x in parts])


def _hashed(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    if len(data) <= PART:
        np.cumsum(_VALUES[data] * _POWERS[: len(data)], out=sums[1:])
        raw = (sums[end] - sums[start]) * _INVERSE[start]
    else:  # long words: each by itself, in parts
        raw = np.array([_long_word(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
    return mix(raw + (end - start).astype(np.uint64) * GOLDEN)


def _long_word(word: np.ndarray) -> int:
    total, factor = 0, 1
    for at in range(0, len(word), PART):
        part = _VALUES[word[at : at + PART]]
        total += factor * int((part * _POWERS[: len(part)]).sum(dtype=np.uint64))
        factor = factor * pow(BASE, PART, 2**64) % 2**64
    return total % 2**64


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each window of ``size`` words, in order; of the whole sequence if it is shorter; none without words."""
    n = min(size, len(words))
    if n == 0:
        return words
    got = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        got = mix(got * GOLDEN + words[k : len(words) - n + 1 + k])
    return got
