"""64-bit hashes of words and of word shingles of whole texts, in numpy.

Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 text with A-Z lower-cased. A word's hash is a sum of random odd numbers of its
bytes times powers of an odd number by place, mixed; a shingle's is a mixed polynomial of its words' hashes. Two different
shingles of the same pair of documents collide with a chance of about 2**-64 for each pair of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(1 << 12, np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of some UTF-8 bytes."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.empty(len(raw), bool)
    edge[0] = not space[0]
    np.logical_and(~space[1:], space[:-1], out=edge[1:])
    begin = np.flatnonzero(edge)
    if not len(begin):
        return none
    value = _BYTE[raw]
    value[space] = 0
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(raw)]])))
    if len(raw) > len(_POWER) and place.max() >= len(_POWER):  # a word of over 4,096 bytes: its blocks get different factors
        value *= _POWER[place & (len(_POWER) - 1)] + (place >> 12).astype(np.uint64) * np.uint64(0xA24BAED4963EE408)
    else:
        value *= _POWER[place]
    return mix(np.add.reduceat(value, begin)), begin


def word_hashes(text: str | None) -> np.ndarray:
    return _hashed((text or "").encode("utf-8", "surrogatepass"))[0]


def parts_of(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, UTF-8 texts) of runs of texts of about `size` bytes; a longer text is a run of its own."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if held and n + len(data) > size:
            yield first, held
            first, held, n = i, [], 0
        held.append(data)
        n += len(data)
    if held:
        yield first, held


def many_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after the other, and the place of each text's first word, with the total at the end."""
    words, begin = _hashed(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(begin, np.concatenate([[0], ends]))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; fewer words: one of the whole sequence; none: none."""
    if not len(words):
        return words
    if len(words) < size:
        h = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            h = mix(h * _STEP + words[k : k + 1])
        return h
    n = len(words) - size + 1
    h = words[:n] * _STEP
    for k in range(1, size):
        h = (h + words[k : n + k]) * _STEP
        h ^= h >> np.uint64(32)
    return mix(h)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text), size))
