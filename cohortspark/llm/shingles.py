"""Sets of word shingles as sorted 64-bit hashes, computed with array operations over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

WORDS_PER_SHINGLE = 5

#: Bytes hashed at once.
PIECE = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_random = np.random.default_rng(20)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _random.integers(0, 1 << 63, WORDS_PER_SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(0, 1 << 61)) * 8 + 5
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a piece."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_BLANK[raw]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers_up_to(max(len(raw), PIECE))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, piece by piece; pieces end at white space."""
    raw = np.frombuffer(data, np.uint8)
    found, start = [], 0
    while start < len(raw):
        stop = min(len(raw), start + PIECE)
        if stop < len(raw):
            blanks = np.flatnonzero(_BLANK[raw[start:stop]])
            while not len(blanks) and stop < len(raw):
                stop = min(len(raw), stop + PIECE)
                blanks = np.flatnonzero(_BLANK[raw[start:stop]])
            if len(blanks) and stop < len(raw):
                stop = start + int(blanks[-1]) + 1
        starts, hashes = _hash_words(raw[start:stop])
        found.append((starts + start, hashes))
        start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([s for s, _ in found]), np.concatenate([h for _, h in found])


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of the whole sequence when it has fewer words."""
    starts, words = word_hashes(b" ".join(texts).lower())
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else []
    bounds = [0, *np.searchsorted(starts, ends).tolist()]
    k = WORDS_PER_SHINGLE
    n = max(0, len(words) - k + 1)
    sums = np.zeros(n, np.uint64)
    for i in range(k):
        sums += words[i : i + n] * _PLACE[i]
    shingles = mix(sums)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        elif b > a:
            part = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
            yield mix(np.array([part], np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
