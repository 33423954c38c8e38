"""Finding the literal parts of very many LIKE patterns in texts, in one pass over the texts' bytes.

A pattern is looked up by one run of its characters (see :func:`~cohortspark.operators.pattern_table.pattern_grams`): at
each place of a text the next bytes are hashed into a map of these runs, and where one is found, the whole literal part
around it is compared. Patterns with more in them than one literal are then tested as a whole. UTF-8 shows where a character
begins, so equal bytes are equal characters.

Which run stands for a pattern changes the time and no result: it is the one that is rarest in the first texts of a task,
and among equals the one that the fewest patterns share. When texts come that hold the chosen runs often, their counts are
added and runs chosen anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once: what is made of them stays in a CPU's cache.
WINDOW = 1 << 17

#: Runs found and literals to compare them with that are laid out at once.
MOST_PAIRS = 1 << 20

#: Runs are counted by a hash of so many bits.
COUNT_BITS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)

#: The first n of eight bytes, as a number in which the first byte is the lowest.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _place(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values * _ODD) >> np.uint64(64 - bits)).view(np.int64)


def _words(padded: np.ndarray) -> np.ndarray:
    """From each byte the eight that begin there, without a copy; the last seven bytes are padding."""
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


class Runs(NamedTuple):
    """Patterns in ascending order, and arrays with one entry for each run of each pattern."""

    patterns: pa.Array
    plain: np.ndarray  # of each pattern: a literal between two %, which is all that there is to find
    escaped: np.ndarray  # of each pattern: it holds an escape and is left to SQL
    always: np.ndarray  # patterns without a literal
    owner: np.ndarray  # the number of the run's pattern, ascending
    length: np.ndarray  # bytes that are hashed: as many as the run has characters
    value: np.ndarray  # these bytes
    shared: np.ndarray  # runs of other patterns that look the same
    back: np.ndarray  # bytes from the literal's start to the run
    start: np.ndarray  # the literal in `letters`
    size: np.ndarray
    letters: np.ndarray

    def pattern(self, number: int) -> bytes:
        return self.patterns[number].as_buffer().to_pybytes()


def runs_of(table: pa.Table) -> Runs:
    """Of (pattern, run, characters of the run); the empty run stands for a pattern without literals."""
    of: dict[bytes, list[tuple[bytes, int]]] = {}
    for batch in table.to_batches(max_chunksize=1 << 14):
        for pattern, run, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of.setdefault(pattern, []).append((run, n))
    names, letters = sorted(of), bytearray()
    always, found = [], []
    for i, pattern in enumerate(names):
        parts = [(m.start(), m[0]) for m in re.finditer(rb"[^%_\\]+", pattern)]
        for run, n in of[pattern]:
            if not run:
                always.append(i)
            # one that begins within a surrogate pair is in no part
            for at, part in [x for x in parts if run and run in x[1]][:1]:
                found.append((i, n, int.from_bytes(run[:n], "little"), part.index(run), len(letters) + at, len(part)))
        letters += pattern
    owner, length, value, back, start, size = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else [[]] * 6))
    _, same, count = np.unique(value << 3 | length, return_inverse=True, return_counts=True)
    escaped = np.array([b"\\" in x for x in names], bool)
    plain = np.array([re.fullmatch(rb"%[^%_\\]+%", x) is not None for x in names], bool)
    return Runs(
        pa.array(names, pa.binary()).view(pa.string()), plain, escaped,
        np.array(always, np.int64), owner, length, value.view(np.uint64), count[same], back, start, size,
        np.frombuffer(bytes(letters) + bytes(8), np.uint8),
    )


def _after(pieces: list[bytes], text: bytes, at: int) -> int:
    """Where the pieces end that begin at this place, with one character between each two; -1 if they do not stand there."""
    for i, piece in enumerate(pieces):
        if i:
            if at >= len(text):
                return -1
            at += 1
            while at < len(text) and text[at] & 0xC0 == 0x80:
                at += 1
        if not text.startswith(piece, at):
            return -1
        at += len(piece)
    return at


def _before(pieces: list[bytes], text: bytes, at: int) -> int:
    """Where the pieces begin that end at this place; -1 if they do not stand there."""
    for i, piece in enumerate(reversed(pieces)):
        if i:
            if at <= 0:
                return -1
            at -= 1
            while at > 0 and text[at] & 0xC0 == 0x80:
                at -= 1
        if not text.endswith(piece, 0, at):
            return -1
        at -= len(piece)
    return at


def _next(pieces: list[bytes], text: bytes, begin: int, end: int) -> int:
    """Where the first place of the pieces between these two ends; -1 if there is none."""
    k = max(range(len(pieces)), key=lambda i: len(pieces[i]))
    at = text.find(pieces[k], begin, end)
    while at >= 0:
        if _before([*pieces[:k], b""], text, at) >= begin:
            over = _after([b"", *pieces[k + 1 :]], text, at + len(pieces[k]))
            if 0 <= over <= end:
                return over
        at = text.find(pieces[k], at + 1, end)
    return -1


@lru_cache(1 << 12)
def like(pattern: bytes) -> Callable[[bytes], bool]:
    """SQL's LIKE for UTF-8 and a pattern without escapes.

    What stands between two % has a fixed number of characters, so it can take its first place each time: there is no going back.
    """
    head, *rest = (part.split(b"_") for part in pattern.split(b"%"))
    if not rest:
        return lambda text: _after(head, text, 0) == len(text)
    *middle, tail = rest

    def test(text: bytes) -> bool:
        end = _before(tail, text, len(text))
        at = _after(head, text, 0) if end >= 0 else -1
        if at < 0 or at > end:
            return False
        for pieces in middle:
            if (at := _next(pieces, text, at, end)) < 0:
                return False
        return True

    return test


class Search:
    """The patterns that each text matches."""

    def __init__(self, runs: Runs) -> None:
        self.runs, self.literals = runs, _words(runs.letters)
        self.seen = {int(n): np.zeros(1 << COUNT_BITS, np.int64) for n in np.unique(runs.length)}
        self.lists: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.excess = 0  # pairs laid out beyond one for eight bytes, since runs were chosen

    def choose(self, words: np.ndarray) -> None:
        """Count the runs of these bytes and choose the rarest of each pattern."""
        runs = self.runs
        held = np.zeros(len(runs.owner), np.int64)
        for n, seen in self.seen.items():
            seen += np.bincount(_place(words & _FIRST[n], COUNT_BITS), minlength=len(seen))
            mine = runs.length == n
            held[mine] = seen[_place(runs.value[mine], COUNT_BITS)]
        order = np.lexsort((runs.shared, held, runs.owner))
        chosen = order[np.diff(runs.owner[order], prepend=-1) > 0]
        bits = min(22, max(12, len(chosen).bit_length() + 4))
        self.excess = 0
        for n in self.seen:
            mine = chosen[runs.length[chosen] == n]
            places = _place(runs.value[mine], bits)
            many = np.bincount(places, minlength=1 << bits).astype(np.int32)
            first = np.cumsum(many, dtype=np.int32) - many
            self.lists[n] = bits, many > 0, many, first, mine[np.argsort(places, kind="stable")]

    def _literals(self, at: np.ndarray, row: np.ndarray, entry: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the entries' literals stand in their texts, with the run at these places."""
        runs = self.runs
        at, size = at - runs.back[entry], runs.size[entry]
        left = np.flatnonzero((at >= ends[row]) & (at + size <= ends[row + 1]))
        start, done = runs.start[entry], 0
        held = np.zeros(len(at), bool)
        while len(left):
            rest = size[left] - done
            want = self.literals[start[left] + done] & _FIRST[np.minimum(rest, 8)]
            same = words[at[left] + done] & _FIRST[np.minimum(rest, 8)] == want
            held[left[same & (rest <= 8)]] = True
            left, done = left[same & (rest > 8)], done + 8
        return held

    def _pairs(self, words: np.ndarray, begin: int, end: int, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Text number times the count of patterns plus the pattern's number, for the places from ``begin`` to ``end``."""
        here = words[begin:end].copy()
        if self.seen and not self.lists:
            self.choose(here)
        runs = self.runs
        for n, (bits, known, many, lists, entries) in self.lists.items():
            place = _place(here & _FIRST[n], bits)
            hit = np.flatnonzero(known[place])
            first, count = lists[place[hit]], many[place[hit]]
            hit += begin
            row = np.searchsorted(ends, hit, side="right") - 1
            upto = np.cumsum(count, dtype=np.int64)
            self.excess += count.sum(dtype=np.int64)
            done = 0
            while done < len(hit):
                before = upto[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(upto, before + MOST_PAIRS, side="right")))
                part = np.repeat(np.arange(done, stop), count[done:stop])
                entry = entries[first[part] + np.arange(before, upto[stop - 1]) - (upto - count)[part]]
                held = self._literals(hit[part], row[part], entry, words, ends)
                yield np.unique(row[part[held]] * len(runs.patterns) + runs.owner[entry[held]])
                done = stop
        self.excess = max(0, self.excess - len(here) // 8)
        if self.excess > 4 * len(runs.owner):
            self.choose(here)

    def __call__(self, texts: pa.Array) -> pa.StructArray:
        """``found``: patterns that match each text; ``likely``: those with an escape that may match it. Both in ascending order."""
        runs, n = self.runs, len(texts)
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends, data = texts.buffers()[1:]
        ends = np.frombuffer(ends, wide)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        padded = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
        if len(padded) > 8:
            padded[:-8] = np.frombuffer(data, np.uint8, len(padded) - 8, ends[0])
        words, ends = _words(padded), ends - ends[0]
        pairs = [(np.arange(n)[:, None] * len(runs.patterns) + runs.always).ravel()]
        for begin in range(0, len(padded) - 8, WINDOW):
            pairs += self._pairs(words, begin, min(begin + WINDOW, len(padded) - 8), ends)
        row, pattern = np.divmod(np.unique(np.concatenate(pairs)), len(runs.patterns))
        kept, last, text = np.ones(len(row), bool), -1, b""
        others = np.flatnonzero(~(runs.plain | runs.escaped)[pattern])
        for i, r, p in zip(others.tolist(), row[others].tolist(), pattern[others].tolist(), strict=True):
            if r != last:
                last, text = r, padded[ends[r] : ends[r + 1]].tobytes()
            kept[i] = like(runs.pattern(p))(text)
        row, pattern = row[kept], pattern[kept]

        def listed(mine: np.ndarray) -> pa.ListArray:
            offsets = np.searchsorted(row[mine], np.arange(n + 1))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs.patterns.take(pa.array(pattern[mine])))

        return pa.StructArray.from_arrays([listed(~runs.escaped[pattern]), listed(runs.escaped[pattern])], ["found", "likely"])
