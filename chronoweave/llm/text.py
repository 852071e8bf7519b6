"""Text columns as byte arrays: words, lines and 64-bit hashes of spans, without a loop per character.

A word is a run of bytes other than space and \\t..\\r, the same as `[^\\x20\\x09-\\x0D]+` on characters,
because every separator is one ASCII byte.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BLOCK = 1 << 14

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = (1 << 31) - 1
_LOW, _HALF = np.uint64(_PRIME), np.uint64(31)
_RANDOM = np.random.default_rng(20240229)
_CODES = _RANDOM.integers(1, _PRIME, (2, 256)).astype(np.uint32)
_BASES = [int(b) for b in _RANDOM.integers(1 << 20, _PRIME, 2)]
_powers: dict[int, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the place where each begins (one more for the end)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, bytes, offsets) of about ``limit`` bytes; a longer text stands alone."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross a text's end: (starts, ends)."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans_of(~SPACE[data], offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces between line feeds, empty ones included; a text without one is one line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return starts, ends


def counts_between(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each text."""
    return np.diff(np.searchsorted(places, offsets))


def sums_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true bytes of each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all places."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _fold(x: np.ndarray) -> np.ndarray:
    """The same residues modulo the prime, nearer to it: below 2**34 for any, below 2**32 for less than 2**62."""
    return (x & _LOW) + (x >> _HALF)


def _power(base: int, n: int) -> np.ndarray:
    """Powers of a base from 0 on, at least ``n`` of them."""
    held = _powers.get(base, np.ones(1, np.uint32))
    while len(held) < n:
        step = np.uint64(pow(base, len(held), _PRIME))
        more = _fold(_fold(held.astype(np.uint64) * step))
        held = np.concatenate([held, more.astype(np.uint32)])
    _powers[base] = held
    return held[:n]


def prefix_hash(data: np.ndarray) -> list[np.ndarray]:
    """Running sums from which the hash of any span follows in one step.

    They are values of the text as a polynomial, modulo a prime and at two places: unlike sums modulo a power
    of two, no two texts have one value whatever the place.
    """
    out = []
    for codes, base in zip(_CODES, _BASES):
        up, running = _power(base, len(data)), np.zeros(len(data) + 1, np.uint32)
        for lo in range(0, len(data), BLOCK):  # blocks that stay in the processor's cache
            hi = min(lo + BLOCK, len(data))
            x = np.multiply(codes[data[lo:hi]], up[lo:hi], dtype=np.uint64)
            x = _fold(x)
            x[0] += running[lo]
            np.cumsum(x, out=x)
            running[lo + 1 : hi + 1] = _fold(_fold(x))
        out.append(running)
    return out


def span_hash(running: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    both = np.zeros(len(starts), np.uint64)
    for sums, base in zip(running, _BASES):
        down = _power(pow(base, -1, _PRIME), len(sums))
        value = _fold(sums[ends].astype(np.uint64) + np.uint64(4 * _PRIME) - sums[starts])
        value = _fold(_fold(value * down[starts]))
        value[value >= _LOW] -= _LOW
        both = (both << _HALF) + value
    return mix(both + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_WORD_CODES = _CODES[:, LOWER].astype(np.uint64)
_WORD_CODES[:, SPACE] = 0


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hash`` of all words over the bytes in lower case, without running sums; ``starts`` and ``ends`` are ``word_spans``."""
    both = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return both
    x = np.empty(len(data), np.uint64)
    for codes, base in zip(_WORD_CODES, _BASES):
        up, down = _power(base, len(data)), _power(pow(base, -1, _PRIME), len(data))
        for lo in range(0, len(data), BLOCK):  # blocks that stay in the processor's cache
            hi = min(lo + BLOCK, len(data))
            x[lo:hi] = _fold(codes[data[lo:hi]] * up[lo:hi])
        value = _fold(_fold(np.add.reduceat(x, starts)))  # what lies between words counts 0
        value = _fold(_fold(value * down[starts]))
        value[value >= _LOW] -= _LOW
        both = (both << _HALF) + value
    return mix(both + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours, one for each possible start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = (total * np.uint64(0xA0761D6478BD642F)) ^ mix(hashes[j : j + n] + np.uint64(j))
    return mix(total)


def rows_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row in which each sorted place lies."""
    return np.repeat(np.arange(len(offsets) - 1), counts_between(places, offsets))
