"""Words of an Arrow column of texts as 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D).
Hashes are polynomials modulo 2**64 taken from prefix sums, then mixed, so the
hash of any word or window of words costs a subtraction and a multiplication.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from codestrata.llm.process import kept_in_process

BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, words of all texts in a row
    offsets: np.ndarray  # int64, text i holds words offsets[i]:offsets[i + 1]
    starts: np.ndarray  # int64, first byte of each word in ``data``
    ends: np.ndarray  # int64, byte after each word
    data: np.ndarray  # uint8, bytes of all texts
    bounds: np.ndarray  # int64, text i holds bytes bounds[i]:bounds[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _base(seed: int) -> tuple[int, int]:
    """An odd multiplier for ``seed`` and its inverse modulo 2**64."""
    base = int(mix(np.array([seed + 0x9E3779B97F4A7C15], np.uint64))[0]) | 5
    return base, pow(base, -1, 1 << 64)


def _powers(base: int, size: int) -> np.ndarray:
    def make():
        powers = np.full(rounded, base, np.uint64)
        powers[0] = 1
        return np.multiply.accumulate(powers)

    rounded = 1 << max(12, (size - 1).bit_length())
    if rounded > 2 * BLOCK_BYTES:
        return make()[:size]
    return kept_in_process(("powers", base, rounded), make)[:size]


def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x632BE59BD9B4E019))


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the bounds of each; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(column: pa.Array, lower: bool = False, seed: int = 0) -> Words:
    """Hash every word of every text; ``lower`` folds A-Z first."""
    data, bounds = texts_as_bytes(column)
    hashes, starts, ends = [], [], []
    begin, size = 0, len(data)
    breaks = np.zeros(size + 1, bool)
    breaks[bounds] = True
    while begin < size:
        stop = _block_end(data, breaks, begin)
        block, at_break = data[begin:stop], breaks[begin : stop + 1]
        space = _SPACE[block]
        first = ~space
        first[1:] &= space[:-1] | at_break[1:-1]
        last = ~space
        last[:-1] &= space[1:] | at_break[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(_hash_spans(_LOWER[block] if lower else block, s, e, seed))
        starts.append(s + begin)
        ends.append(e + begin)
        begin = stop
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (starts, np.int64), (ends, np.int64))]
    return Words(joined[0], np.searchsorted(joined[1], bounds), joined[1], joined[2], data, bounds)


def _block_end(data: np.ndarray, breaks: np.ndarray, begin: int) -> int:
    """End of a block that splits no word: about a block long, more for a longer word."""
    step = BLOCK_BYTES
    while begin + step < len(data):
        here = np.flatnonzero(_SPACE[data[begin : begin + step]])
        if len(here):
            return begin + int(here[-1]) + 1
        cuts = np.flatnonzero(breaks[begin + 1 : begin + step + 1])
        if len(cuts):
            return begin + 1 + int(cuts[-1])
        step *= 2
    return len(data)


def _hash_spans(block: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int) -> np.ndarray:
    base, inverse = _base(seed)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_letters(seed)[block] * _powers(base, len(block)), out=sums[1:])
    values = (sums[e] - sums[s]) * _powers(inverse, len(block))[s]
    return mix(values + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``hashes[i : i + width]`` for every i; texts are not told apart here."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    base, inverse = _base(seed + 101)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * _powers(base, len(hashes)), out=sums[1:])
    starts = len(hashes) - width + 1
    return mix((sums[width:] - sums[:starts]) * _powers(inverse, starts) + np.uint64(width))
