"""Words of Arrow string batches as NumPy arrays of byte ranges and 64-bit hashes.

Every separator class used here is ASCII, and in UTF-8 no byte of a longer code point is ASCII, so
splitting bytes is the same as splitting code points. Hashes do not depend on the process, so they
can be joined across executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_A_TO_Z = np.arange(256, dtype=np.uint8)
_A_TO_Z[65:91] += 32
LOWER = _A_TO_Z
SAME = np.arange(256, dtype=np.uint8)

# bytes of [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and everything beyond ASCII
ALNUM_LOWER = np.ones(256, dtype=bool)
ALNUM_LOWER[:0x30] = False
ALNUM_LOWER[0x3A:0x61] = False
ALNUM_LOWER[0x7B:0x80] = False
# letters: A-Z, a-z and everything beyond ASCII
LETTERS = np.ones(256, dtype=bool)
LETTERS[:0x41] = False
LETTERS[0x5B:0x61] = False
LETTERS[0x7B:0x80] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive rows, about `most` bytes at once; null is empty.

    A text longer than `most` comes alone and whole.
    """
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(array):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(array))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    """Words of several texts: byte ranges, 64-bit hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def joined(self, first: int, last: int) -> str:
        """Words first..last-1 with one space between them."""
        data = self.data
        return " ".join(
            data[a:b].tobytes().decode("utf-8", "replace")
            for a, b in zip(self.starts[first:last], self.ends[first:last], strict=True)
        )


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Words (maximal runs of bytes in `kind` after folding) of the texts of one slice."""
    data = fold[data]
    n = len(data)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]  # a word never runs over the end of a text
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] |= inside[cuts]
    finishes[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word; the caller drops runs over a text's end."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    total = hashes[:n].copy()
    for i in range(1, k):
        total = total * _STEP + hashes[i : i + n]
    return mix(total + np.uint64(k))
