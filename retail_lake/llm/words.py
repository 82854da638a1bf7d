"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together (one longer text is taken alone); working memory is about
#: forty times that.
SLICE = 2_000_000
_FACTORS = np.random.default_rng(1_969).integers(1, 2**63, 4_096, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII controls, punctuation and, after lower-casing, no capitals.
ALNUM = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_low : _high + 1] = False
#: Bytes of words cut at white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
_GAP = 0x20  # stands between texts; no word byte of either kind


@dataclass
class Words:
    """Lower-cased bytes, the words in them, and the word numbers at which each text begins."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray  # one entry per text and the number of all words

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return hash_spans(self.data, self.starts, self.sizes)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes().decode(errors="replace")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span; spans must be in order and not empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], sizes)
    at = place + np.repeat(starts, sizes)
    factor = _FACTORS[place & 4_095]
    if sizes.max() > 4_096:
        factor ^= (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        factor |= np.uint64(1)
    return mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * factor, total[:-1]))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``limit`` bytes."""
    values = texts.cast(pa.large_binary())
    first, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        held += size
        if held >= limit or i == len(values) - 1:
            yield values.slice(first, i + 1 - first)
            first, held = i + 1, 0


def find(values: pa.Array, inside: np.ndarray) -> Words:
    """Lower-case A-Z and find the maximal runs of ``inside`` bytes; null texts have none."""
    raw = values.to_pylist()
    data = LOWER[np.frombuffer(bytes([_GAP]).join([*(v or b"" for v in raw), b""]), dtype=np.uint8)]
    ends = np.cumsum([len(v or b"") + 1 for v in raw])
    edge = np.diff(np.concatenate([[False], inside[data], [False]]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - starts
    first = np.concatenate([[0], np.searchsorted(starts, ends)]) if raw else np.zeros(1, dtype=np.int64)
    return Words(data, starts, sizes, first)
