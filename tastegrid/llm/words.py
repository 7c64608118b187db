"""Words of many texts at once: places and 64-bit hashes, as numpy arrays.

A batch of texts is one array of bytes; A-Z are lower-cased there. A word is a run of
bytes that are no separators; since every separator is ASCII, this is the same as a
run of characters. A word's hash is a polynomial over random values of its bytes,
modulo 2^64, taken from a running sum over the batch, so no word is touched alone.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Separators of the shingle rules: ASCII white space.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
# Separators of the licence rules: all ASCII but digits and letters.
MARKS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_RANDOM = np.random.default_rng(20250101)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
# An odd base and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
# The powers are made for blocks of bytes of this length.
_BLOCK = 1 << 20


def _powers(base: int) -> np.ndarray:
    steps = np.full(_BLOCK, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(hashes: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; different values stay different."""
    hashes = (hashes ^ (hashes >> np.uint64(33))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


@dataclass
class Words:
    """The words of a batch: byte range, hash, and for each text where its words start
    in these arrays (one entry more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, separators: bytes) -> Words:
    """The words of ``texts``, lower-cased in A-Z; a null text has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    data = _LOWER[raw]
    split = np.zeros(256, bool)
    split[list(separators)] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~split[data]
    # A text ends a word; where one text follows another at once, both sides change.
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, _hashes(data, start, end), np.searchsorted(start, offsets))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte range. The running sum starts anew in each block; a word
    that lies in two is summed in both, and moved by the power of where it starts."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    for low in range(0, len(data), _BLOCK):
        part = data[low:low + _BLOCK]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _UP[:len(part)], out=total[1:])
        a, b = np.searchsorted(end, low, "right"), np.searchsorted(start, low + len(part))
        s, e = start[a:b], end[a:b]
        here = total[np.minimum(e, low + len(part)) - low] - total[np.maximum(s, low) - low]
        # Put the first byte of the word at power 0; in a later block, after those before.
        inside = s >= low
        moved = here * np.where(inside, _DOWN[np.where(inside, s - low, 0)], np.uint64(1))
        for i in np.flatnonzero(~inside):
            shift = pow(_BASE, int(low - s[i]), 1 << 64)
            moved[i] = np.uint64(int(here[i]) * shift % (1 << 64))
        out[a:b] += moved
    return mix(out + (end - start).astype(np.uint64))


def pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, first)`` of the 2-word shingles, in order and text by text."""
    n = len(words.hash)
    follows = np.ones(n, bool)
    last = words.first[1:][words.counts() > 0] - 1
    follows[last] = False
    left = np.flatnonzero(follows)
    hashes = mix(words.hash[left] * _PAIR + words.hash[left + 1]) if len(left) else words.hash[:0]
    before = np.concatenate([[0], np.cumsum(follows)])
    return hashes, before[words.first]
