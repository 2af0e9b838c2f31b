"""Word shingles of whole batches of texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(2024))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = _RNG.integers(0, 1 << 64, 1, np.uint64)[0] | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each row begins (one more than rows); nulls are empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


#: Bytes hashed at once, about: bounds what a task holds beside the texts and 8 bytes a word.
CHUNK = 1 << 19


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of anything but ASCII white space, A-Z as a-z), and the first word of each row (one more than rows)."""
    at, hashes, starts = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and not (gaps := np.flatnonzero(_SPACE[raw[end : end + CHUNK]])).size:
            end += CHUNK
        end = min(end + int(gaps[0]), len(raw)) if end < len(raw) else len(raw)  # chunks end between words
        h, w = _chunk_hashes(raw[at:end], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at)
        hashes.append(h)
        starts.append(w + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _chunk_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; edges: where rows begin, which ends a word too."""
    ink = ~_SPACE[raw]
    if not ink.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    opens = ink.copy()
    opens[1:] &= ~ink[:-1]
    opens[edges] = ink[edges]
    starts = np.flatnonzero(opens)
    letters = raw[ink]
    first = np.cumsum(ink, dtype=np.int64)[starts] - 1  # where each word begins among its letters
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    power = np.multiply.accumulate(np.full(int(lengths.max()), _STEP, np.uint64))
    return mix(np.add.reduceat(_BYTE[letters] * power[place], first)), starts


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; fewer words than width are one shingle, none are none."""
    words, begins = word_hashes(*utf8(column))
    n = np.diff(begins)
    full = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        full += words[k : len(full) + k] * _PLACE[k]
    full = mix(full)
    out = []
    for a, m in zip(begins[:-1].tolist(), n.tolist()):
        if m >= width:
            s = np.sort(full[a : a + m - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif m:
            out.append(mix((words[a : a + m] * _PLACE[8 : 8 + m]).sum(keepdims=True, dtype=np.uint64) + np.uint64(m)))
        else:
            out.append(words[:0])
    return out


class Bloom:
    """A set of 64-bit hashes that may say yes too often; bits is a power of two."""

    def __init__(self, members: np.ndarray, bits: int):
        self.bits = bits
        self.words = np.zeros(max(bits // 8, 1), np.uint8)
        for h in self._hashes(np.asarray(members).view(np.uint64)):
            np.bitwise_or.at(self.words, h >> np.uint64(3), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))

    def _hashes(self, x: np.ndarray):
        a, b = mix(x + np.uint64(0x9E3779B97F4A7C15)), mix(x ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        for k in range(4):
            yield (a + np.uint64(k) * b) & np.uint64(self.bits - 1)

    def __contains__(self, x):
        raise TypeError("use has()")

    def has(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x).view(np.uint64)
        out = np.ones(len(x), bool)
        for h in self._hashes(x):
            out &= (self.words[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out
