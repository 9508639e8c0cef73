"""Hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)
#: For a second hash, where 64 bits are too few.
MULT_2 = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when full, and never knows long words, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 100:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()

#: Words up to here are hashed together, eight bytes of all of them at a time; longer ones one by one.
LONG_WORD = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words of a string array without nulls, unlike those of WordHashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)  # so that eight bytes follow each place
    if len(data) > 8:
        data[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    at, left = offsets[:-1] - offsets[0], np.diff(offsets)
    out = left.astype(np.uint64) * MULT
    long = np.flatnonzero(left > LONG_WORD)
    who = np.flatnonzero(left <= LONG_WORD) if len(long) else np.arange(len(left))
    at, left = at[who], left[who]
    while len(who):
        h = (out[who] ^ (eight[at] & MASKS[np.minimum(left, 8)])) * MULT
        out[who] = mixed(h ^ (h >> np.uint64(32)))
        more = np.flatnonzero(left > 8)
        who, at, left = who[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs_of(h: np.ndarray, n: int, multiplier: np.uint64 = MULT) -> np.ndarray:
    """The hash of each n consecutive words, by doubling: that of a + b words is that of a, times a power, plus that of the b after it."""
    out, have, power, width = None, 0, multiplier, 1
    step = h
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                if out is None:
                    out, have = step, width
                else:
                    m = len(h) - have - width + 1
                    out, have = out[:m] * power + step[have : have + m], have + width
            if have == n:
                return mixed(out)
            m = len(step) - width
            step, power, width = step[:m] * power + step[width:], power * power, 2 * width
