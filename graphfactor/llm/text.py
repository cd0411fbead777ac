"""Words and hashes of many texts at once, on byte arrays.

A batch of texts is one byte buffer; word starts and ends, word hashes, hashes of runs of words and minima over
sliding windows are each a few numpy passes over it. Hashes are polynomials modulo 2**64 over mixed symbols.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and os.path.exists("/lib64/ld-linux-x86-64.so.2") else None
#: Text bytes handled at once; a longer text is handled alone.
SLICE = 2 << 20
#: Bytes beyond which a word has another kind of hash.
_LONG_WORD = 256
_BASE, _RUN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Bytes of words in [^\x20\x09-\x0D]+.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words in [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text).
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=U) * U(_BASE))


@lru_cache(maxsize=4)
def _power_table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for b in (base, pow(base, -1, 1 << 64)):
        t = np.full(size, b, U)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    return tables[0], tables[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(base, 1 << max(16, int(n).bit_length()))


#: Text bytes beyond which one text's words are taken part by part.
PART = 4 << 20


class Words(NamedTuple):
    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(texts: list[bytes], kept: np.ndarray, lower: bool = False) -> Words:
    """The words of texts: longest runs of the kept bytes."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buffer = LOWER[buffer]
    inside = kept[buffer].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return Words(buffer, starts, ends, np.searchsorted(starts, first))


_GAPS = {False: re.compile(rb"[\x09-\x0D\x20]"), True: re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")}


def word_parts(texts: list[bytes], kept: np.ndarray, overlap: int, lower: bool = False, limit: int = PART) -> Iterator[tuple[Words, int]]:
    """The words of texts, and 0; of one text beyond ``limit`` bytes, the words of its parts in turn, and how many words
    stand before the part. A part begins with the last ``overlap`` words of the one before, so that each run of one word
    more lies in exactly one part."""
    if len(texts) != 1 or len(texts[0]) <= limit:
        yield words(texts, kept, lower), 0
        return
    text, at, before, size = texts[0], 0, 0, limit
    while True:
        gap = _GAPS[kept is PLAIN].search(text, min(at + size, len(text)))
        stop = gap.start() if gap else len(text)
        w = words([text[at:stop]], kept, lower)
        new = len(w.starts) - overlap
        if stop == len(text):
            yield w, before
            return
        if overlap and new <= 0:
            size *= 2
            continue
        yield w, before
        at = at + int(w.starts[new]) if overlap else stop
        before, size = before + new, limit


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(w.starts), U)
    i = 0
    while i < len(out):
        at = int(w.starts[i])
        j = max(i + 1, int(np.searchsorted(w.starts, at + (1 << 17))))
        end = int(w.ends[j - 1])
        up, down = _powers(_BASE, end - at)
        sums = np.zeros(end - at + 1, U)
        np.cumsum(_SYMBOL[w.buffer[at:end]] * up[: end - at], out=sums[1:])
        s, e = w.starts[i:j] - at, w.ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
        i = j
    out = mix(out)
    # a polynomial modulo 2**64 has known clashes between long texts of two symbols
    for i in np.flatnonzero(w.ends - w.starts > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(w.buffer[w.starts[i] : w.ends[i]].tobytes())
    return out


class Runs:
    """Hashes of any runs of consecutive words."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        up, self.down = _powers(_RUN, self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(hashes * up[: self.n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` words from each start; equal words, equal hash, wherever they stand."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(U))

    def every(self, length: int) -> np.ndarray:
        """Hash of each run of ``length`` words, text borders not heeded."""
        m = max(0, self.n - length + 1)
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m] + U(length)) if m else np.empty(0, U)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its leftmost minimum."""
    if len(values) < width:
        return np.empty(0, np.int64)
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        span += step
    return place


class Stretches(NamedTuple):
    """Maximal rows of neighbouring windows whose leftmost least k-gram, the *seed*, is the same one."""

    first: np.ndarray  # first window, as a place among all words
    count: np.ndarray  # windows
    place: np.ndarray  # of the seed
    seed: np.ndarray  # hash of the seed


def stretches(runs: Runs, owner: np.ndarray, window: int, k: int) -> Stretches:
    """Winnowing: the seeds of all windows of ``window`` words that lie within one text; owner: the text of each word.

    A window's seed depends on its words alone, so two places with the same window have the same seed in it.
    """
    grams = runs.every(k)
    pick = lowest(grams, window - k + 1)
    if not len(pick):
        return Stretches(*(np.empty(0, np.int64),) * 3, np.empty(0, U))
    key = np.where(owner[: len(pick)] == owner[window - 1 :], pick, -1)
    first = np.flatnonzero(np.diff(key, prepend=-2))
    count = np.diff(first, append=len(key))
    inside = key[first] >= 0
    first, count = first[inside], count[inside]
    return Stretches(first, count, key[first], grams[key[first]])


class Spoken:
    """The words of texts in a row with one space after each, from which any run of words can be taken."""

    def __init__(self, w: Words):
        self.ends = np.cumsum(np.concatenate([[0], w.ends - w.starts + 1]))
        edge = np.zeros(len(w.buffer) + 1, np.int8)
        edge[w.starts] = 1
        edge[w.ends + 1] -= 1
        self.row = w.buffer[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        self.row[self.ends[1:] - 1] = 0x20

    def take(self, start: np.ndarray, count: np.ndarray) -> pa.Array:
        """The ``count`` words from each start, joined by one space."""
        a, b = self.ends[start], self.ends[start + count] - (np.asarray(count) > 0)
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        at = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], b - a)
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.row[at]))


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of the places 0..n-1 lie in any of the half-open intervals."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, stops, -1)
    return np.cumsum(delta[:n]) > 0


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into parts of about ``limit`` text bytes; null texts become empty."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield batch.slice(start), texts[start:]
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers live on, and large arrays leave holes in their heaps."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def repeated(column: pa.Array, places: np.ndarray) -> pa.Array:
    return column.take(pa.array(places))
