"""Words of a batch of texts as arrays: where they are, and 64-bit hashes of them and of runs of them.

Words are [^\\x20\\x09-\\x0D]+ in the UTF-8 bytes. Everything is done for a batch at once; hashes
are computed a segment of bytes at a time, so scratch memory doesn't grow with a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def constants(seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A random number for each byte (none for spaces), powers of an odd base, and the base."""
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    table[SPACES] = 0
    base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
    return table, powers(base, SEGMENT * 2), base


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, the end last; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of texts: starts and ends in data, and first[i]..first[i + 1] those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        word = ~SPACES[data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] = word[inner]  # a text's first word begins there, whatever the one before ends with
        end[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A hash of each word's bytes."""
        table, power, base = constants(seed)
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            until = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SEGMENT, "right")))
            low, high = self.starts[at], self.ends[until - 1]
            local = self.starts[at:until] - low
            if high - low > len(power):  # one word longer than a segment
                power = powers(base, int(high - low))
            place = np.arange(high - low)
            place -= np.repeat(local, np.diff(local, append=high - low))
            out[at:until] = np.add.reduceat(table[self.data[low:high]] * power[place], local)
            at = until
        return mixed(out + (self.ends - self.starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def run_hashes(words: np.ndarray, length: int, seed: int = 3) -> np.ndarray:
    """A hash of each run of length consecutive words; short input has none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, _, base = constants(seed)
    total = words[:n].copy()
    for j in range(1, length):
        total *= U(base)
        total += words[j : j + n]
    return mixed(total + U(length))


class Runs:
    """Hashes of any runs of words of one batch, by prefix sums."""

    def __init__(self, words: np.ndarray, seed: int = 3):
        _, _, base = constants(seed)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), len(words) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def portions(batch: pa.RecordBatch, column: int, size: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts come to about size bytes; a longer text is a part of its own."""
    _, offsets = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, until - at)
        at = until


@contextmanager
def released(forget: Callable[[], None] = lambda: None) -> Iterator[None]:
    """At the end of a task: forget what only it needed, and give idle memory back, since the worker lives on."""
    try:
        yield
    finally:
        forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed arrays otherwise
        if trim is not None:
            trim(0)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
