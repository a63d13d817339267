"""Words and word windows of many texts at once, as numpy arrays of 64-bit hashes.

All word classes here are ASCII-defined, so texts are handled as UTF-8 bytes. A
block of texts is joined, words are found by one table lookup per byte, and
hashes of words and of windows of words come from prefix sums of a polynomial
modulo 2^64. Work and memory are linear in the block.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled as one block; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000

_POWERS_STEP = 1 << 18  # tables of powers grow by so many

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WINDOW_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=np.int8)


#: Words between spaces and \x09-\x0D.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of digits, ASCII letters and everything beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def worker_cache() -> dict:
    """Things that a worker process keeps from task to task. Functions travel to the
    workers by value, so names of their module do not outlive a task."""
    return sys.modules.setdefault("_corpus_worker_cache", ModuleType("_corpus_worker_cache")).__dict__


def release() -> None:
    """Gives memory that is no longer used back to the machine. A worker keeps it else, and
    other workers and the JVM of its executor share one limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to the powers 0, 1, ... and the inverses of those, modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    tables = []
    for b in (base, inverse):
        powers = np.full(size, b, dtype=np.uint64)
        powers[0] = 1
        tables.append(np.multiply.accumulate(powers))
    return tables[0], tables[1]


def powers(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    key, cache = f"powers {base}", worker_cache()
    if key not in cache or len(cache[key][0]) < size:
        cache[key] = _powers(int(base), -(-size // _POWERS_STEP) * _POWERS_STEP)
    up, down = cache[key]
    return up[:size], down[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a block. ``first[d]`` to ``first[d + 1]`` are the words of text ``d``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of the words."""
        _, down = powers(_BYTE_BASE, len(self.sums))
        return mix((self.sums[np.minimum(self.start + length, self.end)] - self.sums[self.start]) * down[self.start])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash, True where the window lies in one text) of every window of ``length`` words."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = powers(_WINDOW_BASES[seed], len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=sums[1:])
        hashes = mix((sums[length:] - sums[:n]) * down[:n] + np.uint64(length))
        text = self.text_of_word()
        return hashes, text[:n] == text[length - 1 :]


def find_words(texts: list[bytes], kind: np.ndarray, lower: bool, cut: np.ndarray | None = None) -> Words:
    """Runs of bytes of a ``kind``; ``cut`` marks bytes that start a word inside a run."""
    data = b" ".join(texts)
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = LOWER[raw]
        data = raw.tobytes()
    inside = kind[raw]
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = edge == 1, edge == -1
    if cut is not None:
        starts[:-1] |= cut
        ends[:-1] |= cut
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = powers(_BYTE_BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offset = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(start, offset)
    return Words(data, start, end, offset, first, hashes, sums)


def blocks(texts: Iterable[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Cuts a batch into (index of the first text, texts) of about ``size`` bytes."""
    at, held, taken = 0, [], 0
    for i, text in enumerate(texts):
        if held and taken + len(text) > size:
            yield at, held
            at, held, taken = i, [], 0
        held.append(text)
        taken += len(text) + 1
    if held:
        yield at, held
