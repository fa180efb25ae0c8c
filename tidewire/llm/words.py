"""Vectorised word splitting and hashing over whole Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All of those bytes
are ASCII, so splitting UTF-8 bytes equals splitting code points.  Hashes are 64-bit
polynomials modulo 2**64 (evaluated through prefix sums) followed by a mixing step;
words of more than ``LONG_WORD`` bytes are hashed with xxh64 instead, because a plain
polynomial modulo a power of two is only weak on long inputs.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GRAM_BASE = 0xD6E8FEB86659FD93
LONG_WORD = 256
SLICE_BYTES = 2 << 20
#: stands for a null id inside the operators, which give it back as null; no document may have it as its id
NO_ID = -(1 << 63)

_powers: dict[int, np.ndarray] = {}


def release_memory() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def handing_back(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that hands freed memory back at its end."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterable[pa.RecordBatch], ident: str = "doc_id", text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) for runs of rows of about ``size`` bytes; one long row is one run.

    Rows whose id is null get NO_ID.
    """
    for batch in batches:
        ids = pc.fill_null(batch.column(ident).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
        raw, off = text_buffers(batch.column(text))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield ids[at:to], raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


class Words:
    """Words of a slice: byte spans, hashes and the row that each belongs to."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False) -> None:
        if lower:
            raw = LOWER[raw]
        self.raw, self.off = raw, off
        n = len(raw)
        inside = ~SPACE[raw] if n else np.zeros(0, bool)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = off[:-1] < off[1:]
            heads, tails = off[:-1][filled], off[1:][filled] - 1
            first[heads] = inside[heads]
            last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: row d has the words at[d] .. at[d + 1]
        self.at = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.at))
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.raw)
            sums = np.zeros(n + 1, np.uint64)
            np.multiply(self.raw.astype(np.uint64) + np.uint64(1), powers(BASE, n), out=sums[1:])
            np.cumsum(sums, out=sums)
            h = (sums[self.end] - sums[self.start]) * powers(BASE_INVERSE, n + 1)[self.start]
            for k in np.flatnonzero(self.end - self.start > LONG_WORD):
                h[k] = xxhash.xxh64_intdigest(self.raw[self.start[k] : self.end[k]].tobytes())
            self._hash = mix(h)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one row."""
        h = self.hash
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        g = h[:n].copy()
        for j in range(1, k):
            g *= np.uint64(GRAM_BASE)
            g += h[j : j + n]
        return mix(g), self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by (row, hash); rows with fewer
    words but at least one have their whole word sequence as the only shingle."""
    g, ok = words.grams(k)
    n_words = np.diff(words.at)
    doc = words.doc[: len(g)][ok]
    g = g[ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n_words[short] > j
            extra[has] = extra[has] * np.uint64(GRAM_BASE) + words.hash[words.at[short[has]] + j]
        g = np.concatenate([g, mix(extra + n_words[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], doc[keep]
