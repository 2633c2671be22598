"""Words, windows and hashes of whole text columns, computed with numpy over Arrow's own buffers.

A chunk is a run of documents whose bytes lie in one array. Words are ``[^\\x20\\x09-\\x0D]+``. The hash of any span
of bytes comes from one prefix sum (a polynomial over 64 bits), so spans of every word cost a few array operations.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if _pow["n"] < n:
        n2 = max(n, 1 << 16)
        a, b = np.full(n2, _P, np.uint64), np.full(n2, _PINV, np.uint64)
        a[0] = b[0] = 1
        with np.errstate(over="ignore"):
            _pow.update(n=n2, a=np.cumprod(a), b=np.cumprod(b))
    return _pow["a"], _pow["b"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty. A chunked array is joined first."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batches, column: str = "text", most: int = 2 << 20):
    """Record batches cut into slices of about ``most`` bytes of text; one longer text is a slice by itself. At the end
    the worker, which other tasks use again, gives back what it cached."""
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
            at = 0
            while at < n:
                to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
                to = min(n, max(at + 1, to))
                yield batch.slice(at, to - at)
                at = to
    finally:
        release()


def release() -> None:
    """Frees cached powers and returns free memory to the system, where the C library can."""
    _pow.clear()
    _pow["n"] = 0
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Words:
    """The words of a chunk: byte spans, the first word of each document, and hashes of any word span."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.buf, self.offs = (_LOWER[buf] if lower else buf), offs
        n = len(buf)
        space = _SPACE[self.buf]
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            heads = offs[:-1]
            before[heads[heads < n]] = True
            tails = offs[1:] - 1
            after[tails[tails >= 0]] = True
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.starts, offs)
        self._c = None

    def prefix(self) -> np.ndarray:
        if self._c is None:
            n = len(self.buf)
            a, _ = powers(n + 1)
            c = np.zeros(n + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(_BYTE[self.buf] * a[:n], out=c[1:])
            self._c = c
        return self._c

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        c, (_, b) = self.prefix(), powers(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            return mix((c[ends] - c[starts]) * b[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one document, and the word each starts at."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            x = mix(x * np.uint64(0x2545F4914F6CDD1D) + h[i : n - k + 1 + i])
    last = np.repeat(first[1:], np.diff(first))[: n - k + 1]  # end of the document of each word
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return x[at], at


def code_points_before(buf: np.ndarray) -> np.ndarray:
    """How many characters start before each byte position (length n + 1)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def sorted_unique(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct h of each document, sorted within it; returns them and their bounds (n_docs + 1). doc is ascending."""
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    d, x = doc[order], h[order]
    keep = np.ones(len(x), bool)
    if len(x):
        keep[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    d, x = d[keep], x[keep]
    return x, np.searchsorted(d, np.arange(n_docs + 1))
