"""Lower-cased runs of letters of whole text columns, as code points, with hashes of any part of them."""

from __future__ import annotations

import numpy as np

from .pretoken import LETTER, classes
from .textkit import code_points_before, mix, powers

_lower: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    if not _lower:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        _lower.append(table)
    return _lower[0]


class LetterWords:
    """``starts`` and ``ends`` are code points of the chunk, ``first[d]`` is the first word of document d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        self.bounds = code_points_before(buf)[offs]
        letter = classes()[cp] == LETTER
        self.cp = lower_table()[cp]
        n = len(cp)
        head = np.zeros(n + 1, bool)
        head[self.bounds] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:] = ~letter[:-1] | head[1:n]
            after[:-1] = ~letter[1:] | head[1:n]
        self.starts = np.flatnonzero(letter & before)
        self.ends = np.flatnonzero(letter & after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.letter = letter
        self._c = None

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = powers(len(self.cp) + 1)
        if self._c is None:
            self._c = np.zeros(len(self.cp) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum((self.cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x5851F42D4C957F2D)) * a[: len(self.cp)], out=self._c[1:])
        with np.errstate(over="ignore"):
            return mix((self._c[ends] - self._c[starts]) * b[starts] + (ends - starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)
