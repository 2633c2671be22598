"""Byte-level BPE ids of whole text columns: pre-tokens cut with numpy, each distinct one encoded once per worker."""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .textkit import code_points_before, mix, powers

_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space, other."""
    if not _classes:
        table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[_SPACES] = SPACE
        _classes.append(table)
    return _classes[0]


def pretokens(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``cp`` holds the code points of several documents, ``bounds`` where each starts, and the end. A run of white space
    gives a token for all but its last character, which joins the next token if it is a blank and else stands alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    at = np.flatnonzero(run)
    inner = at[(kind[at] != SPACE) & ~head[at]]  # runs of non-space that follow something in the document
    after_space = inner[kind[inner - 1] == SPACE]
    start[after_space - 1] = True
    start[after_space[cp[after_space - 1] == 0x20]] = False
    ends = np.append(at[1:], n)
    quote = at[(cp[at] == 0x27) & (ends - at == 1) & start[at] & (ends < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~head[quote + 1]]
    if len(quote):
        c1 = cp[quote + 1]
        two = quote + 2 < n
        q2 = np.minimum(quote + 2, n - 1)
        c2 = np.where(two & (kind[q2] == LETTER) & ~head[q2], cp[q2], 0)
        long = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        short = np.isin(c1, [ord(c) for c in "stmd"])
        for which, k in ((short, 2), (long & ~short, 3)):
            q = quote[which]
            start[q + 1] = False
            nxt = q + k
            nxt = nxt[nxt < n]
            start[nxt[(kind[nxt] == LETTER) & ~head[nxt]]] = True
    return np.flatnonzero(start)


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file; an id is also the rank of its merge."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    return {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class ByteBpe:
    """ids of whole chunks. A worker keeps at most ``most`` distinct pre-tokens, then forgets all and starts anew."""

    def __init__(self, path: str, most: int = 300_000):
        import tiktoken

        self.one = tiktoken.Encoding("byte_bpe", pat_str=r"[^\n]+|\n", mergeable_ranks=byte_ranks(path), special_tokens={})._core_bpe.encode_single_piece
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        ids = [self.one(w.encode()) for w in words]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        slots = len(self.offs) - 1 + np.arange(len(ids))
        self.offs = np.append(self.offs, self.offs[-1] + np.cumsum(lens))
        self.ids = np.append(self.ids, flat)
        known, slot = np.append(self.known, h), np.append(self.slot, slots)
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents of a chunk, one after the other, and where each document's begin (and the end)."""
        text = buf.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        bounds = code_points_before(buf)[offs]
        starts = pretokens(cp, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(cp))
        a, b = powers(len(cp) + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum((cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x5851F42D4C957F2D)) * a[: len(cp)], out=c[1:])
            h = mix((c[ends] - c[starts]) * b[starts] + (ends - starts).astype(np.uint64))
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.offs) > self.most:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, uniq), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            self._learn(uniq[new], [text[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        slot = self.slot[np.searchsorted(self.known, uniq)][inverse]
        lens = self.offs[slot + 1] - self.offs[slot]
        upto = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=upto[1:])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.offs[slot] - upto[:-1], lens)]
        return ids, upto[np.searchsorted(starts, bounds)]
