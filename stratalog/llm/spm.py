"""SentencePiece encoding and decoding without the library, batched with numpy.

A model file is read directly (its protocol-buffer fields are few). Text is escaped as the model says, and cut before
each run of the blank mark that follows another character, which no piece crosses; equal words are encoded once.

Unigram models: batched Viterbi. Words of equal length advance together: for each end position the hashes of all
substrings up to the longest piece probe the sorted piece keys, and vectorised maxima store the back-pointers.
BPE models: the library doesn't maximise a sum of scores there, it merges the best-scored neighbours step by step, so
Viterbi would give other ids. The same machinery runs the merges instead: words of equal length advance together,
hashes of all joined neighbours probe the sorted piece keys, and a vectorised maximum takes the leftmost best merge.
Characters in no piece become byte pieces (or the unknown id).

Defined results: null text counts as empty and gives no ids; rows with null or repeated doc_id are encoded each by
their text; an empty table gives an empty result; extra columns are ignored. Decoding undoes encoding exactly for texts
the model represents (with byte pieces: all); ids out of range raise.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare
from .textkit import mix, powers, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message; length-delimited values are bytes."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, raw[at : at + 4]
            at += 4
        elif kind == 1:
            yield tag >> 3, raw[at : at + 8]
            at += 8
        else:
            raise ValueError("not a model file")


class Pieces:
    """A model: pieces, scores, kinds and the settings that matter here. Only identity normalisation is supported."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(1, b"identity") != b"identity" or normal.get(2):
            raise ValueError("only models with identity normalisation are supported")
        self.model = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1), "other")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.prefix = bool(normal.get(3, 1))
        self.squeeze = bool(normal.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        if any(self.kinds[i] == USER for i in usable):
            raise ValueError("user-defined symbols are not supported")
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        h = np.array([hash_of(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], np.array(usable, np.int64)[order]
        self.score = np.array(self.scores)
        self.bytes = np.full(256, self.unknown, np.int64)
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.low = min((self.scores[i] for i in usable), default=0.0)

    @staticmethod
    @cache
    def load(path: str) -> Pieces:
        with open(path, "rb") as f:
            return Pieces(f.read())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.key_ids[at], -1)


def prefix_hashes(cp: np.ndarray) -> np.ndarray:
    """(..., n + 1) running sums from which :func:`sub_hash` hashes any substring of the last axis."""
    a, _ = powers(cp.shape[-1] + 1)
    c = np.zeros((*cp.shape[:-1], cp.shape[-1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x5851F42D4C957F2D)) * a[: cp.shape[-1]], axis=-1, out=c[..., 1:])
    return c


def sub_hash(c_from, c_to, start, length) -> np.ndarray:
    _, b = powers(int(np.max(start, initial=0)) + 1)
    with np.errstate(over="ignore"):
        return mix((c_to - c_from) * b[start] + np.asarray(length).astype(np.uint64))


def hash_of(s: str) -> np.uint64:
    cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    c = prefix_hashes(cp)
    return sub_hash(c[:1], c[-1:], np.zeros(1, np.int64), np.array([len(cp)]))[0]


def viterbi(m: Pieces, cp: np.ndarray) -> list[list[int]]:
    """Best-scored segmentation of each row of ``cp`` (words, length) as piece ids; -1 - code point where a character
    is in no piece."""
    words, n = cp.shape
    c = prefix_hashes(cp)
    best = np.full((words, n + 1), -np.inf)
    best[:, 0] = 0
    back, pick = np.zeros((words, n + 1), np.int64), np.full((words, n + 1), -1, np.int64)
    unknown = m.low - 10
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - m.longest), end)
        ids = m.find(sub_hash(c[:, starts], c[:, [end]], starts[None], end - starts[None]))
        gain = np.where(ids >= 0, m.score[ids], -np.inf)
        lone = ids[:, -1] < 0
        gain[lone, -1] = unknown
        total = best[:, starts] + gain
        k = total.argmax(1)
        rows = np.arange(words)
        best[:, end], back[:, end], pick[:, end] = total[rows, k], starts[k], ids[rows, k]
    out = []
    for w in range(words):
        ids, at = [], n
        while at:
            ids.append(int(pick[w, at]) if pick[w, at] >= 0 else -1 - int(cp[w, at - 1]))
            at = int(back[w, at])
        out.append(ids[::-1])
    return out


def merges(m: Pieces, cp: np.ndarray) -> list[list[int]]:
    """BPE of each row of ``cp``: joins the best-scored neighbours, the leftmost of equals, until none is a piece."""
    words, n = cp.shape
    c = prefix_hashes(cp)
    bounds = np.tile(np.arange(n + 1), (words, 1))  # of symbols; unused places repeat n
    size = np.full(words, n)
    live = np.arange(words)

    def joined(rows, i):
        """Score of joining symbols i and i + 1 of a row, -inf if that is no piece."""
        s, e = bounds[rows, i], bounds[rows, np.minimum(i + 2, n)]
        ids = m.find(sub_hash(c[rows, s], c[rows, e], s, e - s))
        return np.where((ids >= 0) & (i + 2 <= size[rows]), m.score[ids], -np.inf)

    gain = np.full((words, max(n - 1, 1)), -np.inf)
    for i in range(n - 1):
        gain[:, i] = joined(live, np.full(words, i))
    while len(live) and n > 1:
        k = gain[live].argmax(1)
        live = live[gain[live, k] > -np.inf]
        k = gain[live].argmax(1)
        if not len(live):
            break
        # symbol k + 1 goes: what is right of it moves left
        place = np.arange(n + 1)[None]
        bounds[live] = bounds[live[:, None], np.minimum(place + (place > k[:, None]), n)]
        size[live] -= 1
        place = np.arange(n - 1)[None]
        gain[live] = np.where(place < n - 2 + (place < k[:, None]), gain[live[:, None], np.minimum(place + (place > k[:, None]), n - 2)], -np.inf)
        last = size[live] - 1
        gain[live[:, None], np.maximum(last, 0)[:, None]] = -np.inf if n > 1 else 0
        ok = k < last
        gain[live[ok], k[ok]] = joined(live[ok], k[ok])
        gain[live[~ok], k[~ok]] = -np.inf
        ok = k > 0
        gain[live[ok], k[ok] - 1] = joined(live[ok], k[ok] - 1)
    out = []
    w, j = np.nonzero(np.arange(n)[None] < size[:, None])
    s, e = bounds[w, j], bounds[w, j + 1]
    ids = m.find(sub_hash(c[w, s], c[w, e], s, e - s))
    ids = np.where(ids >= 0, ids, -1 - cp[w, s].astype(np.int64))
    cut = np.searchsorted(w, np.arange(words + 1))
    flat = ids.tolist()
    for a, b in zip(cut, cut[1:]):
        out.append(flat[a:b])
    return out


class Encoder:
    """Encodes chunks of documents; a worker keeps the ids of at most ``most`` distinct words."""

    def __init__(self, m: Pieces, most: int = 500_000):
        if m.model not in ("unigram", "bpe"):
            raise ValueError("only unigram and BPE models are supported")
        self.m, self.most, self.memo = m, most, {}
        self.best = viterbi if m.model == "unigram" else merges

    def finish(self, ids: list[int]) -> list[int]:
        """Characters in no piece as bytes, or as one unknown id for a run of them."""
        if min(ids, default=0) >= 0:
            return ids
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.m.byte_fallback:
                out.extend(self.m.bytes[b] for b in chr(-1 - i).encode("utf-8", "replace"))
            elif not out or out[-1] != self.m.unknown:
                out.append(self.m.unknown)
        return [int(i) for i in out]

    def escape(self, text: str) -> str:
        if self.m.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (MARK if self.m.prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and where each begins (and the end)."""
        escaped = [self.escape(t) for t in texts]
        cp = np.frombuffer("".join(escaped).encode("utf-32-le", "replace"), np.uint32)
        bounds = np.append(0, np.cumsum([len(t) for t in escaped]))
        n = len(cp)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        mark = cp == ord(MARK)
        new = mark.copy()
        new[1:] &= ~mark[:-1]
        new[bounds[:-1][bounds[:-1] < n]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        c = prefix_hashes(cp)
        h = sub_hash(c[starts], c[ends], starts, ends - starts)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.memo) > self.most:
            self.memo = {}
        keys = uniq.tolist()
        fresh = np.array([i for i, k in enumerate(keys) if k not in self.memo], np.int64)
        if len(fresh):
            s, length = starts[first[fresh]], (ends - starts)[first[fresh]]
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                step = max(1, (1 << 18) // int(size))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    for i, ids in zip(fresh[some].tolist(), self.best(self.m, cp[s[some][:, None] + np.arange(size)[None]])):
                        self.memo[keys[i]] = np.array(self.finish(ids), np.int32)
        got = [self.memo[k] for k in keys]
        lens = np.array([len(x) for x in got], np.int64)
        offs = np.append(0, np.cumsum(lens))
        flat = np.concatenate(got)
        upto = np.append(0, np.cumsum(lens[inverse]))
        ids = flat[np.arange(upto[-1]) + np.repeat(offs[inverse] - upto[:-1], lens[inverse])]
        return ids, upto[np.searchsorted(starts, bounds)]


def decode(m: Pieces, ids) -> str:
    """The text of piece ids."""
    out, raw = [], bytearray()
    for i in ids:
        if m.kinds[i] == BYTE:
            raw.append(int(m.pieces[i][3:5], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        if m.kinds[i] == UNKNOWN:
            out.append(" ⁇ ")
        elif m.kinds[i] != CONTROL:
            out.append(m.pieces[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out)
    if m.prefix and text.startswith(MARK):
        text = text[1:]
    return text.replace(MARK, " ")


def _default_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) per row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        coder = Encoder(Pieces.load(_default_path(path)))
        for part in slices(batches):
            ids, at = coder.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids)."""

    def run(batches):
        m = Pieces.load(_default_path(path))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([decode(m, x or ()) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's ids and a checksum of what they decode to, both from one pass."""
    prepare(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        import zlib

        m = Pieces.load(_default_path(None))
        coder = Encoder(m)
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, at = coder.encode(texts)
            out = []
            for doc, t, lo, hi in zip(part.column(0).to_pylist(), texts, at[:-1].tolist(), at[1:].tolist()):
                own = ids[lo:hi]
                back = decode(m, own.tolist())
                out.append((doc, hi - lo, zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(back.encode("utf-8", "replace")), back == t))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean")
