"""Packing of token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids (tokenizer ids, then one end id) are cut at multiples of the sequence length; whole pieces fill a
sequence each and the rest is placed first-fit decreasing. Groups are drawn at random from row and task position, so
copies of one document, or one id on a third of the rows, spread evenly; each holds ``per_group`` documents on average,
which bounds the memory of a task. No ids are shuffled: a piece's checksum is taken where the text is encoded.

Defined results: null text counts as empty and gives the end id alone; rows with null or repeated doc_id are packed
as documents of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare
from .pretoken import ByteBpe
from .textkit import buffers, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """First open bin with room for a size: a complete binary tree over bins whose inner nodes hold the most room."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)
        self.capacity = capacity

    def place(self, need: int) -> tuple[int, int]:
        """Bin for ``need`` and the offset there; bins never used have full room, so first fit opens them in order."""
        room, at = self.room, 1
        if room[1] < need:
            raise ValueError("no bin has room")
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= need
        leaf, at = at, at // 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return leaf - self.size, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity); ties keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = TournamentTree(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], offsets[i] = tree.place(int(lengths[i]))
    return bins, offsets


def encode_pieces(docs: DataFrame, encoder, capacity: int = 1024, end_id: int = 0, groups: int = 1, seed: int = 7) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, grp): ``encoder()`` makes, on the worker, an object whose
    ``encode(bytes, offsets)`` gives the ids of a chunk of documents and where each begins. ``grp`` is drawn from a
    hash of id, checksum and the row's place in its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("grp", pa.int64())])

    def run(batches):
        coder, row = encoder(), 0
        for part in slices(batches, most=2 << 20):
            ids, at = coder.encode(*buffers(part.column(1)))
            out = []
            for doc, lo, hi in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                tokens = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4", copy=False)
                raw, n = tokens.tobytes(), hi - lo + 1
                crc = zlib.crc32(raw)
                grp = zlib.crc32(f"{seed}:{doc}:{crc}:{row}".encode()) % groups
                row += 1
                if n <= capacity:
                    out.append((doc, 0, n, crc, n, grp))
                else:
                    out.extend((doc, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), n, grp) for s in range(0, n, capacity))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            del ids, at, out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """First-fit decreasing within each ``grp``: adds sequence_id (unique over all groups) and offset."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins + (int(key[0]) << 32)
        pdf["offset"] = offsets
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return pieces.groupBy("grp").applyInPandas(run, PIECES)


def byte_bpe(path: str | None = None):
    """Encoder for :func:`encode_pieces`: the ids that the tokenizers library gives for the vocabulary file."""

    def make():
        import public_tokenizers

        return ByteBpe(path or public_tokenizers.path("byte_bpe_50k.json"))

    return make


def op5_packing(spark: SparkSession, sf_dir: str, per_group: int = 4096) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    groups = max(1, -(-docs.count() // per_group))
    return pack(encode_pieces(docs, byte_bpe(), groups=groups))
