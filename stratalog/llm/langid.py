"""Language of whole texts: script ranges narrow the candidates, Viterbi labels the words.

A word (a run of letters) scores each language by smoothed log-probabilities of its letter trigrams; languages that
hardly use the word's script are ruled out for it. Viterbi over a document's words, with a penalty for each change of
language, gives spans; the language with most letters is the document's, its share of them the score.

The model is fitted on ``PER_LANG`` documents of each of the ``LANGS`` most frequent languages, those with the least
hash of their id: a bounded sample, read from text and lang alone.

Defined results: null text, or one without a letter, is ``und`` with score 0; rows with null lang don't train; rows
with null or repeated doc_id are judged each by its text; without any row to learn from everything is ``und``; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, documents, prepare
from .textkit import buffers, slices
from .wordscan import LetterWords

PER_LANG, LANGS, BUCKETS, SWITCH, ALPHA = 500, 128, 1 << 16, 8.0, 0.2
#: First code points of script ranges; the range before the first is Latin and its neighbours.
_EDGES = np.array([0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C80, 0x3040, 0x30A0, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFF66, 0x10000, 0x20000], np.uint32)
_SCRIPT = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 0, 1, 18, 19, 20, 20, 21, 22, 23, 16, 24, 22, 0, 20, 25, 22], np.int64)
N_SCRIPTS = 26


def trigrams(w: LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter (a word's ends are marked), and where each word's begin."""
    at = np.flatnonzero(w.letter)
    c = w.cp.astype(np.uint64)
    left = np.zeros(len(at), np.uint64)
    right = np.zeros(len(at), np.uint64)
    lengths = w.ends - w.starts
    upto = np.append(0, np.cumsum(lengths))
    inner = np.ones(len(at), bool)
    inner[upto[:-1]] = False
    left[inner] = c[at[inner] - 1]
    inner[:] = True
    inner[upto[1:] - 1] = False
    right[inner] = c[at[inner] + 1]
    with np.errstate(over="ignore"):
        x = (left * np.uint64(0x9E3779B97F4A7C15) + c[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + right
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(48)).astype(np.int64), upto[:-1]


def scripts(w: LetterWords) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_EDGES, w.cp[w.starts], "right")]


class Model:
    """Log-probabilities (languages, BUCKETS) and which languages each script allows."""

    def __init__(self, langs: list[str], grams: np.ndarray, by_script: np.ndarray):
        self.langs = langs
        if langs:
            self.logp = np.log((grams + ALPHA) / (grams.sum(1, keepdims=True) + ALPHA * BUCKETS)).astype(np.float32)
            share = by_script / np.maximum(by_script.sum(1, keepdims=True), 1)
            ok = share.T >= 0.01
            self.allowed = ok | ~ok.any(1, keepdims=True)

    def words(self, w: LetterWords) -> np.ndarray:
        """(words, languages) scores."""
        bucket, at = trigrams(w)
        out = np.stack([np.add.reduceat(p[bucket], at) if len(at) else np.zeros(0, np.float32) for p in self.logp], 1)
        out[~self.allowed[scripts(w)]] -= 1e3
        return out

    def labels(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best language of each word; all documents advance together, the longest first."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        base, lens = first[:-1][order], counts[order]
        alive = len(lens) - np.searchsorted(lens[::-1], np.arange(1, (lens[0] if len(lens) else 0) + 1), "left")
        back = np.zeros(scores.shape, np.uint8)
        own = np.arange(scores.shape[1], dtype=np.uint8)
        v = np.zeros((len(lens), scores.shape[1]), np.float32)
        for t, n in enumerate(alive):
            rows = base[:n] + t
            x = v[:n]
            best = x.argmax(1)
            top = x[np.arange(n), best][:, None] - np.float32(SWITCH if t else 0)
            move = x < top
            back[rows] = np.where(move, best[:, None].astype(np.uint8), own)
            v[:n] = np.where(move, top, x) + scores[rows]
        out = np.zeros(len(scores), np.uint8)
        state = v.argmax(1).astype(np.uint8)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            rows = base[:n] + t
            out[rows] = state[:n]
            state[:n] = back[rows, state[:n]]
        return out


def train(docs: DataFrame, per_lang: int = PER_LANG, most: int = LANGS) -> Model:
    """``docs``: doc_id, text, lang of the rows that may be learnt from."""
    known = docs.where("lang is not null")
    langs = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    langs.sort()
    if not langs:
        return Model([], None, None)
    rank = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = known.where(F.col("lang").isin(langs)).select("doc_id", "lang", F.xxhash64(F.lit(11), "doc_id").alias("h")).withColumn("k", F.row_number().over(rank)).where(f"k <= {per_lang}").select("doc_id", "lang").distinct()
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"])  # at most per_lang ids a language
    place = {x: i for i, x in enumerate(langs)}

    def count(batches):
        grams, script = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), N_SCRIPTS), np.int64)
        for part in slices(batches, most=4 << 20):
            of = np.array([place[x] for x in part.column(1).to_pylist()])
            w = LetterWords(*buffers(part.column(0)))
            bucket, _ = trigrams(w)
            lengths, lang = w.ends - w.starts, of[np.repeat(np.arange(len(of)), w.counts())] if len(w.starts) else np.zeros(0, np.int64)
            grams += np.bincount(np.repeat(lang, lengths) * BUCKETS + bucket, minlength=grams.size).reshape(grams.shape)
            script += np.bincount(lang * N_SCRIPTS + scripts(w), lengths, script.size).astype(np.int64).reshape(script.shape)
        both = np.concatenate([grams, script], 1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], ["lang", "feature", "n"])

    total = np.zeros((len(langs), BUCKETS + N_SCRIPTS), np.int64)
    got = sample.select("text", "lang").mapInArrow(count, "lang long, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    total[got["lang"].to_numpy(), got["feature"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, total[:, :BUCKETS].astype(np.float64), total[:, BUCKETS:])


def identify(spark: SparkSession, docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) per row; with ``spans`` also array<struct<start, end, lang>> in code points."""
    prepare(spark)
    span = "array<struct<start:int,end:int,lang:string>>"
    shared = spark.sparkContext.broadcast(model)  # at most LANGS * BUCKETS numbers
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    schema = pa.schema(fields + ([("spans", kind)] if spans else []))

    def run(batches):
        m = shared.value
        size = max(1 << 18, (12 << 20) // max(2, len(m.langs)))
        for part in slices(batches, most=size):
            w = LetterWords(*buffers(part.column(1)))
            n, k = part.num_rows, max(1, len(m.langs))
            counts = w.counts()
            doc = np.repeat(np.arange(n), counts)
            label = m.labels(m.words(w), w.first) if m.langs and len(w.starts) else np.zeros(len(w.starts), np.uint8)
            letters = np.bincount(doc * k + label, w.ends - w.starts, n * k).reshape(n, k)
            best, total = letters.argmax(1), letters.sum(1)
            known = (total > 0) & bool(m.langs)
            cols = [part.column(0), pa.array([m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())], pa.string()), pa.array(np.where(known, letters.max(1) / np.maximum(total, 1), 0.0))]
            if spans:
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(doc))[: len(s)] - 1
                out = [[] for _ in range(n)]
                if m.langs:
                    for d, a, b, x in zip(doc[s].tolist(), (w.starts[s] - w.bounds[doc[s]]).tolist(), (w.ends[e] - w.bounds[doc[s]]).tolist(), label[s].tolist()):
                        out[d].append({"start": a, "end": b, "lang": m.langs[x]})
                cols.append(pa.array(out, kind))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double" + f", spans {span}" * spans)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(crc32_of_id() % 5 == 0, F.lit(False))
    model = train(docs.where(~held))
    return identify(spark, docs, model, spans=True).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.to_json("spans").alias("spans"))
