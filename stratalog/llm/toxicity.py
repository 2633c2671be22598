"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters, lower-cased; a sequence is a line or sentence, cut at ``LONGEST`` tokens. States are
ordinary and toxic; a token's features are itself, its prefixes, its suffix and its length, hashed. Labels mark whole
documents, so tokens are labelled from them first: in a toxic document those with a feature that marks toxic
documents beyond chance; copies of a document count once. The field is fitted by gradient ascent on the conditional likelihood with forward-backward
marginals. Scoring runs forward-backward over every sequence of every text; a document's score is a
logistic function of the log-odds of its likelier distinct tokens, and runs of tokens above one half are its offending
spans.

The fit reads a bounded sample: ``PER_CLASS`` toxic and four times as many clean labelled documents, those with the least
hash of their id.

Defined results: null or letterless text scores 0; labels that are null are ignored, of several for one id the
greatest counts; rows with null or repeated doc_id are scored each by its text; without toxic rows to learn from all
score 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, documents, prepare
from .textkit import buffers, slices, windows
from .wordscan import LetterWords

PER_CLASS, BUCKETS, LONGEST, THRESHOLD = 500, 1 << 18, 64, 0.7
PREFIXES, SUFFIX = (3, 4, 5, 6), 4
N_FEATURES = len(PREFIXES) + 3


def features(w: LetterWords) -> np.ndarray:
    """(tokens, N_FEATURES) buckets; bucket 0 stands for a prefix or suffix that would be the whole token."""
    s, e = w.starts, w.ends
    length = e - s
    out = np.zeros((len(s), N_FEATURES), np.int32)

    def put(i, a, b, use):
        x = w.span(a, b) + np.uint64(i * 0x9E3779B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = np.where(use, 1 + (x >> np.uint64(32)) % np.uint64(BUCKETS - 1), 0)

    with np.errstate(over="ignore"):
        put(0, s, e, True)
        for i, k in enumerate(PREFIXES):
            put(1 + i, s, np.minimum(s + k, e), length > k)
        put(N_FEATURES - 2, np.maximum(e - SUFFIX, s), e, length > SUFFIX)
        out[:, N_FEATURES - 1] = 1 + (np.minimum(length, 20).astype(np.int64) * 7919 + 13) % (BUCKETS - 1)
    return out


def sequences(w: LetterWords) -> np.ndarray:
    """Where each sequence begins (and the end): new document, a newline or ``.!?`` before the token, or LONGEST."""
    n = len(w.starts)
    if not n:
        return np.zeros(1, np.int64)
    stop = np.isin(w.cp, np.array([10, 33, 46, 63, 0x3002], np.uint32))
    upto = np.append(0, np.cumsum(stop))
    new = np.ones(n, bool)
    new[1:] = upto[w.starts[1:]] > upto[w.ends[:-1]]
    heads = w.first[:-1]
    new[heads[heads < n]] = True
    at = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return np.append(np.flatnonzero(place % LONGEST == 0), n)


def forward_backward(u: np.ndarray, at: np.ndarray, trans: np.ndarray, gold: np.ndarray | None = None):
    """Marginals of the toxic state for tokens with scores ``u`` (toxic minus ordinary) in sequences ``at``.

    ``trans[a, b]`` is the log-potential of a step from a to b. All sequences advance together, the longest first.
    Also the expected steps (2, 2), with ``gold`` labels the observed ones too."""
    order = np.argsort(-np.diff(at), kind="stable")
    base, lens = at[:-1][order], np.diff(at)[order]
    longest = int(lens[0]) if len(lens) else 0
    alive = len(lens) - np.searchsorted(lens[::-1], np.arange(1, longest + 1), "left")
    e = np.exp(np.clip(u, -30, 30))
    T = np.exp(trans)
    alpha, beta = np.zeros((len(u), 2)), np.ones((len(u), 2))
    for t, n in enumerate(alive):
        rows = base[:n] + t
        x = np.ones((n, 2)) if not t else alpha[rows - 1] @ T
        x[:, 1] *= e[rows]
        alpha[rows] = x / x.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        rows = base[:n] + t
        x = beta[rows + 1].copy()
        x[:, 1] *= e[rows + 1]
        x = x @ T.T
        beta[rows] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    p = p[:, 1] / p.sum(1)
    steps = None
    if gold is not None:
        inner = np.ones(len(u), bool)
        inner[at[1:] - 1] = False
        i = np.flatnonzero(inner)
        nxt = beta[i + 1].copy()
        nxt[:, 1] *= e[i + 1]
        joint = alpha[i][:, :, None] * T[None] * nxt[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        seen = np.bincount(2 * gold[i] + gold[i + 1], minlength=4).reshape(2, 2)
        steps = (joint.sum(0), seen)
    return p, steps


class Crf:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, doc_weights: np.ndarray):
        self.weights, self.trans, self.doc_weights = weights.astype(np.float32), trans, doc_weights

    def marginals(self, w: LetterWords) -> np.ndarray:
        if not len(w.starts):
            return np.zeros(0)
        x = features(w)
        u = np.zeros(len(x), np.float32)
        for i in range(N_FEATURES):
            u += self.weights[x[:, i]]
        return forward_backward(u.astype(np.float64), sequences(w), self.trans)[0]


def token_labels(x: np.ndarray, doc: np.ndarray, toxic: np.ndarray, evidence: float = 11.0) -> np.ndarray:
    """Tokens of toxic documents with a feature that marks toxic documents: it is at least five times as frequent
    there, by documents, and the log-likelihood ratio against chance is at least ``evidence``."""
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    pos, neg = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i in range(N_FEATURES - 1):
        pairs = np.unique(doc.astype(np.int64) * BUCKETS + x[:, i])
        d, f = pairs // BUCKETS, pairs % BUCKETS
        pos += np.bincount(f[toxic[d]], minlength=BUCKETS)
        neg += np.bincount(f[~toxic[d]], minlength=BUCKETS)
    base, both = n_pos / (n_pos + n_neg), np.maximum(pos + neg, 1)
    ratio = pos * np.log(np.maximum(pos / both, 1e-9) / base) + neg * np.log(np.maximum(neg / both, 1e-9) / (1 - base))
    strong = (pos * n_neg >= 5 * neg * n_pos) & (ratio >= evidence)
    strong[0] = False
    return (strong[x[:, : N_FEATURES - 1]].any(1) & toxic[doc]).astype(np.int64)


def originals(h: np.ndarray, first: np.ndarray, seen: set) -> np.ndarray:
    """Documents that share none of three MinHash values of their word pairs with an earlier one (``seen`` gets the
    values): copies of one document aren't separate evidence."""
    x, at = windows(h, first, 2)
    bounds = np.append(0, np.cumsum(np.maximum(np.diff(first) - 1, 0)))
    keep = np.ones(len(first) - 1, bool)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            low = np.stack([np.minimum.reduceat(x * np.uint64(k), bounds[full]) for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], 1)
        for d, own in zip(full.tolist(), low.tolist()):
            own = set(enumerate(own))
            keep[d] = not own & seen
            seen |= own
    return keep


def evidence(doc: np.ndarray, word: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """(documents, 2): the log-odds of a document's likelier tokens, each distinct word once, summed; and the greatest
    log-odds of any token (of none: -12)."""
    odds = np.log(np.clip(p, 1e-6, 1 - 1e-4) / (1 - np.clip(p, 1e-6, 1 - 1e-4)))
    top = np.full(n, -12.0)
    np.maximum.at(top, doc, odds)
    some = np.flatnonzero(odds > -2)
    order = some[np.lexsort((-odds[some], word[some], doc[some]))]
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])
    order = order[first]
    return np.stack([np.bincount(doc[order], odds[order] + 2, n), top], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the slopes can't be negative."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    free = np.ones(len(w), bool)
    for _ in range(3):
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (y - q) - ridge * w * np.append(np.ones(len(w) - 1), 0)
            hess = (z * (q * (1 - q))[:, None]).T @ z + np.diag(np.append(np.full(len(w) - 1, ridge), 1e-6))
            w[free] += np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        low = (w < 0) & np.append(np.ones(len(w) - 1, bool), False)
        if not low.any():
            break
        free &= ~low
        w[low] = 0
    return w


def fit_chain(x: np.ndarray, doc: np.ndarray, at: np.ndarray, toxic: np.ndarray, epochs: int = 40, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the steps."""
    y = token_labels(x, doc, toxic)
    # every sequence with a toxic token, and those of clean documents, at least 20000 if there are
    has = np.add.reduceat(y, at[:-1]) > 0
    clean = np.flatnonzero(~toxic[doc[at[:-1]]])
    take = clean[np.unique(np.linspace(0, len(clean) - 1, min(len(clean), max(20000, 4 * int(has.sum())))).astype(int))] if len(clean) else clean
    seqs = np.sort(np.append(np.flatnonzero(has), take))
    lens = np.diff(at)[seqs]
    new_at = np.append(0, np.cumsum(lens))
    rows = np.arange(new_at[-1]) + np.repeat(at[:-1][seqs] - new_at[:-1], lens)
    x, y = x[rows], y[rows]
    weights, trans = np.zeros(BUCKETS), np.zeros((2, 2))
    g2, t2 = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(epochs):
        u = np.zeros(len(x))
        for i in range(N_FEATURES):
            u += weights[x[:, i]]
        p, (expected, seen) = forward_backward(u, new_at, trans, y)
        grad = -l2 * len(y) * weights / 100
        for i in range(N_FEATURES):
            grad += np.bincount(x[:, i], y - p, BUCKETS)
        grad[0] = 0
        g2 += grad**2
        weights += rate * grad / np.sqrt(g2)
        step = (seen - expected) - 0.1 * trans
        t2 += step**2
        trans += rate * step / np.sqrt(t2)
    return weights, trans


def fit(texts: pa.Array, toxic: np.ndarray) -> Crf | None:
    """The field, fitted on all documents, and the weights of a document's evidence, fitted on marginals that each
    half of the documents got from a field fitted on the other."""
    xs, ats, docs, words, kept = [], [], [], [], []
    n = d0 = 0
    known: set = set()
    for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], most=1 << 20):
        w = LetterWords(*buffers(part.column(0)))
        h = w.span(w.starts, w.ends)
        keep = originals(h, w.first, known)
        doc = np.repeat(np.arange(part.num_rows), w.counts())
        at = sequences(w)
        whole = keep[doc[at[:-1]]] if len(doc) else np.zeros(0, bool)
        lens = np.diff(at)[whole]
        own = keep[doc]
        xs.append(features(w)[own])
        ats.append(np.append(0, np.cumsum(lens))[:-1] + n)
        docs.append((np.cumsum(keep) - 1)[doc[own]] + d0)
        words.append(h[own])
        kept.append(keep)
        n += int(own.sum())
        d0 += int(keep.sum())
    toxic = toxic[np.concatenate(kept)] if kept else toxic
    if not n or not toxic.any():
        return None
    x, doc, at, word = np.concatenate(xs), np.concatenate(docs), np.append(np.concatenate(ats), n), np.concatenate(words)
    del xs, docs, words
    seen = np.zeros((len(toxic), 2))
    for half in (0, 1):
        own = (doc % 2) != half
        seqs = np.flatnonzero(own[at[:-1]])
        lens = np.diff(at)[seqs]
        weights, trans = fit_chain(x[own], doc[own], np.append(0, np.cumsum(lens)), toxic, epochs=25)
        rest = ~own
        lens = np.diff(at)[~own[at[:-1]]]
        u = sum(weights[x[rest][:, i]] for i in range(N_FEATURES))
        p, _ = forward_backward(u, np.append(0, np.cumsum(lens)), trans)
        seen[half::2] = evidence(doc[rest], word[rest], p, len(toxic))[half::2]
    return Crf(*fit_chain(x, doc, at, toxic), logistic(seen, toxic.astype(float)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Crf | None:
    """``labels``: doc_id, toxic of the rows that may be learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [known.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(n) for k, n in ((1, per_class), (0, 4 * per_class))]
    ids = F.broadcast(pick[0].unionByName(pick[1]))  # at most 5 * per_class ids
    got = docs.select("doc_id", "text").join(ids, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates().orderBy(F.xxhash64("text")).toArrow().combine_chunks()
    if not got.num_rows:
        return None
    return fit(got["text"].combine_chunks(), got["toxic"].to_numpy() == 1)


def tag(spark: SparkSession, docs: DataFrame, model: Crf | None, column: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """``docs`` (all its columns) with a score and spans, array<struct<start, end, p>> in code points of the text, under
    names that ``docs`` must not have itself."""
    prepare(spark)
    if model is None:
        return docs.withColumn(score, F.lit(0.0)).withColumn(spans, F.expr("cast(array() as array<struct<start:int,end:int,p:double>>)"))
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    place = docs.columns.index(column)

    def run(batches):
        m = shared.value
        for part in slices(batches, column):
            w = LetterWords(*buffers(part.column(place)))
            n = part.num_rows
            p = m.marginals(w)
            doc = np.repeat(np.arange(n), w.counts())
            seen = evidence(doc, w.span(w.starts, w.ends), p, n)
            scores = np.where(w.counts() > 0, 1 / (1 + np.exp(-np.clip(np.column_stack([seen, np.ones(n)]) @ m.doc_weights, -30, 30))), 0.0)
            found = [[] for _ in range(n)]
            hit = np.flatnonzero(p >= 0.5)
            for i, d in zip(hit.tolist(), doc[hit].tolist()):
                own, head = found[d], int(w.bounds[d])
                s, e = int(w.starts[i]) - head, int(w.ends[i]) - head
                if own and own[-1]["last"] == i - 1:
                    own[-1] |= {"end": e, "p": max(own[-1]["p"], float(p[i])), "last": i}
                else:
                    own.append({"start": s, "end": e, "p": float(p[i]), "last": i})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array([[{k: x[k] for k in ("start", "end", "p")} for x in own] for own in found], kind)], names=[*part.schema.names, score, spans])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{score}` double, `{spans}` array<struct<start:int,end:int,p:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))
    model = train(docs, documents(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic"))
    out = tag(spark, docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))
