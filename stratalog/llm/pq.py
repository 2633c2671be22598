"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length one. A coarse quantiser splits them into inverted lists; the residual to the list's
centroid is coded by one of ``CODES`` centroids in each of ``SUBSPACES`` subspaces. For a query, a table of distances
from its residual parts to all code centroids gives the distance to every coded vector by look-ups (the query stays
exact: asymmetric). A vector's distance is at least the looked-up one minus its own coding error, which the index
keeps, so dropping those beyond loses none; the rest are ranked by exact cosine in double precision.

Probes: vectors at cosine >= c lie within e = sqrt(2 - 2c). If y is in another list than x, x is at least h =
(d(x, other)^2 - d(x, own)^2) / (2 * distance of the two centroids) away from it. So lists with h <= e suffice for
certain; and as the difference of two near vectors has no preferred direction, h <= e * min(1, z / sqrt(dimensions))
misses about one link in ten million at z = 5. ``z=None`` probes with certainty.

Equal vectors are one node. Lists are cut into blocks of ``BLOCK`` vectors, and blocks of queries meet blocks of the
index, so a list with a third of all vectors is many tasks; a task returns counts and a spanning forest of the links
it found, never the links themselves. Lists take turns: a turn ships about ``SHIPPED`` rows for each vector, however
many lists vectors probe, and its shuffle files go before the next one's.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
vectors of a dimension other than the commonest; rows with null vec_id keep a null component_id and link with nothing;
rows that repeat a vec_id count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, prepare, stored
from .textkit import mix

SUBSPACES, CODES, SAMPLE, BLOCK, PER_LIST, MOST_LISTS, Z = 8, 64, 20000, 2048, 400, 1024, 5.0
SHIPPED = 4  # rows shuffled at once, about, for each vector


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and subspace codebooks, fitted on a bounded sample of distinct vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        r = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(r[:, p], CODES) for p in self.parts]
        sq = (self.coarse**2).sum(1)
        self.apart = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * self.coarse @ self.coarse.T, 1e-12))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        own = nearest(x, self.coarse)
        r = x - self.coarse[own]
        codes = np.stack([nearest(r[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        made = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return own, codes, np.sqrt(((r[:, np.concatenate(self.parts)] - made) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, cosine: float, z: float | None) -> list[np.ndarray]:
        e = np.sqrt(2 - 2 * cosine) * (1 if z is None else min(1.0, z / np.sqrt(self.dim)))
        d = np.maximum((x * x).sum(1)[:, None] + (self.coarse**2).sum(1)[None] - 2 * x @ self.coarse.T, 0)
        h = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.apart[own])
        near = h <= e + 1e-9
        near[np.arange(len(x)), own] = True
        return [np.flatnonzero(row) for row in near]

    def table(self, x: np.ndarray, which: int) -> list[np.ndarray]:
        """Squared distances (queries, codes) of each part of the queries' residuals to list ``which``."""
        r = x - self.coarse[which]
        return [((r[:, p] ** 2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * r[:, p] @ b.T) for p, b in zip(self.parts, self.books)]


def _arrays(col) -> tuple[list[np.ndarray], np.ndarray]:
    """Vectors of a list column, and which can be compared."""
    out, ok = [], np.zeros(len(col), bool)
    for i, v in enumerate(col):
        a = np.zeros(0)
        if v.is_valid:
            values = v.values
            if not values.null_count:
                a = values.to_numpy(zero_copy_only=False).astype(np.float64)
        ok[i] = len(a) > 0 and np.isfinite(a).all() and 0 < np.linalg.norm(a) < np.inf
        out.append(a)
    return out, ok


def units(table: DataFrame) -> DataFrame:
    """(vec_id, node, dim, unit): the vector at length one; node is a hash of it, null if it can't be compared."""
    schema = pa.schema([("vec_id", pa.int64()), ("node", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary())])

    def run(batches):
        for b in batches:
            vectors, ok = _arrays(b.column(1))
            out = []
            for good, v in zip(ok.tolist(), vectors):
                if not good:
                    out.append((None, None, None))
                    continue
                v = v / np.abs(v).max()
                raw = (v / np.linalg.norm(v)).tobytes()
                with np.errstate(over="ignore"):
                    bits = np.frombuffer(raw, np.uint64)
                    h = mix(np.array([mix(bits + mix(np.arange(len(bits), dtype=np.uint64))).sum()], np.uint64)).view(np.int64)[0]
                out.append((int(h), len(v), raw))
            node, dim, unit = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], schema=schema)

    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, node long, dim int, unit binary")


def near_vectors(spark: SparkSession, table: DataFrame, cosine: float = 0.95, z: float | None = Z) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept."""
    prepare(spark)
    rows = stored(spark, units(table), "units")
    usual = rows.where("node is not null and vec_id is not null").groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    fit = (F.col("node").isNotNull() & F.col("vec_id").isNotNull()) & (F.col("dim") == dim)
    nodes = stored(spark, rows.where(fit).groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "vectors")
    n = nodes.count()
    sample = [np.frombuffer(r[0], np.float64) for r in nodes.orderBy(F.xxhash64("node")).select("unit").limit(SAMPLE).collect()]
    if not sample:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = Index(np.stack(sample), min(MOST_LISTS, max(1, n // PER_LIST)))
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS and CODES bound it

    def posts(chosen: np.ndarray | None = None):
        """Index entries (q = false) in the own list, queries (q = true) in every probed list, in those of the lists
        that are chosen; without such only where they are."""
        names = ["list", "q", "node", "copies", "own", "unit", "codes", "error", "probes"]

        def post(batches):
            ix = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                node, copies = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, dim)
                own, codes, error = ix.encode(x)
                probes = ix.probes(x, own, cosine, z)
                for at in range(0, len(node), 500):
                    s = slice(at, at + 500)
                    width = [len(p) for p in probes[s]]
                    rep = np.repeat(np.arange(at, at + len(width)), width)
                    k = np.append(np.arange(at, at + len(width)), rep)
                    q = np.append(np.zeros(len(width), bool), np.ones(len(rep), bool))
                    where = np.append(own[s], np.concatenate(probes[s]))
                    if chosen is None:
                        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(q)], names[:2])
                        continue
                    some = chosen[where]
                    k, q, where = k[some], q[some], where[some]
                    mine = list(zip(k.tolist(), q.tolist()))  # what only the index side needs is null for queries
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where.astype(np.int32)), pa.array(q), pa.array(node[k]), pa.array(copies[k]), pa.array(own[k].astype(np.int32)), pa.array([x[i].tobytes() for i in k], pa.binary()), pa.array([None if ask else codes[i].tobytes() for i, ask in mine], pa.binary()), pa.array(error[k], mask=q), pa.array([None if ask else probes[i].astype(np.int32) for i, ask in mine], pa.list_(pa.int32()))],
                        names,
                    )

        fields = "list int, q boolean, node long, copies long, own int, unit binary, codes binary, error double, probes array<int>"
        return nodes.select("node", "copies", "unit").mapInArrow(post, "list int, q boolean" if chosen is None else fields)

    asks, has = F.sum(F.col("q").cast("int")), F.sum((~F.col("q")).cast("int"))
    sizes = posts().groupBy("list").agg(F.ceil(has / BLOCK).cast("int").alias("ib"), F.ceil(asks / BLOCK).cast("int").alias("qb"), asks.alias("asks"), has.alias("has"))
    sizes = F.broadcast(stored(spark, sizes, "lists"))  # a row for each of at most MOST_LISTS lists
    which, rows_of = [], []
    for r in sizes.orderBy("list").collect():
        which.append(r["list"])
        rows_of.append(r["asks"] * max(1, r["ib"]) + r["has"] * max(1, r["qb"]))
    turn = (np.cumsum(rows_of) - np.array(rows_of)) // (SHIPPED * n)
    turns = [[r for r, t in zip(which, turn.tolist()) if t == at] for at in np.unique(turn).tolist()]
    limit = np.sqrt(2 - 2 * cosine)

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ix, which = shared.value, int(key[0])
        ask, has = pdf[pdf.q], pdf[~pdf.q]
        if not len(ask) or not len(has):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "int64", "n": "int64"})
        xq, xi = (np.frombuffer(b"".join(t.unit), np.float64).reshape(-1, dim) for t in (ask, has))
        codes = np.frombuffer(b"".join(has.codes), np.uint8).reshape(len(has), -1)
        far = (limit + has.error.to_numpy() + 1e-9) ** 2
        qn, inn = ask.node.to_numpy(), has.node.to_numpy()
        q_own, q_copies, i_copies = ask.own.to_numpy(), ask.copies.to_numpy(), has.copies.to_numpy()
        count_q, count_i = np.zeros(len(ask), np.int64), np.zeros(len(has), np.int64)
        parent = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        lookup: list[set] = [set(p.tolist()) for p in has.probes]
        for at in range(0, len(ask), 256):
            x = xq[at : at + 256]
            tables = ix.table(x, which)
            d = np.zeros((len(x), len(has)), np.float32)
            for i, t in enumerate(tables):
                d += t.astype(np.float32)[:, codes[:, i]]
            qi, ii = np.nonzero(d <= far[None] + 1e-5)
            for part in range(0, len(qi), 1 << 16):
                a, b = qi[part : part + (1 << 16)], ii[part : part + (1 << 16)]
                good = ((x[a] * xi[b]).sum(1) >= cosine) & (qn[at + a] != inn[b])
                a, b = a[good] + at, b[good]
                np.add.at(count_q, a, i_copies[b])
                # the pair is counted for the index side here only if it doesn't come as a query to the other's list
                back = np.array([q_own[i] not in lookup[j] for i, j in zip(a.tolist(), b.tolist())], bool)
                np.add.at(count_i, b[back], q_copies[a[back]])
                for u, v in zip(qn[a].tolist(), inn[b].tolist()):
                    ru, rv = find(u), find(v)
                    if ru != rv:
                        parent[max(ru, rv)] = min(ru, rv)
        linked = [(v, find(v)) for v in parent]
        a = np.concatenate([qn, inn, np.array([v for v, r in linked if v != r], np.int64)])
        b = np.concatenate([qn, inn, np.array([r for v, r in linked if v != r], np.int64)])
        n = np.concatenate([count_q, count_i, np.zeros(len(a) - len(qn) - len(inn), np.int64)])
        some = (n > 0) | (a != b)
        return pd.DataFrame({"a": a[some], "b": b[some], "n": n[some]})

    mine = F.pmod(F.xxhash64("node"), F.when(F.col("q"), F.col("qb")).otherwise(F.greatest(F.col("ib"), F.lit(1)))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.when(F.col("q"), F.col("ib")).otherwise(F.col("qb")), F.lit(1)) - 1))
    found = []
    for lists in turns:
        chosen = np.isin(np.arange(len(index.coarse)), lists)
        met = posts(chosen).join(sizes, "list").withColumn("mine", mine).withColumn("other", other)
        met = met.select("list", F.when(F.col("q"), F.col("mine")).otherwise(F.col("other")).alias("qi"), F.when(F.col("q"), F.col("other")).otherwise(F.col("mine")).alias("ii"), "q", "node", "copies", "own", "unit", "codes", "error", "probes")
        found.append(stored(spark, met.groupBy("list", "qi", "ii").applyInPandas(meet, "a long, b long, n long"), "links"))
    links = reduce(DataFrame.unionByName, found)
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(spark, links)
    whole = nodes.join(parts, "node", "left").join(counts, "node", "left").select("node", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("part"))
    least = whole.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "part").select("node", "n_links", "component_id")
    out = rows.withColumn("node", F.when(fit, F.col("node"))).join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
