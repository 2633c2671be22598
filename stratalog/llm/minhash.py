"""Near-duplicates by word shingles: a multi-index Hamming join over MinHash signatures, confirmed on full sets.

A signature has ``chunks`` * ``width`` symbols of 16 bits, one per MinHash function. Two signatures that differ in at
most ``(errors + 1) * chunks - 1`` symbols have, by the pigeonhole principle, a chunk with at most ``errors`` differing
symbols; every chunk is indexed under all keys that leave out ``errors`` of its symbols, so such pairs share a key for
certain (19 of 50 symbols by default; sets of similarity 0.8 differ in 10 on average, and a pair beyond 19 is still
found unless each of the ten chunks has two errors, which at 0.8 happens to fewer than two pairs in a million).

No bucket is expanded into pairs. Equal sets are one node. Each bucket links its members to its least one (a star);
links confirmed on full sets give components. Nodes that share a bucket, are not its hub and are still in different
components are open; any link not found yet is between two of those. They meet once more where they share one of their
rarest shingles, which similar sets must (:func:`sharing_rare`), so what many texts have in common (a license, a
template) makes no pairs. A link inside a component can't change the result, so none is lost.

Defined results: null or wordless text has an empty set, links with nothing and is kept; a row with null doc_id has a
null component and is kept; rows that repeat a doc_id are compared by their own texts; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, documents, prepare, stored
from .textkit import Words, buffers, mix, slices, sorted_unique, windows

CHUNKS, WIDTH, ERRORS = 10, 5, 1
SYMBOLS = CHUNKS * WIDTH
#: Pairs whose signatures differ in more symbols aren't compared in full: at similarity 0.8 that happens to one pair in
#: 10^11 (a binomial tail of 50 symbols), as rarely as the 64-bit hashes of this module collide in a large corpus.
FAR = 32
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_K = _rng.integers(1, 1 << 63, (CHUNKS, WIDTH, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their bounds. A text with fewer than ``size`` words, but
    one at least, has its whole sequence as the only shingle."""
    w = Words(buf, offs, lower=True)
    h, counts = w.hashes(), w.counts()
    x, at = windows(h, w.first, size)
    doc = np.repeat(np.arange(len(counts)), counts)[at] if len(at) else at
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        lo, hi = w.first[short], w.first[short + 1]
        whole = np.array([_whole(h[i:j]) for i, j in zip(lo, hi)], np.uint64)
        x, doc = np.append(x, whole), np.append(doc, short)
        order = np.argsort(doc, kind="stable")
        x, doc = x[order], doc[order]
    return sorted_unique(doc, x, len(counts))


def _whole(h: np.ndarray) -> np.uint64:
    x = np.uint64(0xA24BAED4963EE407 + len(h))
    with np.errstate(over="ignore"):
        for v in h:
            x = mix(np.array([x * np.uint64(0x2545F4914F6CDD1D) ^ v], np.uint64))[0]
    return x


def signatures(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, SYMBOLS) of uint16; zeros for empty sets."""
    n = len(bounds) - 1
    sig = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            for i in range(SYMBOLS):
                low = np.minimum.reduceat((x ^ _B[i]) * _A[i], bounds[full])
                sig[full, i] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return sig


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, CHUNKS * WIDTH) of int64: each chunk's symbols but one, hashed with which was left out."""
    s = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    out = np.zeros((len(sig), CHUNKS, WIDTH), np.uint64)
    with np.errstate(over="ignore"):
        for gone in range(WIDTH):
            x = np.zeros((len(sig), CHUNKS), np.uint64)
            for i in range(WIDTH):
                if i != gone:
                    x = mix(x + (s[:, :, i] + np.uint64(1)) * _K[None, :, gone, i])
            out[:, :, gone] = x
    return out.reshape(len(sig), -1).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, node, sig): the set's size, a hash that stands for the set, its signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for part in slices(batches):
            x, bounds = shingle_sets(*buffers(part.column(1)), size)
            n = np.diff(bounds)
            sig = signatures(x, bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(set_hashes(x, bounds)), pa.array([s.tobytes() for s in sig], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, node long, sig binary")


def set_hashes(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(x + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
        return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def keyed(nodes: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            for at in range(0, len(node), 2000):
                keys = chunk_keys(sig[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(node[at : at + 2000], keys.shape[1]))], schema=schema)

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def near_signatures(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity and whose signatures differ in at most FAR symbols."""

    def run(batches):
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            yield b.filter(pa.array((s != t).sum(1) <= FAR)).select(["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, members): the whole shingle sets, sorted, of the wanted nodes."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])
    ids = wanted.join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct()

    def run(batches):
        for part in slices(batches, "text"):
            x, bounds = shingle_sets(*buffers(part.column(0)), size)
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(x, bounds)), pa.array([x[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())], schema=schema)

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, "node long, members binary")
    return made.dropDuplicates(["node"]).join(wanted, "node", "left_semi")


def sharing_rare(spark: SparkSession, docs: DataFrame, nodes: DataFrame, left: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of open nodes in different components that share one of their rarest shingles. Ordered by how
    many open nodes have them, sets that are similar share one of each one's first n - ceil(percent n / 100) + 1
    shingles; what many texts have, such as a license, comes last and brings none together."""
    schema = pa.schema([("node", pa.int64()), ("item", pa.int64())])

    def explode(batches):
        for b in batches:
            for node, members in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(members.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x)], schema=schema)

    sets = stored(spark, full_sets(docs, nodes, left.select("node"), size), "sets")
    items = sets.mapInArrow(explode, "node long, item long")
    common = items.groupBy("item").count().where("count > 1")
    # shingles of one node alone come first in its order and bring it together with none: their number is enough
    known = items.join(common, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "item"))).alias("items"))
    sizes = nodes.select("node", "n").join(left, "node")
    first = known.join(sizes, "node").withColumn("take", F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 - (n - size(items)) as int)")).where("take > 0")
    posts = first.select("node", "part", "n", F.explode(F.slice("items", F.lit(1), F.col("take"))).alias("i")).select("node", "part", "n", F.col("i.item").alias("item"))
    mixed = posts.groupBy("item").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("item")
    posts = posts.join(mixed, "item", "left_semi").select("node", "part", "n", "item")
    other = posts.toDF("b", "pb", "nb", "item")
    both = posts.toDF("a", "pa", "na", "item").join(other, "item").where("a < b and pa <> pb").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = stored(spark, both.select("a", "b").distinct(), "pairs")
    discard(sets)
    return pairs


def confirmed(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * intersection >= percent * union, on their full sets; a stored table."""
    full = stored(spark, full_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size), "sets")

    def compare(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (s, t) in enumerate(zip(b.column(2), b.column(3))):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
            yield b.filter(pa.array(ok)).select(["a", "b"])

    sa, sb = full.select(F.col("node").alias("a"), F.col("members").alias("ma")), full.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    links = stored(spark, pairs.join(sa, "a").join(sb, "b").select("a", "b", "ma", "mb").mapInArrow(compare, "a long, b long"), "links")
    discard(full)
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    prepare(spark)
    rows = stored(spark, sketches(docs, size), "sketches")
    nodes = stored(spark, rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    keys = keyed(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = stored(spark, keys.join(shared, "key"), "buckets")
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"))
    met = buckets.join(hubs, "key").where("node <> hub")
    stars = met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(spark, near_signatures(stars, nodes, percent), "pairs")
    links = confirmed(spark, docs, nodes, pairs, size, percent)
    discard(pairs)
    parts = components(spark, links)
    # what the stars leave open: nodes that share a bucket, of which neither is the hub, in different components
    place = parts.select("node", F.col("component_id").alias("part"))
    rest = met.select("key", "node").join(place, "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = rest.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    left = stored(spark, rest.join(mixed, "key", "left_semi").select("node", "part").distinct(), "open")
    discard(buckets)
    across = sharing_rare(spark, docs, nodes, left, size, percent)
    more = confirmed(spark, docs, nodes, stored(spark, near_signatures(across, nodes, percent), "pairs"), size, percent)
    discard(across)
    if not more.isEmpty():
        parts = components(spark, links.unionByName(more))
    whole = nodes.join(parts, "node", "left").select("node", "rep", F.coalesce("component_id", "node").alias("part"))
    least = whole.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "part").select("node", "component_id")
    out = rows.join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (all its columns) without those that nearly repeat a document of a smaller id; of rows equal in id and
    words one stays."""
    found = stored(spark, near_duplicates(spark, docs.select("doc_id", "text"), size, percent), "groups")
    gone = found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("n_shingles").alias("__n")).distinct()
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    left = docs.join(gone.select("__id").distinct(), F.col("doc_id") == F.col("__id"), "left_anti")
    if twice.isEmpty():
        return left
    repeated = docs.join(twice, F.col("doc_id") == F.col("__id"), "left_semi")
    return docs.join(gone.select("__id").unionByName(twice).distinct(), F.col("doc_id") == F.col("__id"), "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir).select("doc_id", "text"), size=2, percent=80)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.a = n.doc_id
"""
