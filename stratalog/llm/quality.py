"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each text is measured once. A metric's sketch is a histogram over logarithmic bins (every quantile is within one
per cent; two sketches merge by adding counts), aggregated per (lang, source), per lang and over all in one pass, with
map-side combining, so a source with a third of all rows sends a few hundred counts per task. A group's limits are
its quartiles plus or minus ``FENCE`` times the distance between them (or the metric's least spread, where a group
hardly varies); groups under ``FEW`` documents take those of their language, or of all. Documents outside a limit of
their own group are not kept.

Defined results: null text has no words and fails the base rules; null lang or source is a group of its own; rows
with null or repeated doc_id are judged each by its text; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import documents, prepare, stored
from .textkit import Words, buffers, code_points_before, slices, sorted_unique, windows

ALPHA, FENCE, FEW = 0.01, 4.0, 30
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Metric: SQL over the measures, value of the lowest bin, least spread, whether a low value also fails.
METRICS = {
    "word_length": ("word_chars / n_words", 0.01, 0.25, True),
    "symbol_share": ("n_symbols / word_chars", 0.001, 0.01, False),
    "dup_line_share": ("n_dup_lines / n_lines", 0.001, 0.15, False),
    "repeat_share": ("n_repeat_words / n_words", 0.001, 0.1, False),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measures(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The columns MEASURES of each document."""
    n = len(offs) - 1
    w = Words(buf, offs)
    counts = w.counts()
    doc = np.repeat(np.arange(n), counts)
    cp = code_points_before(buf)
    chars = np.bincount(doc, cp[w.ends] - cp[w.starts], n).astype(np.int64)
    upto = np.append(0, np.cumsum(_SYMBOL[buf]))
    symbols = upto[offs[1:]] - upto[offs[:-1]]
    # lines: cut at every newline and document start; those with a word are compared by hash
    heads = np.unique(np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1]))
    heads = heads[heads < len(buf)]
    tails = np.append(heads[1:], len(buf)) if len(heads) else heads
    cut = (buf[tails - 1] == 10) if len(tails) else np.zeros(0, bool)
    tails = tails - cut
    worded = np.searchsorted(w.starts, tails) > np.searchsorted(w.starts, heads)
    heads, tails = heads[worded], tails[worded]
    of = np.searchsorted(offs, heads, "right") - 1
    lines = np.bincount(of, minlength=n)
    _, bounds = sorted_unique(of, w.span(heads, tails), n)
    dups = lines - np.diff(bounds)
    # words in windows found twice or more in the text
    x, at = windows(w.hashes(), w.first, 3)
    d = doc[at] if len(at) else at
    order = np.lexsort((x, d))
    same = (x[order][1:] == x[order][:-1]) & (d[order][1:] == d[order][:-1])
    twice = np.zeros(len(x), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(w.starts) + 3, bool)
    for k in range(3):
        mark[at[twice] + k] = True
    repeats = np.bincount(doc, mark[: len(doc)], n).astype(np.int64)
    return [counts, chars, symbols, dups, repeats, lines]


def measured(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(m, pa.int64()) for m in MEASURES])

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(i) for i in (0, 2, 3)] + [pa.array(x.astype(np.int64)) for x in measures(*buffers(part.column(1)))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("text", "lang", "source")]).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bin, n) over rows that pass the base rules; level 0: lang and source, 1: lang, 3: all."""
    bins = [F.struct(F.lit(m).alias("metric"), F.expr(_bin(sql, low)).alias("bin")) for m, (sql, low, _, _) in METRICS.items()]
    flat = rows.where(~base_failed()).select("lang", "source", F.explode(F.array(*bins)).alias("x")).select("lang", "source", "x.metric", "x.bin")
    key = [F.col(c) for c in ("lang", "source", "metric", "bin")]
    level = (2 * F.grouping("lang") + F.grouping("source")).cast("int").alias("level")
    return flat.groupingSets([key, [key[0], *key[2:]], key[2:]], *key).agg(level, F.count("*").alias("n"))


def _bin(sql: str, low: float) -> str:
    value = f"(cast({sql.split(' / ')[0]} AS double) / {sql.split(' / ')[1]})"
    return f"CASE WHEN {value} <= {low} THEN 0 ELSE cast(ceil(ln({value} / {low}) / {math.log(GAMMA)!r}) AS int) END"


def limits(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, docs, <metric>_low, <metric>_high)."""
    w = Window.partitionBy("level", "lang", "source", "metric")
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    q = sketch.withColumn("upto", upto).withColumn("docs", F.sum("n").over(w))
    out = []
    for m, (_, low, spread, both) in METRICS.items():
        value = F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(F.lit(low) * F.pow(F.lit(GAMMA), F.col("bin")))
        q1 = F.min(F.when((F.col("metric") == m) & (4 * F.col("upto") >= F.col("docs")), value))
        q3 = F.min(F.when((F.col("metric") == m) & (4 * F.col("upto") >= 3 * F.col("docs")), value))
        fence = F.lit(FENCE) * F.greatest(q3 - q1, F.lit(spread))
        out += [(q3 + fence).alias(f"{m}_high")] + ([(q1 - fence).alias(f"{m}_low")] if both else [])
    return q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *out)


def judged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with its measures, base_failed and kept."""
    prepare(spark)
    rows = stored(spark, measured(docs), "measures")
    lim = stored(spark, limits(sketches(rows)), "limits")
    names = [c for c in lim.columns if c.endswith(("_low", "_high"))]
    out = rows
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (3, [])):
        own = lim.where(f"level = {level} and (docs >= {FEW} or level = 3)").select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*names).alias(f"__l{level}"))
        on = [rows[k].eqNullSafe(own[f"__{k}"]) for k in keys]
        out = out.join(own if keys else own.limit(1), on if on else F.lit(True), "left").drop(*[f"__{k}" for k in keys])
    lim_of = F.coalesce("__l0", "__l1", "__l3")
    bad = F.lit(False)
    for m, (sql, _, _, both) in METRICS.items():
        a, b = sql.split(" / ")
        value = F.expr(f"cast({a} AS double) / {b}")
        bad = bad | (value > lim_of[f"{m}_high"])
        if both:
            bad = bad | (value < lim_of[f"{m}_low"])
    failed = base_failed()
    # rows that fail the base rules may have no words to divide by; the verdict on them is already made
    return out.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(~F.coalesce(bad, F.lit(False)))).select("doc_id", *MEASURES, "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("n_lines")


def _sql() -> str:
    bins = ",\n  ".join(f"{_bin(sql, low).replace(' AS int)', ' AS INTEGER)')} AS b_{m}" for m, (sql, low, _, _) in METRICS.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, b_{m} AS bin FROM b" for m in METRICS)
    lims, bad = [], []
    for m, (sql, low, spread, both) in METRICS.items():
        value = f"CASE WHEN bin = 0 THEN 0 ELSE {low} * pow({GAMMA!r}, bin) END"
        q1, q3 = (f"min(CASE WHEN metric = '{m}' AND 4 * upto >= {k} * docs THEN {value} END)" for k in (1, 3))
        fence = f"{FENCE} * greatest({q3} - {q1}, {spread})"
        x = f"(cast({sql.split(' / ')[0]} AS double) / {sql.split(' / ')[1]})"
        lims.append(f"{q3} + {fence} AS {m}_high")
        pick = lambda c: f"CASE WHEN l0.level IS NOT NULL THEN l0.{c} WHEN l1.level IS NOT NULL THEN l1.{c} ELSE l3.{c} END"
        bad.append(f"{x} > {pick(m + '_high')}")
        if both:
            lims.append(f"{q1} - {fence} AS {m}_low")
            bad.append(f"{x} < {pick(m + '_low')}")
    return f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents
), u AS (
  SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) END AS g FROM t
), k AS (
  SELECT doc_id, p FROM (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS p FROM u) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM k) GROUP BY 1
), m AS (
  SELECT u.doc_id, lang, source, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM u LEFT JOIN rep ON rep.doc_id = u.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
b AS (SELECT lang, source, {bins} FROM f WHERE NOT base_failed),
x AS ({long}),
s AS (SELECT 2 * grouping(lang) + grouping(source) AS level, lang, source, metric, bin, count(*) AS n FROM x
  GROUP BY GROUPING SETS ((lang, source, metric, bin), (lang, metric, bin), (metric, bin))),
q AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto,
  sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM s),
l AS (SELECT level, lang, source, max(docs) AS docs, {', '.join(lims)} FROM q GROUP BY 1, 2, 3)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE NOT ({' OR '.join(bad)}) END AS kept
FROM f LEFT JOIN l AS l0 ON l0.level = 0 AND l0.docs >= {FEW} AND l0.lang IS NOT DISTINCT FROM f.lang AND l0.source IS NOT DISTINCT FROM f.source
LEFT JOIN l AS l1 ON l1.level = 1 AND l1.docs >= {FEW} AND l1.lang IS NOT DISTINCT FROM f.lang LEFT JOIN l AS l3 ON l3.level = 3
"""


SQL = _sql()
