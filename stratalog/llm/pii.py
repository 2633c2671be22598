"""Personal data by bootstrapped contextual extraction.

Base rules find emails, addresses, cards and phones; these are the seeds. Every seed induces lexical patterns: its
shape (digits and letters by class), the word before it, the two words before it and the word after it. Pattern and
instance form a graph that Spark scores in rounds: a pattern's confidence in a kind is the share of its instances that
are known to be of that kind, if enough different texts support it; an instance's is one minus the product of its
patterns' doubts. Instances above ``ACCEPT`` become known, and give their own patterns support in the next round.
Candidates are runs of tokens with a digit or an at sign that no base finding covers; a number must still pass its
kind's arithmetic (Luhn, parts up to 255, digits in range). Copies of one text count once.

Defined results: null text counts as empty; rows with null or repeated doc_id get each the findings of their text; an
empty table gives an empty result; extra columns are ignored (``mask`` keeps them).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, prepare, stored
from .textkit import Words, buffers, slices

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENT, ACCEPT, ROUNDS, WIDEST = 5, 0.8, 0.9, 3, 6
_RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'[]<>{}"


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    """The arithmetic of a kind."""
    if kind == "ip":
        return bool(_RULES["ip"].fullmatch(s)) and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, failing ones dropped; by kind as listed, then start."""
    out = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out.extend((kind, m.start(), m.end()) for m in _RULES[kind].finditer(text) if valid(kind, m[0]))
    return out


def shape(s: str) -> str:
    """Classes of the characters: digits keep their number unless letters stand beside them, letters are one ``a``."""
    if re.search("[^\\W\\d_]", s):
        return re.sub("9+", "9", re.sub("[0-9]", "9", re.sub("[^\\W\\d_]+", "a", s)))
    return re.sub("[0-9]", "9", s)


def contexts(before: list[str], after: list[str]) -> list[str]:
    clean = lambda w: w.strip(_EDGE + "()").lower()
    out = []
    if before:
        out.append("l:" + clean(before[-1]))
    if len(before) > 1:
        out.append("ll:" + clean(before[-2]) + " " + clean(before[-1]))
    if after:
        out.append("r:" + clean(after[0]))
    return [c for c in out if c.strip("lr: ")]


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds (with their kind) and candidates (kind null), each with its patterns."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = np.array([t[0] for t in tokens], np.int64)
    out = []

    def add(kind, s, e):
        i, j = int(np.searchsorted(starts, s, "right")) - 1, int(np.searchsorted(starts, e, "left"))
        before = [text[a:b] for a, b in tokens[max(0, i - 2) : i]]
        after = [text[a:b] for a, b in tokens[j : j + 1]]
        out.append({"kind": kind, "start": s, "end": e, "shape": "s:" + shape(text[s:e]), "patterns": contexts(before, after), "ok": [k for k in KINDS if valid(k, text[s:e])] if kind is None else []})

    covered = sorted((s, e) for _, s, e in spans)
    for kind, s, e in spans:
        add(kind, s, e)
    heads = np.array([s for s, _ in covered], np.int64)
    tails = np.maximum.accumulate(np.array([e for _, e in covered], np.int64)) if covered else heads
    free = []
    for i, (s, e) in enumerate(tokens):
        t = text[s:e]
        if "@" not in t and not digits(t):
            continue
        k = int(np.searchsorted(heads, e, "left"))
        if not k or tails[k - 1] <= s:
            free.append(i)
    for n, i in enumerate(free):
        for width in range(1, WIDEST + 1):
            if n + width > len(free) or free[n + width - 1] != i + width - 1:
                break
            s, e = tokens[i][0], tokens[i + width - 1][1]
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in _EDGE:
                e -= 1
            if e - s >= 6:
                add(None, s, e)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, items): th is a hash of the text, items are only made for texts with a digit or at sign."""
    base_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    item_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("shape", pa.string()), ("patterns", pa.list_(pa.string())), ("ok", pa.list_(pa.string()))]))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("base", base_t), ("items", item_t)])
    mark = np.zeros(256, bool)
    mark[[*b"0123456789@"]] = True

    def run(batches):
        for part in slices(batches):
            buf, offs = buffers(part.column(1))
            upto = np.append(0, np.cumsum(mark[buf]))
            some = np.flatnonzero(upto[offs[1:]] > upto[offs[:-1]])
            th = Words(buf, offs).span(offs[:-1], offs[1:]).view(np.int64)
            base, items = [[] for _ in range(len(th))], [[] for _ in range(len(th))]
            for d in some.tolist():
                text = buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")
                spans = base_spans(text)
                base[d] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                items[d] = instances(text, spans)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(th), pa.array(base, base_t), pa.array(items, item_t)], schema=schema)

    span = "array<struct<kind:string,start:int,end:int>>"
    item = "array<struct<kind:string,start:int,end:int,shape:string,patterns:array<string>,ok:array<string>>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, th long, base {span}, items {item}")


def bootstrap(spark: SparkSession, scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(th, kind, start, end, score): the accepted candidates of each text."""
    once = scanned.where(F.size("items") > 0).groupBy("th").agg(F.first("items").alias("items"))
    flat = once.select("th", F.explode("items").alias("i")).select("th", "i.*")
    edges = stored(spark, flat.select("th", "kind", "start", "end", "ok", F.explode(F.concat(F.array("shape"), "patterns")).alias("pattern")), "pattern-edges")
    key = ["th", "start", "end"]
    candidates = edges.where("kind is null")
    known = edges.where("kind is not null").select(*key, F.col("kind").alias("is"), F.lit(1.0).alias("score")).distinct()
    # a candidate of several tokens counts for its own patterns only where something is known of it; those of one
    # token are what speaks against a pattern
    accepted = None
    for _ in range(rounds):
        labelled = edges.join(known, key, "left")
        totals = labelled.groupBy("pattern").agg(F.countDistinct("th", "start").alias("all"))
        by_kind = labelled.where("is is not null").groupBy("pattern", "is").agg(F.sum("score").alias("sum"), F.countDistinct("th").alias("texts"))
        scored = by_kind.join(totals, "pattern").select("pattern", "is", F.least(F.lit(0.999), F.col("sum") / F.col("all")).alias("confidence"), "texts")
        scored = stored(spark, scored.where((F.col("texts") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)), "patterns")
        hits = candidates.join(scored, "pattern").where(F.array_contains("ok", F.col("is")))
        score = (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")
        now = hits.groupBy(*key, "is").agg(score).where(F.col("score") >= ACCEPT)
        best = Window.partitionBy(*key).orderBy(F.desc("score"), "is")
        now = stored(spark, now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"), "accepted")
        n = now.count()
        if accepted is not None and n == accepted[1]:
            accepted = (now, n)
            break
        accepted = (now, n)
        known = edges.where("kind is not null").select(*key, F.col("kind").alias("is"), F.lit(1.0).alias("score")).distinct().unionByName(now.select(*key, "is", "score"))
    return accepted[0].select("th", F.col("is").alias("kind"), "start", "end", "score")


def disjoint(added: list[dict], base: list[dict]) -> list[tuple[str, int, int]]:
    """Accepted candidates by score, longest and leftmost first, that overlap no base span and none taken before."""
    taken = [(b["start"], b["end"]) for b in base]
    out = []
    for a in sorted(added, key=lambda a: (-round(a["score"], 9), a["start"] - a["end"], a["start"], a["kind"])):
        if all(a["end"] <= s or e <= a["start"] for s, e in taken):
            taken.append((a["start"], a["end"]))
            out.append((a["kind"], a["start"], a["end"]))
    return out


def personal_data(spark: SparkSession, docs: DataFrame, salts: int = 16) -> DataFrame:
    """(doc_id, base, spans) per row of ``docs``; both are arrays of struct<kind, start, end> by kind, then start."""
    prepare(spark)
    scanned = stored(spark, scan(docs), "scanned")
    added = bootstrap(spark, scanned).groupBy("th").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("added"))
    spread = added.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    rows = scanned.select("doc_id", "th", "base", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")).join(spread, ["th", "salt"], "left").select("doc_id", "base", "added")
    span_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            base, more = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for own, new in zip(base, more):
                spans = [(x["kind"], x["start"], x["end"]) for x in own] + (disjoint(new, own) if new else [])
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, span_t)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark, documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
