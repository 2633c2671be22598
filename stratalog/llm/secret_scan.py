"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by its content (SHA-256). The ledger, two Parquet tables in shared
storage, remembers which (blob, rule version) pairs were scanned and what was found; a scan reads only texts of pairs
not seen before, each blob once however many paths hold it, and findings are joined back to all paths.

Rules find leftmost non-overlapping matches per kind, then drop those that fail the rule's check. Offsets count code
points, the end is exclusive.

Defined results: null text counts as empty; an empty text has no findings; rows with equal or null paths each get
their own result row; an empty table gives an empty result; other columns of the input are ignored or, in
``redact``, kept, whatever their names (the join columns carry reserved names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_folder


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regular expression; a match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # Over maximal runs these two equal "any run, then drop the short ones".
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
# Repeated groups are possessive: Java matches those in a loop, others by recursion, which long texts overflow.
_NAME = r"(?:(?!PRIVATE\x20KEY)[A-Z]++\x20)*+PRIVATE\x20KEY-----"
MORE = (
    # the whole block where it is closed, else its head
    Rule("pem", rf"-----BEGIN\x20{_NAME}(?:(?:[^-]++|-(?!----))*+-----END\x20{_NAME})?+", version="2"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", version="2"),
    # starts where a run of its characters starts, so no run is read again from each of its places
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", version="2"),
)
RULES = BASE + MORE
#: A text that doesn't match this has no finding of any rule above.
GATE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN\x20|gh[pousr]_|eyJ"""

_FOUND = "blob binary, rule string, kind string, start int, end int"
_SEEN = "blob binary, rules array<string>"


def spans_of(rule: Rule, text: Column) -> Column:
    """array<struct<start, end>> of one rule's findings: lengths of the pieces between matches give the places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.zip_with(
        F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x)),
        F.arrays_zip(found.alias("m"), checked.alias("g")),
        lambda gap, x: F.struct(gap.alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["g"]) >= rule.least).alias("ok")),
    )
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>))")
    walked = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.when(x["ok"], F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end")))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return walked["out"]


class BlobLedger:
    """Scanned pairs and findings under ``root``. Each scan appends one folder to ``found`` and then one to ``seen``:
    a job that dies between the two scans those blobs again, and the repeated findings are equal rows."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or new_folder(spark, "ledger")).rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return None

    def seen(self) -> DataFrame | None:
        return self._table("seen", _SEEN)

    def found(self, rules=RULES) -> DataFrame:
        t = self._table("found", _FOUND)
        t = self.spark.createDataFrame([], _FOUND) if t is None else t
        return t.where(F.col("rule").isin([r.key for r in rules])).distinct()

    def scan(self, history: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
        """Scan what ``history`` (one row per path and version) brings; returns history's findings by blob."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        blobs = history.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''").select(blob_of("text").alias("blob"), "text")
        known = self.seen()
        if known is not None:
            done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
            todo = blobs.groupBy("blob").agg(F.lit(1).alias("one")).join(done, "blob", "left").select("blob", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
            # one row per blob first, so a text that many paths hold isn't shuffled for each; those fully scanned stop here
            fresh = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
        else:
            fresh = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", keys)
        each = F.array_compact(F.array(*[F.when(F.array_contains("rules", r.key), F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), spans_of(r, F.col("text")).alias("spans"))) for r in rules]))
        run = new_folder(self.spark, "x").rpartition("-")[2]
        # one pass over the fresh texts writes both facts: that they were scanned, and what was found
        scanned = fresh.select("blob", "rules", F.when(F.col("text").rlike(GATE) if rules == RULES else F.lit(True), F.filter(each, lambda x: F.size(x["spans"]) > 0)).alias("hits"))
        scanned.write.parquet(f"{self.root}/scan/run={run}")
        back = self.spark.read.parquet(f"{self.root}/scan/run={run}")
        back.where(F.size("hits") > 0).select("blob", F.explode("hits").alias("h")).select("blob", "h.rule", "h.kind", F.explode("h.spans").alias("s")).select("blob", "rule", "kind", "s.start", "s.end").write.mode("append").parquet(f"{self.root}/found")
        back.select("blob", "rules").write.mode("append").parquet(f"{self.root}/seen")
        return self.found(rules)


def blob_of(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_blob(found: DataFrame, rules=RULES) -> DataFrame:
    """One row per blob with findings: spans as an array ordered by start, then kind as listed."""
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    return found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))


def findings_by_path(history: DataFrame, ledger: BlobLedger, path: str = "doc_id", text: str = "text", rules=RULES, salts: int = 16) -> DataFrame:
    """Every row of ``history`` as (path, spans). Findings are few and are repeated ``salts`` times, so a blob that a
    third of all paths hold is spread over that many tasks."""
    found = by_blob(ledger.scan(history, text, rules), rules)
    # findings grow with the corpus: never broadcast
    paths = history.select(F.col(path).alias("path"), blob_of(text).alias("blob")).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return paths.join(spread.hint("merge"), ["blob", "salt"], "left").select("path", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:bigint,end:int,kind:string>>")).alias("spans"))


def redact(history: DataFrame, ledger: BlobLedger, text: str = "text", mark: str = "[SECRET]", rules=RULES, salts: int = 16) -> DataFrame:
    """``history`` with each run of overlapping findings replaced by ``mark``; texts without findings are unchanged."""
    found = by_blob(ledger.scan(history, text, rules), rules).select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    names = [f"c{i}" for i in range(len(history.columns))]  # whatever history's columns are called
    body = names[history.columns.index(text)]
    others = [F.col(n) for n in names if n != body]
    plain = history.toDF(*names)
    marked = plain.withColumns({"blob": blob_of(body), "salt": F.pmod(F.xxhash64(F.struct(*others)) if others else F.lit(1), F.lit(salts)).cast("int")})
    joined = marked.join(found.hint("merge"), ["blob", "salt"], "left")
    # Runs of overlapping findings become one; then what lies between them is cut from the array of characters, as a
    # substring of a string would count its characters from the start each time.
    runs = F.aggregate(
        F.col("spans"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) > s["start"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end")))),
    )
    chars = F.split(body, "")
    between = lambda lo, hi: F.array_join(F.slice("chars", lo + 1, F.greatest(hi - lo, F.lit(0))), "")
    gaps = F.transform(F.col("runs"), lambda r, i: between(F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("runs"), i - 1)["end"]), r["start"]))
    last = F.get(F.col("runs"), F.size("runs") - 1)["end"]
    masked = F.concat(F.array_join(F.concat(gaps, F.array(F.lit(""))), mark), between(last, F.length(body)))
    joined = joined.withColumn("runs", F.when(F.col("spans").isNotNull(), runs)).withColumn("chars", F.when(F.col("spans").isNotNull(), chars))
    return joined.withColumn(body, F.when(F.col("spans").isNull(), F.col(body)).otherwise(masked)).select(*names).toDF(*history.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = findings_by_path(docs, BlobLedger(spark))
    base = [r.kind for r in BASE]
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    return rows.select(F.col("path").alias("doc_id"), *[n(k).alias(f"n_{k}") for k in base], F.sha2(_joined(kept).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _spans_sql(rule: str, kind: str, pattern: str, rank: int, before: int, group: int, least: int) -> str:
    """One kind's spans in DuckDB: the lengths of what lies between matches give their places. ``before`` is the group
    of a character ahead of the match that isn't part of it (0: none)."""
    p = pattern.replace("'", "''")
    ahead = f"len(regexp_extract_all(t, '{p}', {before})[i])" if before else "0"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s + a AS s, e FROM (
    SELECT doc_id, ok, list_sum(list_transform(range(1, i + 1), lambda k: len(gaps[k]))) + coalesce(list_sum(list_transform(range(1, i), lambda k: len(ms[k]))), 0) AS s, s + len(ms[i]) AS e, {ahead} AS a
    FROM (SELECT doc_id, t, ms, gaps, gs, unnest(range(1, len(ms) + 1)) AS i, len(gs[i]) >= {least} AS ok
          FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', {group}) AS gs FROM d))
  ) WHERE ok"""


_SQL_NAME = "(?:[A-Z]+ )*?PRIVATE KEY-----"
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + "\n  UNION ALL".join(
        _spans_sql("", *x)
        for x in (
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 0, 1, 6),
            ("access", "AKIA[A-Z0-9]+", 2, 0, 0, 20),
            ("hex", "[0-9a-f]+", 3, 0, 0, 24),
            ("pem", f"-----BEGIN {_SQL_NAME}(?:(?:-{{0,4}}[^-])*-----END {_SQL_NAME})?", 4, 0, 0, 1),
            ("github", "(^|[^A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", 5, 1, 0, 1),
            ("jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 6, 1, 0, 1),
        )
    )
    + """
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
)
