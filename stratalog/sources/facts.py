"""Fact files, result files, console, sizes and SQLite.

Fact files are lines of fields between tabs: no header, no quoting. A missing or empty field is ``n/a`` (a number: 0);
a number is the integer a field begins with, else 0; further fields are ignored. A last line without line end counts.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_facts(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """(c0, c1, ...) with the SQL types given; a set."""
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    return lines.select(*[_field(i, t).alias(f"c{i}") for i, t in enumerate(types)]).distinct()


def _field(i: int, kind: str):
    raw = F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    text = F.when(raw == "", F.lit("n/a")).otherwise(raw)
    if kind == "string":
        return text
    whole = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    wide = F.coalesce(F.when(whole == "", None).otherwise(whole).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    low, high = ((-(2**31), 2**31 - 1) if kind == "int" else (-(2**63), 2**63 - 1))
    return F.greatest(F.least(wide, F.lit(high).cast("decimal(38,0)")), F.lit(low).cast("decimal(38,0)")).cast(kind)


def wrong_lines(spark: SparkSession, path: str, arity: int) -> int:
    """How many lines have another number of fields; they are read all the same."""
    return spark.read.text(path).where(F.size(F.split("value", "\t", -1)) != arity).count()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def as_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("value"))


def write_table(df: DataFrame, path: str) -> None:
    """A folder of text parts, written by the executors."""
    as_lines(df).write.mode("overwrite").text(path)


def write_file(df: DataFrame, path: str) -> None:
    """One local file, streamed through the driver partition by partition."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for row in as_lines(df).toLocalIterator():
            f.write(row[0] + "\n")


def show(name: str, df: DataFrame, out) -> None:
    print(f"---------------\n{name}\n===============", file=out)
    for row in as_lines(df).toLocalIterator():
        print(row[0], file=out)
    print("===============", file=out)


def write_sqlite(relations: Iterable[tuple[str, list[str], DataFrame]], path: str, batch: int = 10000) -> None:
    """Tables ``_R`` of integers, ``__SymbolTable`` and a view ``R`` for each relation. The symbols are numbered here,
    where the file is written; rows stream through the driver."""
    db = sqlite3.connect(path)
    db.execute("PRAGMA synchronous = OFF")
    db.execute("CREATE TABLE IF NOT EXISTS __SymbolTable (id INTEGER PRIMARY KEY, symbol TEXT UNIQUE)")
    for name, columns, df in relations:
        texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
        quoted = [f'"{c}"' for c in columns]
        db.execute(f'DROP VIEW IF EXISTS "{name}"')
        db.execute(f'DROP TABLE IF EXISTS "_{name}"')
        db.execute(f'CREATE TABLE "_{name}" ({", ".join(q + " INTEGER" for q in quoted)})')
        is_text = [c in texts for c in df.columns]
        rows = []

        def flush():
            symbols = {v for r in rows for v, t in zip(r, is_text) if t}
            db.executemany("INSERT OR IGNORE INTO __SymbolTable (symbol) VALUES (?)", [(s,) for s in sorted(symbols)])
            ids = {}
            todo = sorted(symbols)
            for at in range(0, len(todo), 500):
                part = todo[at : at + 500]
                ids.update(db.execute(f"SELECT symbol, id FROM __SymbolTable WHERE symbol IN ({','.join('?' * len(part))})", part))
            db.executemany(f'INSERT INTO "_{name}" VALUES ({",".join("?" * len(columns))})', [[ids[v] if t else v for v, t in zip(r, is_text)] for r in rows])
            rows.clear()

        for row in df.toLocalIterator():
            rows.append(tuple(row))
            if len(rows) >= batch:
                flush()
        flush()
        picks = [f's{i}.symbol AS {q}' if t else f'r.{q}' for i, (q, t) in enumerate(zip(quoted, is_text))]
        joins = "".join(f' JOIN __SymbolTable s{i} ON s{i}.id = r.{q}' for i, (q, t) in enumerate(zip(quoted, is_text)) if t)
        db.execute(f'CREATE VIEW "{name}" AS SELECT {", ".join(picks)} FROM "_{name}" r{joins}')
    db.commit()
    db.close()
