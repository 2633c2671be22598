"""Evaluation of strata: one plan for a relation that isn't recursive, rounds of semi-naive evaluation for the others."""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..language import ast as A
from .rules import Context, compile_rule, wide_pairs
from .store import Store, Table


class NoFixpoint(RuntimeError):
    pass


@contextmanager
def settings(spark, values: dict[str, str]):
    """Session settings for a while; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def sized(spark, rows: int, per_task: int = 200_000) -> dict[str, str]:
    """Few shuffle partitions, and no re-planning, for small rounds: their cost is fixed overhead. Others run under the
    session's own settings."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if rows <= 4 * per_task:
        return {"spark.sql.shuffle.partitions": str(max(1, min(usual, -(-rows // (per_task // 4)), spark.sparkContext.defaultParallelism))), "spark.sql.adaptive.enabled": "false"}
    return {}


class Evaluator:
    def __init__(self, ctx: Context, store: Store, tables: dict[str, Table], log: list, max_iterations: int):
        self.ctx, self.store, self.tables, self.log, self.max_iterations = ctx, store, tables, log, max_iterations
        self.spark = ctx.spark

    def df(self, name: str) -> DataFrame:
        return self.tables[name].df()

    def save(self, df: DataFrame, name: str, parts: int | None = None) -> tuple[str, int]:
        """Writes a set; the count comes from the same job."""
        from pyspark.sql import Observation

        seen = Observation()
        path = self.store.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name, parts)
        return path, int(seen.get["n"])

    def record(self, kind: str, relation: str, began: float, rows: int, **more) -> None:
        self.log.append({"kind": kind, "relation": relation, "seconds": time.time() - began, "rows": rows, **more})

    def union(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), frames)

    def base(self, name: str, rules: list, facts: DataFrame | None, lazy: bool = False) -> None:
        """A relation from inputs, facts and rules that need nothing of its own stratum. ``lazy``: it stays a plan that
        Catalyst optimises together with what reads it, down to the columns and filters of a scan."""
        began = time.time()
        if lazy and not rules and facts is not None:
            self.tables[name].lazily(facts, False)
            return
        if lazy and len(rules) == 1 and facts is None:
            wide = wide_pairs(self.ctx, rules[0], lambda i, a: self.df(a.name))
            if wide is not None:
                self.tables[name].lazily(wide, True)
                return
        frames = [compile_rule(self.ctx, r, lambda i, a: self.df(a.name), lambda i, a: self.tables[a.name].rows) for r in rules]
        if facts is not None:
            frames.append(facts)
        if not frames:
            return
        if lazy:
            self.tables[name].lazily(self.union(frames).distinct(), True)
            return
        rows = sum(self.tables[a.name].rows for r in rules for a in r.atoms)
        with settings(self.spark, sized(self.spark, rows) if rules else {}):
            path, n = self.save(self.union(frames).distinct(), name)
        self.tables[name].add(path, n)
        self.record("nonrecursive", name, began, n, rules=[_show(r.source) for r in rules])

    def recursive(self, group: list[str], rules: dict[str, list]) -> None:
        """Rounds: rule versions read the newest increment at one atom, everything so far before it and what was there
        a round earlier behind it, so no combination is derived twice; new tuples are those not yet in the relation."""
        inside = set(group)
        fresh = {r: bool(self.tables[r].paths) for r in group}
        for r in group:  # the initial set is one increment
            if len(self.tables[r].paths) > 1:
                path, n = self.save(self.df(r), r)
                self.tables[r].paths, self.tables[r].counts = [path], [n]
        rounds = 0
        while any(fresh.values()):
            rounds += 1
            if rounds > self.max_iterations:
                raise NoFixpoint(f"no fixpoint of {', '.join(group)} after {self.max_iterations} rounds")
            plans: dict[str, DataFrame] = {}
            began = time.time()
            total = 0
            for name in group:
                frames = []
                for r in rules[name]:
                    at = [i for i, a in enumerate(r.atoms) if a.name in inside]
                    for version, j in enumerate(at):
                        if fresh[r.atoms[j].name]:
                            frames.append(self.version(r, version, j, at, fresh))
                            total += sum(self.tables[a.name].rows for a in r.atoms)
                if frames:
                    plans[name] = self.union(frames).distinct()
            results = {}
            with settings(self.spark, sized(self.spark, total)):
                for name, df in plans.items():
                    had = self.tables[name]
                    cols = df.columns
                    new = df.join(had.df(), cols, "left_anti") if had.rows else df
                    results[name] = self.save(new, name)
            for name in group:
                path, n = results.get(name, (None, 0))
                fresh[name] = n > 0
                if n:
                    self.tables[name].add(path, n)
                elif path:
                    self.store.delete(path)
                if name in results:
                    self.record("recursive", name, began, n, round=rounds, total=self.tables[name].rows)
                self.tables[name].compact()

    def version(self, r, version: int, j: int, at: list[int], fresh: dict[str, bool]) -> DataFrame:
        def source(i: int, atom: A.Atom) -> DataFrame:
            t = self.tables[atom.name]
            if i == j:
                return t.newest()
            if i in at and i > j:
                return t.before_last(fresh[atom.name])
            return t.df()

        def sizes(i: int, atom: A.Atom) -> float:
            t = self.tables[atom.name]
            return t.counts[-1] if i == j else t.rows

        return compile_rule(self.ctx, r, source, sizes, version, first=j)


def _show(clause: A.Clause) -> str:
    return f"{clause.head.name} at line {clause.pos.line}"
