"""Programs as objects: parse, check, feed, run, read."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import records, scalars
from .language import ast as A
from .language.checks import Checker
from .language.components import expand
from .language.diagnostics import ProgramError
from .language.parser import parse
from .language.types import TypeEnvironment
from .plans.fixpoint import Evaluator
from .plans.normalize import Names, doubled, drop_empty, private_targets, rule
from .plans.rules import Context
from .plans.store import Store, Table, local_frame
from .plans.strata import needed, sccs, uses
from .session import prepare
from .sources import facts as io


class RelationHandle:
    """A relation of a program: what it is, what it holds, and a way to put tuples in before ``run``."""

    def __init__(self, engine: Engine, relation: A.Relation):
        self.engine, self.relation = engine, relation
        self.name = relation.name

    is_input = property(lambda self: "input" in self.relation.qualifiers)
    is_output = property(lambda self: "output" in self.relation.qualifiers)
    arity = property(lambda self: self.relation.arity)

    def attribute_name(self, i: int) -> str:
        return self.relation.attributes[i].name

    def attribute_type(self, i: int) -> str:
        return self.engine.type_code(self.relation.attributes[i].type)

    @property
    def signature(self) -> str:
        return "<" + ",".join(self.attribute_type(i) for i in range(self.arity)) + ">"

    def insert(self, *rows: tuple) -> None:
        self.engine.insert(self.name, rows)

    def df(self) -> DataFrame:
        return self.engine.df(self.name)

    def size(self) -> int:
        return self.engine.size(self.name)

    __len__ = size

    def __contains__(self, row: tuple) -> bool:
        df = self.df()
        test = F.lit(True)
        for c, v in zip(df.columns, row):
            test = test & (F.col(f"`{c}`") == F.lit(v))
        return not df.where(test).isEmpty()

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(r) for r in self.df().toLocalIterator())


class Engine:
    """A checked program. ``number_bits`` is the width of ``number``; ``doubling`` evaluates transitive closures by
    path doubling; ``strict_inputs=False`` takes missing fact files as empty; ``strict_grounding`` refuses variables
    that only a functor binds."""

    def __init__(self, program: A.Program, spark: SparkSession, sources: dict | None = None, number_bits: int = 32, doubling: bool = True, strict_inputs: bool = True, strict_grounding: bool = False, allow_unstratified: bool = False, max_iterations: int = 10_000, root: str | None = None):
        prepare(spark)
        self.spark, self.sources, self.bits = spark, sources or {}, number_bits
        self.doubling, self.strict_inputs, self.max_iterations, self.root = doubling, strict_inputs, max_iterations, root
        program, problems = expand(program)
        names = Names()
        program.clauses = [private_targets(c, names) for c in program.clauses]
        checker = Checker(program, strict_grounding, allow_unstratified)
        self.diagnostics = problems + checker.run()
        if any(d.severity == "Error" for d in self.diagnostics):
            raise ProgramError(self.diagnostics, self.sources)
        self.program, self.names = program, names
        self.types = TypeEnvironment(program.types)
        self.relations = {r.name: r for r in program.relations}
        self.inputs: dict[str, DataFrame] = {}
        self.inserted: dict[str, list[tuple]] = {}
        self.messages: list[str] = []
        self.log: list[dict] = []
        self.tables: dict[str, Table] | None = None
        self._counter = 0
        self._ordinals: DataFrame | None = None
        self._ordinal_count = 0
        self._ordinal_paths: list[str] = []

    # --- making
    @classmethod
    def from_source(cls, text: str, spark: SparkSession, file: str = "<program>", include_dirs: Iterable[str] = (), macros: dict | None = None, number_bits: int = 32, **options) -> Engine:
        program, sources = parse(text, file, include_dirs, macros, number_bits)
        return cls(program, spark, sources, number_bits, **options)

    @classmethod
    def from_file(cls, path: str, spark: SparkSession, **options) -> Engine:
        with open(path, encoding="utf-8") as f:
            return cls.from_source(f.read(), spark, path, **options)

    # --- schema
    def sql_types(self, name: str) -> list[str]:
        number = scalars.number_type(self.bits)
        return [number if self.types.kind(a.type) == "number" else "string" for a in self.relations[name].attributes]

    def schema(self, name: str) -> T.StructType:
        kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}
        return T.StructType([T.StructField(f"c{i}", kinds[t], True) for i, t in enumerate(self.sql_types(name))])

    def type_code(self, declared: str, seen: frozenset = frozenset()) -> str:
        kind = self.types.kind(declared)
        out = {"number": "i:", "symbol": "s:", "record": "r:"}[kind] + declared
        d = self.types.decls[declared]
        if kind == "record" and declared not in seen:
            out += "{" + ",".join(f"{f.name}#{self.type_code(f.type, seen | {declared})}" for f in d.parts) + "}"
        if d.kind == "union" and declared not in seen:
            out += "[" + ",".join(self.type_code(p, seen | {declared}) for p in d.parts) + "]"
        return out

    # --- feeding
    def set_input(self, name: str, df: DataFrame) -> None:
        """Rows of a relation from any DataFrame with as many columns, in order. Nulls become ``n/a`` or 0."""
        kinds = self.sql_types(name)
        if len(df.columns) != len(kinds):
            raise ValueError(f"{name} has {len(kinds)} attributes, the data {len(df.columns)} columns")
        cols = [F.coalesce(F.col(f"`{c}`").cast(k), F.lit("n/a" if k == "string" else 0).cast(k)).alias(f"c{i}") for i, (c, k) in enumerate(zip(df.columns, kinds))]
        new = df.select(*cols)
        self.inputs[name] = self.inputs[name].unionByName(new) if name in self.inputs else new

    def insert(self, name: str, rows: Iterable[tuple]) -> None:
        rows = [tuple(r) for r in rows]
        for r in rows:
            if len(r) != self.relations[name].arity:
                raise ValueError(f"{name} has {self.relations[name].arity} attributes, a tuple {len(r)}")
            for v, k in zip(r, self.sql_types(name)):
                if isinstance(v, str) != (k == "string"):
                    raise TypeError(f"{v!r} doesn't fit an attribute of {name}")
        self.inserted.setdefault(name, []).extend(rows)

    def load_all(self, folder: str) -> None:
        """Fact files of all input relations: ``<folder>/<relation>.facts``."""
        for r in self.program.relations:
            if "input" in r.qualifiers:
                path = f"{folder.rstrip('/')}/{r.name.replace('.', '_')}.facts"
                if not io.exists(self.spark, path):
                    if self.strict_inputs:
                        raise FileNotFoundError(path)
                    self.messages.append(f"Cannot open fact file {path}")
                    continue
                wrong = io.wrong_lines(self.spark, path, r.arity)
                if wrong:
                    self.messages.append(f"Wrong arity of fact file for relation {r.name}: {wrong} lines")
                self.set_input(r.name, io.read_facts(self.spark, path, self.sql_types(r.name)))

    # --- evaluation
    def _value(self, t):
        """A constant term of a fact."""
        if isinstance(t, (A.Text, A.Num)):
            return t.value
        if isinstance(t, A.Nil):
            return records.NIL
        if isinstance(t, A.Record):
            return records.pack_value([self._value(a) for a in t.args])
        if isinstance(t, A.Cast):
            return self._value(t.arg)
        if isinstance(t, A.Functor):
            if t.op == "cat":
                return self._value(t.args[0]) + self._value(t.args[1])
            return scalars.fold(t.op, [self._value(a) for a in t.args], self.bits)
        raise TypeError(t)

    def _given(self, name: str, clauses: list[A.Clause]) -> DataFrame | None:
        """Inputs, inserted tuples and facts of a relation."""
        rows = [tuple(self._value(a) for a in c.head.args) for c in clauses if c.head.name == name and not c.body] + self.inserted.get(name, [])
        out = self.inputs.get(name)
        if rows:
            df = local_frame(self.spark, rows, self.schema(name))
            out = df if out is None else out.unionByName(df)
        return out

    def _numbered(self, df: DataFrame, column: str, first: int) -> tuple[DataFrame, int]:
        """``df``, stored, with distinct numbers from ``first`` on: a count per partition gives each its offset."""
        path = self.store.write(df, "numbered")
        kept = self.spark.read.schema(df.schema).parquet(path).withColumn("__m", F.monotonically_increasing_id())
        part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
        counts = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())  # a row per partition
        offset, at = [], first
        for p, n in counts:
            offset += [F.lit(p), F.lit(at)]
            at += n
        if not counts:
            return kept.select(*df.columns, F.lit(0).cast("bigint").alias(column)), first
        number = F.create_map(*offset)[part] + place
        return kept.select(*df.columns, number.cast(scalars.number_type(self.bits)).alias(column)), at

    def counter(self, df: DataFrame, column: str) -> DataFrame:
        out, self._counter = self._numbered(df, column, self._counter)
        return out

    def ordinals(self, symbols: DataFrame) -> DataFrame:
        """A dictionary (symbol, ordinal) that covers ``symbols``; numbers once given stay."""
        schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ordinal", T.IntegerType() if self.bits == 32 else T.LongType())])
        new = symbols.distinct()
        if self._ordinal_paths:
            new = new.join(self.store.read(self._ordinal_paths, schema), "symbol", "left_anti")
        numbered, self._ordinal_count = self._numbered(new, "ordinal", self._ordinal_count)
        self._ordinal_paths.append(self.store.write(numbered, "ordinals"))
        return self.store.read(self._ordinal_paths, schema)

    def _lazy(self, clauses: list[A.Clause], edges: dict, wanted: set[str], lazy_outputs: bool) -> set[str]:
        """Relations that stay plans: inputs without rules or facts, and relations read once, by no recursive stratum
        (each round would compute them again). With ``lazy_outputs`` also outputs that nothing reads."""
        reads: dict[str, int] = {}
        for c in clauses:
            for part in c.body + c.head.args:
                for n in A.walk(part):
                    if isinstance(n, A.Atom):
                        reads[n.name] = reads.get(n.name, 0) + 1
        recursive = {n for group in self.strata if len(group) > 1 or group[0] in edges[group[0]] for n in group}
        by_recursive = set().union(*(edges[n] for n in recursive)) if recursive else set()
        headed = {c.head.name for c in clauses}
        out = set()
        for n in edges:
            if n in recursive or n in by_recursive or self.inserted.get(n):
                continue
            if n not in headed:
                if n in self.inputs and n not in wanted:
                    out.add(n)
            elif n in wanted:
                if lazy_outputs and not reads.get(n):
                    out.add(n)
            elif reads.get(n, 0) == 1:
                out.add(n)
        return out

    def run(self, outputs: Iterable[str] | None = None, lazy_outputs: bool = False) -> Engine:
        """Evaluates what the outputs (by default all output and printsize relations, or all if there are none) need.
        ``lazy_outputs`` leaves outputs that need no recursion of their own as plans, evaluated by whoever reads them."""
        began = time.time()
        self.store = Store(self.spark, self.root)
        wanted = set(outputs or ()) or {r.name for r in self.program.relations if {"output", "printsize"} & r.qualifiers} or set(self.relations)
        given = set(self.inputs) | set(self.inserted) | {r.name for r in self.program.relations if "input" in r.qualifiers}
        clauses = drop_empty(self.program.clauses, given)
        if self.doubling:
            for name in self.relations:
                clauses = doubled(clauses, name, name not in given)
        live = needed(A.Program(clauses=clauses), wanted)
        self.tables = {n: Table(self.store, n, self.schema(n)) for n in self.relations}
        ctx = Context(self.spark, self.relations, self.types, self.bits, self.names, self.ordinals, self.counter, lambda n: self.tables[n].is_set)
        ev = Evaluator(ctx, self.store, self.tables, self.log, self.max_iterations)
        positive, negative = uses(clauses)
        edges = {n: (positive.get(n, set()) | negative.get(n, set())) & set(self.relations) for n in self.relations if n in live}
        self.strata = sccs(edges)
        lazy = self._lazy(clauses, edges, wanted, lazy_outputs)
        # a plan's own reads happen later, so what it reads isn't counted down
        remaining = {n: sum(n in edges[m] for m in edges) for n in edges}
        for group in self.strata:
            inside = set(group)
            recursive = len(group) > 1 or group[0] in edges[group[0]]
            later: dict[str, list] = {}
            for name in group:
                own = [c for c in clauses if c.head.name == name and c.body]
                rec = [c for c in own if any(isinstance(b, A.Atom) and b.name in inside for b in c.body)]
                base = [rule(c, self.names) for c in own if c not in rec]
                later[name] = [rule(c, self.names) for c in rec]
                ev.base(name, base, self._given(name, clauses), name in lazy)
            if recursive:
                ev.recursive(group, later)
            for m in group:  # what nothing will read again goes
                for n in edges[m] if m not in lazy else ():
                    remaining[n] -= 1
                    if not remaining[n] and n not in wanted and n not in inside:
                        for p in self.tables[n].paths:
                            self.store.delete(p)
                        self.tables[n].paths, self.tables[n].counts = [], []
        self.log.append({"kind": "runtime", "relation": "", "seconds": time.time() - began, "rows": sum(sum(t.counts) for t in self.tables.values())})
        return self

    # --- reading
    def df(self, name: str) -> DataFrame:
        """The relation's tuples under its attributes' names."""
        if self.tables is None:
            raise RuntimeError("run() comes first")
        t = self.tables[name]
        return (t.df() if t.is_set else t.df().distinct()).toDF(*[a.name for a in self.relations[name].attributes])

    __getitem__ = df

    def size(self, name: str) -> int:
        return self.tables[name].rows if self.tables[name].view is None else self.df(name).count()

    def relation(self, name: str) -> RelationHandle:
        return RelationHandle(self, self.relations[name])

    def all_relations(self) -> list[RelationHandle]:
        return [RelationHandle(self, r) for r in self.program.relations]

    def input_relations(self) -> list[RelationHandle]:
        return [h for h in self.all_relations() if h.is_input]

    def output_relations(self) -> list[RelationHandle]:
        return [h for h in self.all_relations() if h.is_output]

    def internal_relations(self) -> list[RelationHandle]:
        return [h for h in self.all_relations() if not h.is_input and not h.is_output]

    def unpacked(self, name: str, column: str) -> DataFrame:
        """The relation with a record column as an array of its fields' texts (null for nil)."""
        decode = F.udf(records.unpack_value, "array<string>")
        return self.df(name).withColumn(column, decode(F.col(column)))

    def write_all(self, folder: str | None, single_file: bool = True, out=None) -> None:
        """Output relations as ``<folder>/<relation>.csv`` (``-``: to the console), sizes of printsize relations."""
        out = out or sys.stdout
        for r in self.program.relations:
            if "printsize" in r.qualifiers:
                print(f"{r.name}\t{self.size(r.name)}", file=out)
            if "output" not in r.qualifiers or not folder:
                continue
            if folder == "-":
                io.show(r.name, self.df(r.name), out)
                continue
            path = os.path.join(folder, r.name.replace(".", "_") + ".csv")
            (io.write_file if single_file else io.write_table)(self.df(r.name), path)

    def dump_sqlite(self, path: str, outputs_only: bool = True) -> None:
        chosen = [r for r in self.program.relations if "output" in r.qualifiers or not outputs_only]
        io.write_sqlite(((r.name.replace(".", "_"), [a.name for a in r.attributes], self.df(r.name)) for r in chosen), path)

    def explain(self) -> str:
        """Relations, strata and rules, and where time went if the program has run."""
        positive, negative = uses(self.program.clauses)
        edges = {n: (positive.get(n, set()) | negative.get(n, set())) & set(self.relations) for n in self.relations}
        lines = ["relations:"]
        for r in self.program.relations:
            lines.append(f"  {r.name}({', '.join(f'{a.name}:{a.type}' for a in r.attributes)}) {' '.join(sorted(r.qualifiers))}".rstrip())
        lines.append("strata:")
        for i, group in enumerate(sccs(edges)):
            recursive = len(group) > 1 or group[0] in edges[group[0]]
            lines.append(f"  {i}: {', '.join(group)}{' (recursive)' if recursive else ''}")
            for n in group:
                k = [c for c in self.program.clauses if c.head.name == n]
                lines.append(f"     {n}: {sum(bool(c.body) for c in k)} rules, {sum(not c.body for c in k)} facts; reads {', '.join(sorted(edges[n])) or 'nothing'}")
        if self.log:
            lines += ["profile:", self.profile()]
        return "\n".join(lines)

    def profile(self) -> str:
        from .profiling import report

        return report(self.log)

    def close(self) -> None:
        """Deletes the run's tables."""
        if self.tables is not None:
            self.store.drop_all()
            self.tables = None


def evaluate(spark: SparkSession, text: str, inputs: dict[str, DataFrame], output: str, **options) -> DataFrame:
    """One relation of a program over DataFrames."""
    engine = Engine.from_source(text, spark, **options)
    for name, df in inputs.items():
        engine.set_input(name, df)
    return engine.run([output], lazy_outputs=True).df(output)
