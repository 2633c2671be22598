"""One rule body as one DataFrame plan.

Atoms become projections of their relations (constants and repeated variables filter, wildcards are pruned) that are
joined on shared variables in an order of our own: Catalyst reorders no joins without statistics, but it chooses the
algorithms, pushes the filters and prunes the columns. Atoms that bind nothing needed later are semi-joins, negations
anti-joins; equations bind, unpack or filter as soon as their inputs are there.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records, scalars
from ..language import ast as A
from ..language.checks import grounded
from ..language.types import ClauseTypes, TypeEnvironment
from .normalize import Bind, Names, Rule, rule

_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class Context:
    """What compiling needs besides the rule."""

    def __init__(self, spark: SparkSession, relations: dict[str, A.Relation], types: TypeEnvironment, bits: int, names: Names, ordinals: Callable, counter: Callable, is_set: Callable[[str], bool]):
        self.spark, self.relations, self.types, self.bits, self.names = spark, relations, types, bits, names
        self.ordinals, self.counter, self.is_set = ordinals, counter, is_set

    def sql_type(self, declared: str) -> str:
        return scalars.number_type(self.bits) if self.types.kind(declared) == "number" else "string"


class Body:
    """Grows a DataFrame whose columns are the variables bound so far (``v0``, ``v1`` ... by variable)."""

    def __init__(self, ctx: Context, r: Rule, source: Callable[[int, A.Atom], DataFrame], sizes: Callable[[int, A.Atom], float], types: ClauseTypes, keep: set[str], order: tuple | None = None, start: DataFrame | None = None, bound: set[str] = frozenset()):
        self.ctx, self.rule, self.source, self.sizes, self.types = ctx, r, source, sizes, types
        self.keep, self.fixed = keep, order
        self.cols: dict[str, str] = {}
        self.df = start
        self.bound = set(bound)
        self.todo_atoms = list(range(len(r.atoms)))
        self.todo = list(r.constraints)
        self.todo_binds = list(r.binds)
        self.todo_negations = list(r.negations)
        self.kinds: dict[str, str] = {}
        self.extremes: dict[int, tuple[str, str]] = {}

    # --- names
    def col(self, var: str) -> str:
        safe = "".join(ch if ch.isalnum() else "_" for ch in var)
        return self.cols.setdefault(var, f"v_{safe}_{len(self.cols)}" if var not in self.cols else "")

    def frame(self) -> DataFrame:
        if self.df is None:
            self.df = self.ctx.spark.range(1).select(F.lit(1).alias("__one"))
        return self.df

    # --- terms
    def ready(self, t) -> bool:
        return A.variables(t) <= self.bound and not any(isinstance(n, A.Wildcard) for n in A.walk(t))

    def expr(self, t) -> Column:
        if isinstance(t, A.Var):
            return F.col(self.col(t.name))
        if isinstance(t, A.Text):
            return F.lit(t.value)
        if isinstance(t, A.Num):
            return F.lit(t.value).cast(scalars.number_type(self.ctx.bits))
        if isinstance(t, A.Nil):
            return F.lit(records.NIL)
        if isinstance(t, A.Cast):
            return self.expr(t.arg)
        if isinstance(t, A.Record):
            return records.pack([self.expr(a) for a in t.args])
        if isinstance(t, A.Functor):
            if t.op == "neg":
                return scalars.negate(self.expr(t.args[0]), self.ctx.bits)
            if t.op == "cat":
                return F.concat(self.expr(t.args[0]), self.expr(t.args[1]))
            if t.op == "ord":
                return F.col(self.ordinal(t.args[0]))
            return scalars.arithmetic(t.op, self.expr(t.args[0]), self.expr(t.args[1]), self.ctx.bits)
        if isinstance(t, A.Counter):
            raise NotImplementedError("$ is only evaluated in heads and equations")
        raise TypeError(t)

    def ordinal(self, arg) -> str:
        """A column with the ordinal of a symbol, joined from the dictionary."""
        name = self.ctx.names.fresh("ord").name
        text, out = self.col(name + "text"), self.col(name)
        self.df = self.frame().withColumn(text, self.expr(arg))
        dictionary = self.ctx.ordinals(self.df.select(F.col(text).alias("symbol")))
        self.df = self.df.join(dictionary.select(F.col("symbol").alias(text), F.col("ordinal").cast(scalars.number_type(self.ctx.bits)).alias(out)), text, "inner").drop(text)
        return out

    # --- equations and filters
    def kind_of(self, t) -> str | None:
        return self.types.shape(t)

    def assign(self, var: str, value: Column) -> None:
        self.df = self.frame().withColumn(self.col(var), value)
        self.bound.add(var)

    def unpack(self, rec: A.Record, value: Column, declared: set[str] | None) -> None:
        """Binds and filters a record pattern against an encoded value."""
        d = next((self.ctx.types.decls[t] for t in declared or () if self.ctx.types.decls.get(t) and self.ctx.types.decls[t].kind == "record"), None)
        tail = self.ctx.names.fresh("tail").name
        self.df = self.frame().where(value != F.lit(records.NIL)).withColumn(self.col(tail), records.rest(value))
        for i, a in enumerate(rec.args):
            field_type = d.parts[i].type if d and i < len(d.parts) else None
            text = records.first_field(F.col(self.col(tail)))
            numeric = self.ctx.types.kind(field_type) == "number" if field_type else self.kind_of(a) == "number"
            field = text.try_cast(scalars.number_type(self.ctx.bits)) if numeric else text
            if isinstance(a, A.Var) and a.name not in self.bound:
                self.assign(a.name, field)
            elif isinstance(a, A.Record) and not self.ready(a):
                inner = self.ctx.names.fresh("field").name
                self.assign(inner, field)
                self.unpack(a, F.col(self.col(inner)), {field_type} if field_type else None)
            elif not isinstance(a, A.Wildcard):
                want = self.expr(a)
                self.df = self.df.where(field == want)
            if i + 1 < len(rec.args):
                self.df = self.df.withColumn(self.col(tail), records.after_first(F.col(self.col(tail))))
        self.df = self.df.drop(self.col(tail))

    def settle(self) -> None:
        """Everything that can be evaluated now."""
        again = True
        while again:
            again = False
            for c in list(self.todo):
                if self.equation(c):
                    self.todo.remove(c)
                    again = True
            for b in list(self.todo_binds):
                shared = self.shared(b)
                if shared <= self.bound:
                    self.todo_binds.remove(b)
                    self.aggregate(b, shared)
                    again = True
            for n in list(self.todo_negations):
                if A.variables(n.atom) <= self.bound:
                    self.todo_negations.remove(n)
                    self.negation(n.atom)
                    again = True

    def equation(self, c: A.Constraint) -> bool:
        if c.op == "=":
            waiting = {b.var for b in self.todo_binds}
            for a, b in ((c.left, c.right), (c.right, c.left)):
                while isinstance(a, A.Cast):
                    a = a.arg
                if isinstance(a, A.Var) and a.name not in self.bound and isinstance(b, A.Counter):
                    if self.todo_atoms or self.todo_negations or self.todo_binds or any(x is not c and not any(isinstance(n, A.Counter) for n in A.walk(x)) and A.variables(x) - {a.name} - self.bound == set() and a.name not in A.variables(x) for x in self.todo):
                        continue
                    self.df = self.ctx.counter(self.frame().distinct(), self.col(a.name))
                    self.bound.add(a.name)
                    return True
                if isinstance(a, A.Var) and a.name not in self.bound | waiting and not isinstance(b, A.Counter) and self.ready(b):
                    self.assign(a.name, self.expr(b))
                    return True
                if isinstance(a, A.Record) and not self.ready(a) and self.ready(b):
                    declared = self.types.of(b) if isinstance(b, (A.Var, A.Cast)) else None
                    if isinstance(b, A.Record):
                        if len(a.args) != len(b.args):
                            self.df = self.frame().where(F.lit(False))
                            return True
                        self.todo += [A.Constraint("=", x, y) for x, y in zip(a.args, b.args) if not isinstance(x, A.Wildcard)]
                        return True
                    self.unpack(a, self.expr(b), declared)
                    return True
        if not (self.ready(c.left) and self.ready(c.right)) or any(isinstance(n, A.Counter) for n in A.walk(c)):
            return False
        if c.op == "match":
            if isinstance(c.left, A.Text):
                if not scalars.valid_pattern(self.ctx.spark, c.left.value):
                    warnings.warn(f"wrong pattern provided for match(): {c.left.value}", stacklevel=2)
                    test = F.lit(False)
                else:
                    test = scalars.match_literal(c.left.value, self.expr(c.right))
            else:
                test = scalars.match_column(self.expr(c.left), self.expr(c.right))
        elif c.op == "contains":
            test = F.contains(self.expr(c.right), self.expr(c.left))
        else:
            left, right = self.expr(c.left), self.expr(c.right)
            test = getattr(left, _COMPARE[c.op])(right)
        self.df = self.frame().where(test)
        return True

    # --- atoms
    def project(self, df: DataFrame, atom: A.Atom, needed: set[str]) -> tuple[DataFrame, list[str]]:
        """The relation's rows that fit the atom, as columns of its needed variables."""
        place: dict[str, str] = {}
        for i, a in enumerate(atom.args):
            c = F.col(f"c{i}")
            if isinstance(a, A.Var):
                if a.name in place:
                    df = df.where(c == F.col(place[a.name]))
                else:
                    place[a.name] = f"c{i}"
            elif not isinstance(a, A.Wildcard):
                df = df.where(c == self.expr(a))
        names = [v for v in place if v in needed]
        return df.select(*[F.col(place[v]).alias(self.col(v)) for v in names]), names

    def wanted_later(self, skip: int | None = None) -> set[str]:
        out = set(self.keep)
        for i in self.todo_atoms:
            if i != skip:
                out |= A.variables(self.rule.atoms[i])
        for x in self.todo + self.todo_negations:
            out |= A.variables(x)
        for b in self.todo_binds:
            out |= self.shared(b) | {b.var}
        return out

    def prune(self) -> None:
        if self.df is None:
            return
        keep = [self.col(v) for v in sorted(self.bound & self.wanted_later())]
        if "__one" in self.df.columns or not keep:
            return
        if set(keep) != set(self.df.columns):
            self.df = self.df.select(*keep)
        self.bound &= self.wanted_later() | set()

    def join(self, i: int) -> None:
        atom = self.rule.atoms[i]
        own = A.variables(atom)
        later = self.wanted_later(skip=i)
        self.todo_atoms.remove(i)
        needed = own & (later | self.bound)
        right, names = self.project(self.source(i, atom), atom, needed)
        if i in self.extremes:
            var, op = self.extremes[i]
            others = [self.col(v) for v in names if v != var]
            best = (F.min if op == "min" else F.max)(self.col(var)).alias(self.col(var))
            right = (right.groupBy(*others).agg(best) if others else right.agg(best).where(F.col(self.col(var)).isNotNull())).select(*[self.col(v) for v in names])
        shared = [v for v in names if v in self.bound]
        new = [v for v in names if v not in self.bound]
        if self.df is None:
            self.df = right if names else right.limit(1).select(F.lit(1).alias("__one"))
        elif not new:
            if shared:
                self.df = self.df.join(right, [self.col(v) for v in shared], "left_semi")
            else:
                self.df = self.df.join(right.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_semi")
        elif shared:
            self.df = self.df.join(right, [self.col(v) for v in shared], "inner")
        else:
            self.df = self.df.crossJoin(right)
        self.bound |= set(names)

    def negation(self, atom: A.Atom) -> None:
        df, on = self.ctx_source(atom), []
        left = self.frame()
        right_cols = []
        for i, a in enumerate(atom.args):
            if isinstance(a, A.Wildcard):
                continue
            if isinstance(a, (A.Text, A.Num, A.Nil)):
                df = df.where(F.col(f"c{i}") == self.expr(a))
                continue
            name = f"__n{i}"
            value = self.expr(a)
            left = self.df = self.df.withColumn(f"__k{i}", value) if not isinstance(a, A.Var) else self.df
            key = F.col(f"__k{i}") if not isinstance(a, A.Var) else F.col(self.col(a.name))
            right_cols.append(F.col(f"c{i}").alias(name))
            on.append((key, name))
        left = self.frame()
        if on:
            right = df.select(*right_cols)
            test = None
            for key, name in on:
                t = key == F.col(name)
                test = t if test is None else test & t
            out = left.join(right, test, "left_anti")
        else:
            out = left.join(df.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")
        self.df = out.drop(*[c for c in out.columns if c.startswith("__k")])

    def ctx_source(self, atom: A.Atom) -> DataFrame:
        return self.source(-1, atom)

    # --- aggregates
    def shared(self, b: Bind) -> set[str]:
        """The aggregate's variables that occur elsewhere in the clause."""
        inner = set().union(*(A.variables(x) for x in b.aggregate.body))
        others = A.variables(self.rule.head)
        for x in (*self.rule.atoms, *self.rule.constraints, *self.rule.negations):
            others |= A.variables(x)
        return inner & (others | self.keep)

    def aggregate(self, b: Bind, shared: set[str]) -> None:
        agg, ctx = b.aggregate, self.ctx
        body = agg.body
        if agg.op == "count":  # a wildcard is a counted column
            body = tuple(A.Atom(x.name, tuple(ctx.names.fresh("w") if isinstance(a, A.Wildcard) else a for a in x.args), x.pos) if isinstance(x, A.Atom) else x for x in body)
        inner_rule = rule(A.Clause(A.Atom("", ()), body), ctx.names)
        all_vars = set().union(*(A.variables(x) for x in body))
        want = all_vars if agg.op == "count" else shared | A.variables(agg.target)
        alone = shared <= grounded(body)
        start = None if alone else self.df.select(*[self.col(v) for v in sorted(shared)]).distinct()
        sub = Body(ctx, inner_rule, lambda i, a: self.source(-1, a), lambda i, a: self.sizes(-1, a), self.types, want | shared, None, start, set() if alone else set(shared))
        sub.cols = self.cols
        if agg.op != "count" and ctx.bits == 64:
            sub.extremes = extremes(inner_rule, agg.op, agg.target, shared)
        df = sub.run()
        keys = [self.col(v) for v in sorted(shared)]
        out = self.col(b.var)
        kind = scalars.number_type(ctx.bits)
        if agg.op == "count":
            single = len(body) == 1 and isinstance(body[0], A.Atom) and len(set(body[0].args)) == len(body[0].args) and ctx.is_set(body[0].name)
            rows = df if single else df.distinct()
            value = F.count(F.lit(1)).cast(kind).alias(out)
        else:
            value = (F.min if agg.op == "min" else F.max)(sub.expr(agg.target)).cast(kind).alias(out)
            rows = sub.df
        if keys:
            result = rows.groupBy(*keys).agg(value)
            if agg.op == "count":
                self.df = self.df.join(result, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast(kind)))
            else:
                self.df = self.df.join(result, keys, "inner")
        else:
            result = rows.agg(value)
            if agg.op != "count":
                result = result.where(F.col(out).isNotNull())
            self.df = self.frame().crossJoin(result)
        self.bound.add(b.var)

    # --- order
    def pick(self) -> int:
        if self.fixed is not None:
            return next(i for i in self.fixed if i in self.todo_atoms)

        def cost(i: int):
            atom = self.rule.atoms[i]
            own = A.variables(atom)
            constants = sum(not isinstance(a, (A.Var, A.Wildcard)) for a in atom.args)
            linked = len(own & self.bound)
            if linked == 0 and self.bound:
                # an equation may link it: A(i), B(i + 1)
                linked = 0.5 * any(c.op == "=" and A.variables(c) & own and A.variables(c) & self.bound for c in self.todo)
            return (not linked if self.bound else 0, -linked, -constants, self.sizes(i, atom), i)

        return min(self.todo_atoms, key=cost)

    def run(self, first: int | None = None) -> DataFrame:
        self.settle()
        if first is not None and self.fixed is None:
            self.join(first)
            self.settle()
            self.prune()
        while self.todo_atoms:
            self.join(self.pick())
            self.settle()
            self.prune()
        self.settle()
        left = [x for x in (*self.todo, *self.todo_binds, *self.todo_negations) if not isinstance(x, A.Constraint) or not any(isinstance(n, A.Counter) for n in A.walk(x))]
        if left:
            raise ValueError(f"cannot evaluate {left[0]}: a variable is not bound")
        return self.frame().select(*[self.col(v) for v in sorted(self.keep & self.bound)]) if self.keep & self.bound else self.frame()


def direction(t, var: str) -> int | None:
    """1 if a term grows (or stays) with ``var``, -1 if it falls, 0 if ``var`` isn't in it, None if that isn't known."""
    if var not in A.variables(t):
        return 0
    if isinstance(t, A.Var):
        return 1
    if isinstance(t, A.Functor) and t.op in ("neg", "+", "-"):
        signs = (-1,) if t.op == "neg" else (1, 1 if t.op == "+" else -1)
        found = [None if (d := direction(a, var)) is None else d * sign for a, sign in zip(t.args, signs)]
        if None not in found and not {1, -1} <= set(found):
            return next(d for d in found if d)
    return None


def extremes(r: Rule, op: str, target, shared: set[str]) -> dict[int, tuple[str, str]]:
    """Atoms of a min or max aggregate's body of which, for equal other variables, one value of a variable decides:
    {atom: (variable, "min" or "max")}. The variable is in no other atom, moves the target one way, and every
    comparison that it is in holds more easily that way: of c > s the largest c is enough for the largest c + s. Without
    it, all pairs of c and s would be made."""
    out: dict[int, tuple[str, str]] = {}
    if r.negations or r.binds or len(r.atoms) < 2:
        return out
    for i, atom in enumerate(r.atoms):
        for a in atom.args:
            if not isinstance(a, A.Var) or a.name in shared or i in out:
                continue
            v = a.name
            if sum(x == a for b in r.atoms for x in b.args) != 1 or not (way := direction(target, v)):
                continue
            want = way if op == "max" else -way
            for c in r.constraints:
                if v not in A.variables(c):
                    continue
                sides = direction(c.left, v), direction(c.right, v)
                greater = {">": 1, ">=": 1, "<": -1, "<=": -1}.get(c.op)
                if greater is None or None in sides or {want * greater * sides[0], -want * greater * sides[1]} - {0, 1}:
                    break
            else:
                out[i] = (v, "max" if want > 0 else "min")
    return out


def compile_rule(ctx: Context, r: Rule, source, sizes, version: int = 0, first: int | None = None) -> DataFrame:
    """The head's tuples (c0, c1, ...), not yet distinct."""
    types = ClauseTypes(r.source, ctx.relations, ctx.types)
    body = Body(ctx, r, source, sizes, types, A.variables(r.head), r.order(version))
    body.run(first)
    relation = ctx.relations[r.head.name]
    out = []
    for i, (a, at) in enumerate(zip(r.head.args, relation.attributes)):
        if any(isinstance(n, A.Counter) for n in A.walk(a)):
            name = ctx.names.fresh("count").name
            body.df = ctx.counter(body.frame().distinct(), body.col(name))
            a = A.rebuild(a, lambda n, name=name: A.Var(name) if isinstance(n, A.Counter) else n)
            body.bound.add(name)
        value = body.expr(a)
        out.append((i, value, ctx.sql_type(at.type)))
    return body.frame().select(*[v.cast(t).alias(f"c{i}") for i, v, t in out])


#: Combinations that one task of :func:`wide_pairs` makes, about.
PAIRS = 4_000_000


def wide_pairs(ctx: Context, r: Rule, source) -> DataFrame | None:
    """The head's distinct tuples of a rule that pairs two atoms over variables which the head drops, where few values
    of those stand for very many pairs; None for other rules and few pairs.

    Rows of a value are spread by a hash of the first atom's side, which the second's meet in each part, so that tasks
    stay as long however many pairs there are. Pairs aren't compared with each other to be distinct: of a first side
    that is there with one value only, they can't repeat; others are made apart."""
    head = [a.name for a in r.head.args if isinstance(a, A.Var)]
    if len(r.atoms) != 2 or r.negations or r.binds or r.order(0) is not None or len(set(head)) != len(r.head.args):
        return None
    own = [A.variables(a) for a in r.atoms]
    joint, names = own[0] & own[1], set(head)
    if not joint or joint & names or not names <= own[0] | own[1] or not all(names & o for o in own):
        return None
    if any(not A.variables(c) <= names or any(isinstance(n, A.Counter) or isinstance(n, A.Functor) and n.op == "ord" for n in A.walk(c)) for c in r.constraints):
        return None
    body = Body(ctx, r, source, lambda i, a: 0, ClauseTypes(r.source, ctx.relations, ctx.types), names)
    left, right = (body.project(source(i, a), a, (names | joint) & own[i])[0].distinct() for i, a in enumerate(r.atoms))
    keys, first = [body.col(v) for v in sorted(joint)], [body.col(v) for v in head if v in own[0]]
    sizes = left.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).join(right.groupBy(*keys).agg(F.count("*").cast("double").alias("m")), keys)
    total, most = sizes.agg(F.sum(F.col("n") * F.col("m")), F.max(F.col("n") * F.col("m"))).first()
    if not total or total <= PAIRS:
        return None
    salts, parts = int(most // PAIRS) + 1, min(20_000, 2 * int(total // PAIRS) + 2)
    left = left.withColumn("__values", F.count("*").over(Window.partitionBy(*first)))
    left = left.withColumn("__part", F.pmod(F.xxhash64(*first), F.lit(salts)).cast("int"))
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, *keys, "__part")

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, *keys, "__part").join(right, [*keys, "__part"]).select(*[body.col(v) for v in head])

    body.df = meet(left.where("__values = 1")).unionByName(meet(left.where("__values > 1")).distinct())
    body.bound, body.todo_atoms = names, []
    body.settle()
    if body.todo:
        return None
    return body.df.select(*[F.col(body.col(v)).cast(ctx.sql_type(at.type)).alias(f"c{i}") for i, (v, at) in enumerate(zip(head, ctx.relations[r.head.name].attributes))])
