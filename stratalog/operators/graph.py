"""Recursive operators over DataFrames of pairs, each a small program."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine


def _kind(df: DataFrame) -> tuple[str, int]:
    names = {f.dataType.simpleString() for f in df.schema}
    if names <= {"string"}:
        return "symbol", 32
    if names <= {"tinyint", "smallint", "int"}:
        return "number", 32
    if names <= {"tinyint", "smallint", "int", "bigint"}:
        return "number", 64
    raise TypeError("pairs must be two integers or two strings")


def _run(text: str, output: str, bits: int, **inputs: DataFrame) -> DataFrame:
    df = next(iter(inputs.values()))
    engine = Engine.from_source(text, df.sparkSession, number_bits=bits)
    for name, frame in inputs.items():
        engine.set_input(name, frame)
    return engine.run([output]).df(output)


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (a, b) with a path of one edge or more from a to b."""
    t, bits = _kind(edges)
    return _run(f".decl e(a:{t}, b:{t}) input .decl p(a:{t}, b:{t}) p(x,y) :- e(x,y). p(x,z) :- p(x,y), e(y,z).", "p", bits, e=edges)


def connected(edges: DataFrame) -> DataFrame:
    """All (a, b) of one component, edges read both ways; a node with an edge is connected with itself."""
    t, bits = _kind(edges)
    return _run(f".decl e(a:{t}, b:{t}) input .decl u(a:{t}, b:{t}) u(x,y) :- e(x,y). u(y,x) :- e(x,y). .decl p(a:{t}, b:{t}) p(x,y) :- u(x,y). p(x,z) :- p(x,y), u(y,z).", "p", bits, e=edges)


def same_generation(up: DataFrame, flat: DataFrame, down: DataFrame) -> DataFrame:
    """Pairs that ``flat`` has, or whose ancestors by ``up`` and ``down`` are such a pair."""
    t, bits = _kind(up)
    return _run(f".decl up(a:{t}, b:{t}) input .decl flat(a:{t}, b:{t}) input .decl down(a:{t}, b:{t}) input .decl sg(a:{t}, b:{t}) sg(x,y) :- flat(x,y). sg(x,y) :- up(x,a), sg(a,b), down(b,y).", "sg", bits, up=up, flat=flat, down=down)
