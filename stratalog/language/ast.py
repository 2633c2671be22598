"""Syntax tree of a program. Nodes are immutable values, so equal terms are one term."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pos:
    file: str = "<program>"
    line: int = 0
    col: int = 0


NOWHERE = Pos()


@dataclass(frozen=True)
class Var:
    name: str
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Wildcard:
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Counter:
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Text:
    value: str
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Num:
    value: int
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Nil:
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Functor:
    """``+ - * / % ^ cat`` of two arguments, ``neg`` and ``ord`` of one."""

    op: str
    args: tuple
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Record:
    args: tuple
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Cast:
    arg: object
    type: str
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Aggregate:
    op: str
    target: object
    body: tuple
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Negation:
    atom: Atom
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Constraint:
    """``= != < <= > >= match contains``; for the last two the first argument is the pattern or part."""

    op: str
    left: object
    right: object
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Clause:
    head: Atom
    body: tuple = ()
    strict: bool = False
    plans: tuple = ()
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Relation:
    name: str
    attributes: tuple
    qualifiers: frozenset = frozenset()
    pos: Pos = field(default=NOWHERE, compare=False)

    @property
    def arity(self) -> int:
        return len(self.attributes)


@dataclass(frozen=True)
class TypeDecl:
    """kind: number, symbol, union (``parts`` are member names) or record (``parts`` are attributes)."""

    name: str
    kind: str
    parts: tuple = ()
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class ComponentType:
    name: str
    params: tuple = ()
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Init:
    name: str
    type: ComponentType
    pos: Pos = field(default=NOWHERE, compare=False)


@dataclass
class Component:
    type: ComponentType
    bases: list = field(default_factory=list)
    relations: list = field(default_factory=list)
    clauses: list = field(default_factory=list)
    overrides: list = field(default_factory=list)
    components: list = field(default_factory=list)
    inits: list = field(default_factory=list)
    pos: Pos = NOWHERE


@dataclass
class Program:
    types: list = field(default_factory=list)
    relations: list = field(default_factory=list)
    clauses: list = field(default_factory=list)
    components: list = field(default_factory=list)
    inits: list = field(default_factory=list)


def children(node) -> tuple:
    """Direct parts of an argument or literal."""
    if isinstance(node, (Functor, Record, Atom)):
        return node.args
    if isinstance(node, Cast):
        return (node.arg,)
    if isinstance(node, Aggregate):
        return (() if node.target is None else (node.target,)) + node.body
    if isinstance(node, Negation):
        return (node.atom,)
    if isinstance(node, Constraint):
        return (node.left, node.right)
    if isinstance(node, Clause):
        return (node.head, *node.body)
    return ()


def walk(node):
    """The node and all its descendants, aggregates' bodies included."""
    yield node
    for c in children(node):
        yield from walk(c)


def rebuild(node, f):
    """The node with ``f`` applied to its parts, then to itself."""
    from dataclasses import replace

    if isinstance(node, (Functor, Record, Atom)):
        node = replace(node, args=tuple(rebuild(a, f) for a in node.args))
    elif isinstance(node, Cast):
        node = replace(node, arg=rebuild(node.arg, f))
    elif isinstance(node, Aggregate):
        node = replace(node, target=None if node.target is None else rebuild(node.target, f), body=tuple(rebuild(b, f) for b in node.body))
    elif isinstance(node, Negation):
        node = replace(node, atom=rebuild(node.atom, f))
    elif isinstance(node, Constraint):
        node = replace(node, left=rebuild(node.left, f), right=rebuild(node.right, f))
    elif isinstance(node, Clause):
        node = replace(node, head=rebuild(node.head, f), body=tuple(rebuild(b, f) for b in node.body))
    return f(node)


def variables(node) -> set[str]:
    return {n.name for n in walk(node) if isinstance(n, Var)}
