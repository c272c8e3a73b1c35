"""The algebra that queries and updates are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field

from quadrille.terms import Term


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Quoted:
    """A quoted triple with variables."""

    s: Node
    p: Node
    o: Node


Node = Var | Term | Quoted


# --- expressions -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Call:
    """A function, operator or cast by name (upper case, or an IRI)."""

    name: str
    args: tuple
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


Expr = Var | Term | Call | Exists | Quoted

# --- property paths ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """path?, path* or path+."""

    path: object
    zero: bool
    many: bool


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# --- patterns ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Triple:
    s: Node
    p: object  # Node or path
    o: Node


@dataclass(frozen=True)
class Bgp:
    triples: tuple


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    condition: object
    pattern: object


@dataclass(frozen=True)
class Extend:
    pattern: object
    var: str
    expr: object


@dataclass(frozen=True)
class Values:
    names: tuple
    rows: tuple  # of tuples of Term or None


@dataclass(frozen=True)
class Graph:
    name: Node
    pattern: object


@dataclass(frozen=True)
class Service:
    silent: bool


@dataclass(frozen=True)
class Select:
    """A whole (sub)query; items are (name, expression or None)."""

    pattern: object
    items: tuple | None  # None: *
    distinct: bool = False
    reduced: bool = False
    group: tuple = ()  # of (name or None, expression)
    grouped: bool = False
    having: tuple = ()
    order: tuple = ()  # of (expression, descending)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None


@dataclass(frozen=True)
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    select: Select
    default: tuple = ()
    named: tuple = ()
    template: tuple = ()
    targets: tuple | None = ()


# --- updates -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Modify:
    delete: tuple = ()  # of (graph node or None, Triple)
    insert: tuple = ()
    pattern: object = None
    default: tuple = ()
    named: tuple = ()
    using: bool = False


@dataclass(frozen=True)
class Manage:
    """CLEAR, DROP, CREATE, ADD, COPY, MOVE; graphs are an IRI, 'DEFAULT', 'NAMED' or 'ALL'."""

    op: str
    source: str
    target: str = ""
    silent: bool = False


@dataclass(frozen=True)
class Load:
    silent: bool


@dataclass
class Prologue:
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str = ""


def variables(x: object) -> set[str]:
    """Names of the variables that a pattern or node may bind."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (Quoted, Triple)):
        return variables(x.s) | variables(x.p) | variables(x.o)
    if isinstance(x, Bgp):
        return set().union(*map(variables, x.triples)) if x.triples else set()
    if isinstance(x, (Join, LeftJoin, Union)):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Minus):
        return variables(x.left)
    if isinstance(x, Filter):
        return variables(x.pattern)
    if isinstance(x, Extend):
        return variables(x.pattern) | {x.var}
    if isinstance(x, Values):
        return set(x.names)
    if isinstance(x, Graph):
        return variables(x.pattern) | variables(x.name)
    if isinstance(x, Select):
        own = variables(x.pattern) | (set(x.values.names) if x.values else set())
        return {n for n in own if not n.startswith(".")} if x.items is None else {n for n, _ in x.items}
    return set()
