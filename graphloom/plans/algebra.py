"""SPARQL algebra."""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.terms import Term


@dataclass(frozen=True)
class Var:
    name: str


Node = Var | Term


# Expressions
@dataclass(frozen=True)
class Call:
    """An operator or function; `name` is upper-case for built-ins and an IRI for others."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object = None
    distinct: bool = False
    separator: str = " "


Expression = Var | Term | Call | Exists | Aggregate


# Paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    left: object
    right: object


@dataclass(frozen=True)
class Alternative:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    """zero: also the empty path; many: more than one step."""

    path: object
    zero: bool
    many: bool


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]
    has_forward: bool = True


# Patterns
@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node


@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...] = ()


@dataclass(frozen=True)
class Path:
    s: Node
    path: object
    o: Node


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
    name: str
    expression: object


@dataclass(frozen=True)
class Graph:
    name: Node
    pattern: object


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Group:
    pattern: object
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class OrderBy:
    pattern: object
    keys: tuple[tuple[object, bool], ...]  # (expression, descending)


@dataclass(frozen=True)
class Project:
    pattern: object
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    pattern: object


@dataclass(frozen=True)
class Reduced:
    pattern: object


@dataclass(frozen=True)
class Slice:
    pattern: object
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    pattern: object
    template: tuple[Triple, ...] = ()
    describe: tuple[Node, ...] = ()
    default_graphs: tuple[str, ...] | None = None
    named_graphs: tuple[str, ...] | None = None
    base: str | None = None
    names: tuple[str, ...] = field(default=())


def children(x) -> list:
    """The parts of an algebra node or expression that may hold variables."""
    if isinstance(x, (tuple, list)):
        return list(x)
    if hasattr(x, "__dataclass_fields__") and type(x).__module__ == __name__:
        return [getattr(x, f) for f in x.__dataclass_fields__]
    return []


def mentioned(x, out: dict[str, int] | None = None) -> dict[str, int]:
    """How often each variable is named anywhere below `x`."""
    out = {} if out is None else out
    if isinstance(x, Var):
        out[x.name] = out.get(x.name, 0) + 1
    elif isinstance(x, Extend):
        out[x.name] = out.get(x.name, 0) + 1
    for name in getattr(x, "names", ()) if isinstance(x, (Project, Values)) else getattr(x, "keys", ()) if isinstance(x, Group) else ():
        out[name] = out.get(name, 0) + 1
    if not isinstance(x, Var):
        for c in children(x):
            mentioned(c, out)
    return out


def in_scope(x) -> list[str]:
    """Visible variables of a pattern, in order of first appearance."""
    out: dict[str, None] = {}

    def add(names) -> None:
        for n in names:
            out.setdefault(n)

    match x:
        case BGP(triples):
            for t in triples:
                add(n.name for n in (t.s, t.p, t.o) if isinstance(n, Var))
        case Path(s, _, o):
            add(n.name for n in (s, o) if isinstance(n, Var))
        case Join(a, b) | Union(a, b):
            add(in_scope(a))
            add(in_scope(b))
        case LeftJoin(a, b, _):
            add(in_scope(a))
            add(in_scope(b))
        case Minus(a, _):
            add(in_scope(a))
        case Filter(_, p) | Distinct(p) | Reduced(p) | Slice(p, _, _) | OrderBy(p, _):
            add(in_scope(p))
        case Extend(p, name, _):
            add(in_scope(p))
            add([name])
        case Graph(name, p):
            add([name.name] if isinstance(name, Var) else [])
            add(in_scope(p))
        case Values(names, _) | Project(_, names):
            add(names)
        case Group(_, keys, aggregates):
            add(keys)
            add(n for n, _ in aggregates)
    return [n for n in out if not n.startswith("?")]
