"""Queries without text: a fluent builder over the algebra."""

from __future__ import annotations

from dataclasses import dataclass

from graphloom.plans import algebra as A
from graphloom.terms import XSD, IRI, Literal, Term


def var(name: str) -> A.Var:
    return A.Var(name.lstrip("?$"))


def iri(value: str) -> IRI:
    return IRI(value)


def lit(value) -> Literal:
    if isinstance(value, bool):
        return Literal("true" if value else "false", XSD + "boolean")
    if isinstance(value, int):
        return Literal(str(value), XSD + "integer")
    return Literal(repr(value), XSD + "double") if isinstance(value, float) else Literal(value)


def call(name: str, *args) -> A.Call:
    """An operator or function: `call("<", var("x"), lit(3))`, `call("STRLEN", var("s"))`."""
    return A.Call(name, args)


@dataclass(frozen=True)
class Plan:
    pattern: object = A.BGP()

    @staticmethod
    def of(*triples: tuple) -> Plan:
        return Plan(A.BGP(tuple(A.Triple(*t) for t in triples)))

    @staticmethod
    def path(s, path, o) -> Plan:
        return Plan(A.Path(s, path, o))

    @staticmethod
    def values(names: list[str], rows: list[tuple[Term | None, ...]]) -> Plan:
        return Plan(A.Values(tuple(names), tuple(rows)))

    def join(self, other: Plan) -> Plan:
        return Plan(A.Join(self.pattern, other.pattern))

    def left_join(self, other: Plan, condition=None) -> Plan:
        return Plan(A.LeftJoin(self.pattern, other.pattern, condition))

    def union(self, other: Plan) -> Plan:
        return Plan(A.Union(self.pattern, other.pattern))

    def minus(self, other: Plan) -> Plan:
        return Plan(A.Minus(self.pattern, other.pattern))

    def filter(self, condition) -> Plan:
        return Plan(A.Filter(condition, self.pattern))

    def extend(self, name: str, expression) -> Plan:
        return Plan(A.Extend(self.pattern, name, expression))

    def exists(self, other: Plan, negated: bool = False) -> Plan:
        return self.filter(A.Exists(other.pattern, negated))

    def group(self, keys: list[str], **aggregates: A.Aggregate) -> Plan:
        return Plan(A.Group(self.pattern, tuple(keys), tuple(aggregates.items())))

    def order(self, *keys) -> Plan:
        """Each key an expression, or (expression, True) for descending."""
        return Plan(A.OrderBy(self.pattern, tuple(k if isinstance(k, tuple) else (k, False) for k in keys)))

    def project(self, *names: str) -> Plan:
        return Plan(A.Project(self.pattern, names))

    def distinct(self) -> Plan:
        return Plan(A.Distinct(self.pattern))

    def slice(self, offset: int = 0, limit: int | None = None) -> Plan:
        return Plan(A.Slice(self.pattern, offset, limit))

    def query(self) -> A.Query:
        """For Engine.query."""
        return A.Query("SELECT", self.pattern, names=tuple(A.in_scope(self.pattern)))
