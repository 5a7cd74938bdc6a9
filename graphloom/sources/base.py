"""What a source of quads offers the compiler."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Protocol

from graphloom.functions.values import Val
from graphloom.operators.relation import Rel
from graphloom.plans.algebra import Triple


@dataclass(frozen=True)
class Active:
    """The graphs a pattern is matched in.

    graphs: None for the source's default graph (or, with `named`, all named graphs), else these, merged. var: the GRAPH variable.
    """

    graphs: tuple[str, ...] | None = None
    named: bool = False
    var: str | None = None

    def with_var(self, var: str | None) -> Active:
        return replace(self, var=var)


class QuadSource(Protocol):
    def groups(self, triples: Iterable[Triple]) -> list[list[Triple]]:
        """Triples that one scan can answer together, in order."""

    def scan(self, triples: list[Triple], active: Active, wanted: set[str]) -> Rel:
        """Matches of one group; of its variables, those in `wanted` are needed."""

    def nodes(self, active: Active) -> Rel:
        """Distinct subjects and objects as ?node, with the GRAPH variable if there is one."""

    def types(self, subject: Val, active: Active) -> Rel:
        """Subjects ?s and their types ?o; those that can't be equal to `subject` may be left out."""
