"""Quads of any RDF data: a DataFrame of (graph, subject, predicate, object) terms; a null graph is the default graph."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import Val, of_term, same
from graphloom.operators.relation import Rel, build
from graphloom.plans.algebra import Triple, Var
from graphloom.sources.base import Active
from graphloom.terms import IRI, RDF_TYPE, TERM_DDL, Term


def folder_column() -> Column:
    """The folder of a quad's predicate in written stores."""
    return F.sha2("predicate.lex", 256).substr(1, 8)


def folder_of(predicate: str) -> str:
    return sha256(predicate.encode()).hexdigest()[:8]


class QuadTableSource:
    """`union_default`: the default graph is all graphs merged. `files`: the same quads as written, with a column `p` of their folders."""

    def __init__(self, quads: DataFrame, union_default: bool = False, files: DataFrame | None = None):
        self.quads, self.union_default, self.files = quads, union_default, files

    def groups(self, triples: Iterable[Triple]) -> list[list[Triple]]:
        return [[t] for t in triples]

    def _active(self, active: Active, predicate=None) -> DataFrame:
        q = self.quads
        if self.files is not None and isinstance(predicate, IRI):  # one folder, of which Spark knows the size
            q = self.files.filter(F.col("p") == folder_of(predicate.value)).drop("p")
        if active.named:
            q = q.filter(F.col("graph").isNotNull())
            return q.filter(F.col("graph.lex").isin(list(active.graphs))) if active.graphs is not None else q
        if active.graphs is not None:
            q = q.filter(F.col("graph.lex").isin(list(active.graphs)))
            return q if len(active.graphs) == 1 else self._merged(q)
        return self._merged(q) if self.union_default else q.filter(F.col("graph").isNull())

    @staticmethod
    def _merged(q: DataFrame) -> DataFrame:
        """One triple each, whatever graphs it is in."""
        return q.select("subject", "predicate", "object").distinct().select(F.lit(None).cast(TERM_DDL).alias("graph"), "*")

    def scan(self, triples: list[Triple], active: Active, wanted: set[str]) -> Rel:
        (t,) = triples
        q, vals = self._active(active, t.p), {}
        nodes = [(active.var and Var(active.var), "graph"), (t.s, "subject"), (t.p, "predicate"), (t.o, "object")]
        for node, column in nodes:
            if not node:
                continue
            v = Val("iri", F.col(f"{column}.lex")) if column in ("graph", "predicate") else Val("term", F.col(column))
            if not isinstance(node, Var):
                if v.type == "term":  # single fields, which scans can test
                    kind, lex, dt, lang = node.row()
                    q = q.filter((F.col(f"{column}.lex") == lex) & (F.col(f"{column}.kind") == kind))
                q = q.filter(same(v, of_term(node)))
            elif node.name in vals:
                q = q.filter(same(vals[node.name], v))
            else:
                vals[node.name] = v
        return build(q, vals, vals.keys())

    def nodes(self, active: Active) -> Rel:
        q = self._active(active)
        df = q.select("graph", F.explode(F.array("subject", "object")).alias("node"))
        vals = {"?node": Val("term", F.col("node"))} | ({active.var: Val("iri", F.col("graph.lex"))} if active.var else {})
        rel = build(df, vals, vals.keys())
        return Rel(rel.df.distinct(), rel.vars, rel.bound)

    def types(self, subject: Val, active: Active) -> Rel:
        return self.scan([Triple(Var("?s"), IRI(RDF_TYPE), Var("?o"))], active, {"?s", "?o"})

    # Quad patterns of the API: blank nodes are constants here
    def matching(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None | str = "any") -> DataFrame:
        q = self.quads
        for node, column in ((s, "subject"), (p, "predicate"), (o, "object")):
            if node is not None:
                q = q.filter(same(Val("term", F.col(column)), of_term(node)))
        if g is None:
            q = q.filter(F.col("graph").isNull())
        elif g != "any":
            q = q.filter(same(Val("term", F.col("graph")), of_term(g)))
        return q
