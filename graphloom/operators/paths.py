"""Property paths as relations ?ps -> ?po (and the GRAPH variable, so that a path stays in one graph)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import Val, common, of_term, same
from graphloom.operators import relation as R
from graphloom.operators.relation import Rel, build
from graphloom.operators.written import drop, write
from graphloom.plans import algebra as A
from graphloom.sources.base import Active, QuadSource
from graphloom.terms import IRI

S, O = "?ps", "?po"


class Paths:
    def __init__(self, spark, source: QuadSource):
        self.spark, self.source = spark, source

    def match(self, s, path, o, active: Active) -> Rel:
        """The relation of `path` between two nodes, as solutions of their variables."""
        rel = self.walk(path, active, None if isinstance(s, A.Var) else s, None if isinstance(o, A.Var) else o)
        vals, df = {n: v for n, v in rel.vars.items() if n not in (S, O)}, rel.df
        for node, name in ((s, S), (o, O)):
            if not isinstance(node, A.Var):
                df = df.filter(same(rel.vars[name], of_term(node)))
            elif node.name in vals:
                df = df.filter(same(vals[node.name], rel.vars[name]))
            else:
                vals[node.name] = rel.vars[name]
        return build(df, vals, vals.keys())

    def walk(self, path, active: Active, start=None, end=None) -> Rel:
        """`start` and `end`: constants at the ends, where known; they narrow closures and add their own empty path."""
        match path:
            case A.Link(iri):
                return self.source.scan([A.Triple(A.Var(S), IRI(iri), A.Var(O))], active, {S, O})
            case A.Inverse(p):
                return self.walk(p, active, end, start).renamed({S: O, O: S})
            case A.Sequence(a, b):
                left, right = self.walk(a, active, start, None).renamed({O: "?mid"}), self.walk(b, active, None, end).renamed({S: "?mid"})
                met = R.join(left, right)
                return met.keep([n for n in met.vars if n != "?mid"])
            case A.Alternative(a, b):
                return R.union([self.walk(a, active, start, end), self.walk(b, active, start, end)])
            case A.Negated(forward, backward, has_forward):
                parts = []
                if has_forward:
                    parts.append(self._other(forward, active))
                if backward:
                    parts.append(self._other(backward, active).renamed({S: O, O: S}))
                return R.union(parts)
            case A.Repeat(p, zero, many):
                steps = self._distinct(self.walk(p, active, None if many else start, None if many else end))
                if many:
                    steps = self._closure(steps, start, end)
                return self._distinct(R.union([steps, self._empty(active, start, end)])) if zero else steps
        raise NotImplementedError(type(path).__name__)

    def _other(self, iris: tuple[str, ...], active: Active) -> Rel:
        rel = self.source.scan([A.Triple(A.Var(S), A.Var("?pp"), A.Var(O))], active, {S, "?pp", O})
        p = rel.vars["?pp"].col
        return (rel.filter(~p.isin(list(iris))) if iris else rel).keep([n for n in rel.vars if n != "?pp"])

    @staticmethod
    def _distinct(rel: Rel) -> Rel:
        return R.distinct(rel)

    def _empty(self, active: Active, start, end) -> Rel:
        """Every node with itself; a constant end needs only itself, present in the data or not."""
        fixed = [t for t in (start, end) if t is not None]
        if fixed and not active.var:
            df = self.spark.range(1)
            if len(fixed) == 2 and fixed[0] != fixed[1]:
                df = df.limit(0)
            v = of_term(fixed[0])
            return build(df, {S: Val(v.type, v.col, v.extra), O: Val(v.type, v.col, v.extra)}, {S, O})
        nodes = self.source.nodes(active)
        vals = {S: nodes.vars["?node"], O: nodes.vars["?node"]} | {n: v for n, v in nodes.vars.items() if n != "?node"}
        return build(nodes.df, vals, vals.keys())

    def _closure(self, edges: Rel, start, end) -> Rel:
        """Pairs joined by one or more edges: semi-naive rounds on written tables until no pair is new.

        With a constant start only what it reaches is followed (with a constant end, what reaches it).
        """
        if start is None and end is not None:
            return self._closure(edges.renamed({S: O, O: S}), end, None).renamed({S: O, O: S})
        graph = [n for n in edges.vars if n not in (S, O)]
        a, b = common([edges.vars[S], edges.vars[O]])
        cols = [a.col.alias("s"), b.col.alias("o"), *(edges.vars[n].col.alias("g") for n in graph)]
        step, step_path = write(edges.df.select(*cols))
        keys = ["s", "o", "g"] if graph else ["s", "o"]
        first = step if start is None else step.filter(same(Val(a.type, F.col("s"), a.extra), of_term(start)))
        found: list[tuple[DataFrame, str]] = [write(first.distinct())]
        while True:
            new = found[-1][0]
            hop = step.select(F.col("s").alias("m"), F.col("o").alias("to"), *([F.col("g").alias("mg")] if graph else []))
            on = new["o"] == hop["m"]
            if graph:
                on = on & (new["g"] == hop["mg"])
            reached = new.join(hop, on).select("s", F.col("to").alias("o"), *(["g"] if graph else [])).distinct()
            for seen, _ in found:
                reached = reached.join(seen, keys, "left_anti")
            after, path = write(reached)
            if not after.take(1):
                drop(self.spark, path)
                break
            found.append((after, path))
            if len(found) > 8:  # few tables to compare with, however long the paths
                whole = found[0][0]
                for x, _ in found[1:-1]:
                    whole = whole.unionByName(x)
                one = write(whole)
                for _, p in found[:-1]:
                    drop(self.spark, p)
                found = [one, found[-1]]
        drop(self.spark, step_path)
        out = found[0][0]
        for x, _ in found[1:]:
            out = out.unionByName(x)
        vals = {S: Val(a.type, F.col("s"), a.extra), O: Val(b.type, F.col("o"), b.extra)} | {n: Val("iri", F.col("g")) for n in graph}
        return build(out, vals, vals.keys())
