"""SPARQL algebra to DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import library
from graphloom.functions import values as V
from graphloom.functions.values import NULL, Val, boolean, common, of_term, sort_key
from graphloom.operators import aggregates
from graphloom.operators import relation as R
from graphloom.operators.paths import Paths
from graphloom.operators.relation import Rel, build, fresh
from graphloom.plans import algebra as A
from graphloom.sources.base import Active, QuadSource
from graphloom.terms import IRI

#: Before the name of a variable: its value outside an EXISTS, as a struct.
OUTER = "?outer "


class Compiler:
    def __init__(self, spark: SparkSession, source: QuadSource, query: A.Query, custom: dict[str, Callable] | None = None):
        self.spark, self.source, self.query = spark, source, query
        self.context = library.Context(query.base, custom)
        self.mentions = A.mentioned(query)
        self.all_wanted = query.form == "SELECT" and not query.names or self._counts_rows(query)
        self.outer: Rel | None = None  # inside an EXISTS: the solutions it is asked for

    @staticmethod
    def _counts_rows(x) -> bool:
        """Whether COUNT(DISTINCT *) occurs: it sees every variable."""
        if isinstance(x, A.Aggregate) and x.arg is None and x.distinct:
            return True
        return any(Compiler._counts_rows(c) for c in A.children(x))

    def run(self) -> Rel:
        return self.pattern(self.query.pattern, self.default())

    def default(self) -> Active:
        return Active(self.query.default_graphs)

    # Patterns
    def pattern(self, x, active: Active) -> Rel:
        match x:
            case A.BGP(triples):
                return self.bgp(triples, active)
            case A.Path(s, path, o):
                return Paths(self.spark, self.source).match(s, path, o, active)
            case A.Join(a, b):
                return R.join(self.pattern(a, active), self.pattern(b, active))
            case A.LeftJoin(a, b, condition):
                left, right = self.pattern(a, active), self.pattern(b, active)
                left = self.seed(left, {n: 1 for n in right.vars if n.startswith(OUTER)} | A.mentioned(condition), right.vars)
                if condition is not None and self._exists_in(condition):
                    return self.optional_exists(left, right, condition, active)
                return R.left_join(left, right, None if condition is None else lambda vals: V.ebv(self.expression(condition, vals)))
            case A.Union(a, b):
                return R.union([self.pattern(a, active), self.pattern(b, active)])
            case A.Minus(a, b):
                left, right = self.pattern(a, active), self.pattern(b, active)
                return R.minus(self.seed(left, {n: 1 for n in right.vars if n.startswith(OUTER)}), right, OUTER)
            case A.Filter(condition, p):
                return self.filter(condition, self.pattern(p, active), active)
            case A.Extend(p, name, e):
                rel = self.seed(self.pattern(p, active), A.mentioned(e))
                rel, vals = self.with_exists(e, rel, active)
                v = self.expression(e, vals)
                kept = {n: rel.vars[n] for n in rel.vars if not n.startswith("?exists")}
                sure = rel.bound | ({name} if isinstance(e, (IRI, V.Literal)) or isinstance(e, A.Var) and e.name in rel.bound else set())
                return build(rel.df, kept | {name: v}, sure)
            case A.Graph(name, p):
                return self.graph(name, p)
            case A.Values(names, rows):
                return self.values(names, rows)
            case A.Group():
                return self.group(x, active)
            case A.OrderBy(p, keys):
                rel, cols = self.ordered(p, keys, active)
                return Rel(rel.df.orderBy(*(k.desc_nulls_last() if down else k.asc_nulls_first() for k, down in cols)), rel.vars, rel.bound)
            case A.Project(p, names):
                return self.project(p, names, active)
            case A.Distinct(A.Project(A.OrderBy(p, keys), names)):
                return self.distinct_ordered(p, keys, names, active)
            case A.Distinct(p):
                return R.distinct(self.pattern(p, active))
            case A.Reduced(p):
                return self.pattern(p, active)
            case A.Slice(p, offset, limit):
                rel = self.pattern(p, active)
                df = rel.df.offset(offset) if offset else rel.df
                return Rel(df if limit is None else df.limit(limit), rel.vars, rel.bound)
        raise NotImplementedError(type(x).__name__)

    def visible(self, rel: Rel, names, active: Active) -> list[str]:
        """The variables that a projection keeps; one that GRAPH binds, and outer values, go on beside those named."""
        more = [n for n in rel.vars if (n == active.var or n.startswith(OUTER)) and n not in names]
        return [*names, *more]

    def project(self, p, names, active: Active) -> Rel:
        rel = self.pattern(p, active)
        return build(rel.df, {n: rel.value(n) for n in self.visible(rel, names, active)}, rel.bound)

    def ordered(self, p, keys, active: Active) -> tuple[Rel, list[tuple[Column, bool]]]:
        """A pattern's solutions and the columns to order them by, each with whether it goes down."""
        rel, cols = self.pattern(p, active), []
        for e, down in keys:
            rel, vals = self.with_exists(e, rel, active)
            cols.append((sort_key(self.expression(e, vals)), down))
        return rel, cols

    def distinct_ordered(self, p, keys, names, active: Active) -> Rel:
        """DISTINCT with ORDER BY: a solution stands where the first of its equals would."""
        if all(n in names for n in A.mentioned(keys)) and not self._exists_in(keys):
            rel = R.distinct(self.project(p, names, active))
            cols = [(sort_key(self.expression(e, rel.vars)), down) for e, down in keys]
            return Rel(rel.df.orderBy(*(k.desc_nulls_last() if down else k.asc_nulls_first() for k, down in cols)), rel.vars, rel.bound)
        rel, cols = self.ordered(p, keys, active)
        vals = {n: rel.value(n) for n in self.visible(rel, names, active)}
        laid = {n: fresh(n) for n in vals}
        by = [fresh("key") for _ in cols]
        df = rel.df.select(*(v.col.alias(laid[n]) for n, v in vals.items()), *(k.alias(c) for (k, _), c in zip(cols, by)))
        order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for (_, down), c in zip(cols, by)]
        at = fresh("at")
        df = df.withColumn(at, F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in laid.values())).orderBy(*order))).filter(F.col(at) == 1)
        out = {n: Val(v.type, F.col(f"`{laid[n]}`"), v.extra, made=v.made) for n, v in vals.items()}
        return build(df.orderBy(*order), out, rel.bound)

    def bgp(self, triples: tuple[A.Triple, ...], active: Active) -> Rel:
        if not triples:
            if active.var:
                nodes = self.source.nodes(active)
                return R.distinct(nodes.keep([active.var]))
            return Rel(self.spark.range(1).select(), {}, frozenset())
        rels: list[tuple[bool, Rel]] = []
        for group in self.source.groups(triples):
            inside: dict[str, int] = {}
            for t in group:
                A.mentioned(t, inside)
            wanted = {n for n in inside if self.all_wanted or self.mentions.get(n, 0) > inside[n]}
            selective = any(not isinstance(n, A.Var) for t in group for n in (t.s, t.o) if not (isinstance(t.p, IRI) and t.p.value.endswith("#type")))
            rels.append((selective, self.source.scan(group, active, wanted)))
        # Selective scans first; then whatever shares a variable with what is joined already, so that no product is made.
        first = next((k for k, (s, _) in enumerate(rels) if s), 0)
        out = rels.pop(first)[1]
        while rels:
            near = [k for k, (_, r) in enumerate(rels) if set(r.vars) & set(out.vars)] or list(range(len(rels)))
            k = next((k for k in near if rels[k][0]), near[0])
            out = R.join(out, rels.pop(k)[1])
        return out

    def graph(self, name, p) -> Rel:
        named = self.query.named_graphs
        if isinstance(name, IRI):
            if named is not None and name.value not in named:
                return R.build(self.spark.range(0), {n: Val("iri", F.lit(None).cast("string")) for n in A.in_scope(p)})
            return self.pattern(p, Active((name.value,), True))
        active = Active(named, True, name.name)
        rel = self.pattern(p, active)
        if name.name not in rel.vars:  # nothing inside reads a graph: once for each graph there is
            rel = R.join(rel, R.distinct(self.source.nodes(active).keep([name.name])))
        return rel

    def values(self, names, rows) -> Rel:
        cols: dict[str, list[Val]] = {n: common([of_term(r[k]) for r in rows]) if rows else [] for k, n in enumerate(names)}
        if not rows:
            return build(self.spark.range(0), {n: Val("iri", F.lit(None).cast("string")) for n in names})
        fields = [fresh(n) for n in names]
        if not names:
            return Rel(self.spark.range(len(rows)).select(), {}, frozenset())
        laid = F.array(*(F.struct(*(cols[n][k].col.alias(f) for n, f in zip(names, fields))) for k in range(len(rows))))
        df = self.spark.range(1).select(F.inline(laid))
        vals = {n: Val(cols[n][0].type, F.col(f"`{f}`"), cols[n][0].extra) for n, f in zip(names, fields)}
        sure = frozenset(n for k, n in enumerate(names) if all(r[k] is not None for r in rows))
        return Rel(df, vals, sure)

    # Filters and EXISTS
    def seed(self, rel: Rel, names, known=()) -> Rel:
        """Inside an EXISTS: `rel` joined with the outer values of those of `names` that it (and `known`) lacks.

        A value comes with a copy under OUTER and its name, which is never null: so the solutions of an outer value, an unbound one
        among them, stay apart from those of others until the EXISTS compares the copies.
        """
        outer = self.outer
        if outer is None:
            return rel
        need = {n.removeprefix(OUTER) for n in names} & {n for n in outer.vars if OUTER + n in outer.vars}
        need = {n for n in need if OUTER + n not in rel.vars and (OUTER + n in names or n not in rel.vars and n not in known)}
        if not need:
            return rel
        shared = [n for n in outer.vars if n in rel.vars]
        return R.join(rel, R.distinct(outer.keep([*shared, *need, *(OUTER + n for n in need)])))

    def optional_exists(self, left: Rel, right: Rel, condition, active: Active) -> Rel:
        """OPTIONAL whose filter holds an EXISTS: joined rows that pass, and the rows of `left` of which none did, told by their values."""
        own = {f"?own {n}": v for n, v in left.vars.items()}
        both = self.filter(condition, R.join(build(left.df, left.vars | own, left.bound | {f"?own {n}" for n in left.bound}), right), active)
        met = R.distinct(both.keep(own)).renamed({f"?own {n}": n for n in left.vars})
        rest = R.lacking(left, met)
        return R.union([both.keep([n for n in both.vars if n not in own]), build(rest.df, rest.vars, rest.bound)])

    def filter(self, condition, rel: Rel, active: Active) -> Rel:
        if isinstance(condition, A.Call) and condition.name == "&&":
            for c in condition.args:
                rel = self.filter(c, rel, active)
            return rel
        if isinstance(condition, A.Call) and condition.name == "!" and isinstance(condition.args[0], A.Exists):
            condition = A.Exists(condition.args[0].pattern, not condition.args[0].negated)
        rel = self.seed(rel, A.mentioned(condition))
        if isinstance(condition, A.Exists):
            asked, inner, test = self.inner(condition, rel, active)
            out = R.without(asked, inner, test) if condition.negated else R.semi(asked, inner, test)
            return out if asked is rel else out.keep(rel.vars)
        kept = list(rel.vars)
        rel, vals = self.with_exists(condition, rel, active)
        out = rel.filter(V.ebv(self.expression(condition, vals)))
        return out if len(out.vars) == len(kept) else out.keep(kept)

    def inner(self, e: A.Exists, rel: Rel, active: Active):
        """`rel` as the EXISTS is asked for it, the pattern's solutions, and the part of its filter that needs outer variables.

        A filter on top is part of the match. Where something deeper needs an outer value, the pattern is joined with the distinct
        outer values there, and `rel` comes with copies of them to compare.
        """
        p, test = e.pattern, None
        if isinstance(p, A.Filter) and not self._exists_in(p.condition) and set(A.mentioned(p.condition)) & (set(rel.vars) - set(A.in_scope(p.pattern))):
            condition, p = p.condition, p.pattern
            test = lambda vals: V.ebv(self.expression(condition, vals))
        names = [n for n in rel.vars if n in A.mentioned(p) and not n.startswith(OUTER)]
        copies = {OUTER + n: Val("outer", F.struct(rel.vars[n].col.alias("v"))) for n in names if OUTER + n not in rel.vars}
        asked = build(rel.df, rel.vars | copies, rel.bound | set(copies))
        held, self.outer = self.outer, asked
        try:
            found = self.pattern(p, active)
        finally:
            self.outer = held
        if not any(n in found.vars for n in copies):
            return rel, found, test
        return asked, found, test

    def _exists_in(self, x) -> bool:
        return isinstance(x, A.Exists) or any(self._exists_in(c) for c in A.children(x))

    def with_exists(self, e, rel: Rel, active: Active) -> tuple[Rel, dict]:
        """`rel` with a boolean for each EXISTS inside the expression `e`, found by a join on the variables it shares."""
        found: list[A.Exists] = []

        def look(x) -> None:
            if isinstance(x, A.Exists):
                found.append(x)
            else:
                for c in A.children(x):
                    look(c)

        look(e)
        vals = dict(rel.vars)
        for x in found:
            rel = self.seed(rel, A.mentioned(x))
            own = list(rel.vars)
            asked, inner, test = self.inner(x, rel, active)
            names = [n for n in asked.vars if n in inner.vars or (test is not None and n in A.mentioned(x.pattern))]
            c = fresh("exists")
            if not names:
                one = inner.df.limit(1).select(F.lit(True).alias("hit")).agg((F.count("*") > 0).alias("hit"))
                df = rel.df.crossJoin(one.withColumnRenamed("hit", c))
            else:
                hits = R.semi(R.distinct(asked.keep(names)), inner, test)
                rel, on = asked, F.lit(True)
                for n in names:
                    a, b = rel.vars[n].col, hits.vars[n].col
                    on = on & (a == b if n in rel.bound else a.eqNullSafe(b))
                flagged = hits.df.withColumn(c, F.lit(True))
                df = rel.df.join(flagged, on, "left").drop(*[k for k in hits.df.columns])
            name = f"?exists{id(x)}"
            rel = Rel(df, rel.vars | {name: Val("boolean", F.coalesce(F.col(f"`{c}`"), F.lit(False)))}, rel.bound).keep([*own, name])
            vals = dict(rel.vars)
        return rel, vals

    # Expressions
    def expression(self, e, vals: dict[str, Val]) -> Val:
        if isinstance(e, A.Var):
            return vals.get(e.name, NULL)
        if isinstance(e, A.Exists):
            hit = vals[f"?exists{id(e)}"].col
            return boolean(~hit if e.negated else hit)
        if isinstance(e, A.Call):
            return library.call(self.context, e.name, [self.expression(a, vals) for a in e.args])
        return of_term(e)

    # Groups
    def group(self, g: A.Group, active: Active) -> Rel:
        rel = self.pattern(g.pattern, active)
        g = A.Group(g.pattern, tuple(self.visible(rel, g.keys, active)), g.aggregates)  # GRAPH ?g { SELECT ... }: groups of each graph
        cols = {}
        pre, bound = {}, set()
        for n in g.keys:
            pre[n] = rel.value(n)
        for n, a in g.aggregates:
            if a.arg is not None:
                rel, vals = self.with_exists(a.arg, rel, active)
                pre[f"{n}/arg"] = self.expression(a.arg, vals)
        whole = rel
        if any(a.arg is None and a.distinct for _, a in g.aggregates):
            pre["?row"] = Val("term", F.struct(*(v.col.alias(f"c{k}") for k, v in enumerate(whole.vars.values()))))
        laid = build(rel.df, pre, rel.bound)
        out: dict[str, Val] = {}
        aggs = []
        for n, a in g.aggregates:
            v, is_sure = aggregates.compile(a, laid.vars.get(f"{n}/arg"), laid.vars.get("?row"))
            c = fresh(n)
            aggs.append(v.col.alias(c))
            cols[n] = Val(v.type, F.col(f"`{c}`"), v.extra, made=v.made)
            # In a group by keys there is a row, so the best of a variable that is never unbound is one.
            if is_sure or g.keys and a.name in ("MIN", "MAX", "SAMPLE") and isinstance(a.arg, A.Var) and a.arg.name in rel.bound:
                bound.add(n)
        names = [c for n in g.keys for c in [laid.df.columns[list(laid.vars).index(n)]]]
        if not aggs:
            df = laid.df.select(*names).distinct()
        elif names:
            df = laid.df.groupBy(*names).agg(*aggs)
        else:
            df = laid.df.agg(*aggs)
        for n, c in zip(g.keys, names):
            out[n] = Val(laid.vars[n].type, F.col(f"`{c}`"), laid.vars[n].extra)
        return Rel(df, out | cols, frozenset(bound | (set(g.keys) & laid.bound)))


