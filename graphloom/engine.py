"""The engine: SPARQL text to DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import NULL, Val, lexical, of_term, to_term
from graphloom.operators.compiler import Compiler
from graphloom.operators.relation import Rel, semi
from graphloom.plans import algebra as A
from graphloom.plans.parser import parse
from graphloom.sources.base import QuadSource
from graphloom.terms import RDF_TYPE, IRI, BNode, term_column

TRIPLE = ("subject", "predicate", "object")


@dataclass(frozen=True)
class Explanation:
    """Seconds of planning, the algebra, and Spark's plan as analysed, optimised and chosen."""

    seconds: float
    algebra: object
    logical: str
    optimized: str
    physical: str


class Engine:
    """Queries over one source.

    `native` results have plain Spark types (IRIs as text, terms of no static type by their text); otherwise columns are
    term structs.
    """

    def __init__(self, spark: SparkSession, source: QuadSource, base: str | None = None, prefixes: dict[str, str] | None = None):
        self.spark, self.source, self.base, self.prefixes = spark, source, base, prefixes or {}
        self.custom: dict[str, Callable] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def register_function(self, iri: str, function: Callable[..., Column], result: str = "term") -> None:
        """A scalar function: `function` maps native columns (terms where the type isn't known) to a column of type `result`."""
        self.custom[iri] = lambda *args: Val(result, function(*(a.col for a in args)))

    def parse(self, text: str) -> A.Query:
        return parse(text, self.base, self.prefixes)

    def query(self, query: str | A.Query, native: bool = False) -> DataFrame:
        """SELECT: a column for each variable; ASK: one boolean; CONSTRUCT and DESCRIBE: subject, predicate, object."""
        q = self.parse(query) if isinstance(query, str) else query
        compiler = Compiler(self.spark, self.source, q, self.custom)
        if q.form == "SELECT":
            return self._select(compiler.run(), q, native)
        if q.form == "ASK":
            # One row at most leaves the executors.
            return compiler.run().df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        triples = self._construct(compiler.run(), q) if q.form == "CONSTRUCT" else self._describe(compiler, q)
        return triples.select(*(F.col(f"{c}.lex").alias(c) for c in TRIPLE)) if native else triples

    def ask(self, text: str | A.Query) -> bool:
        return bool(self.query(text).first()[0])

    def explain(self, text: str, mode: str = "formatted") -> str:
        df = self.query(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def explanation(self, text: str) -> Explanation:
        """The stages of planning a query and how long they took; closures run while a query is planned."""
        began = time.perf_counter()
        q = self.parse(text)
        run = self.query(q)._jdf.queryExecution()
        plans = [run.analyzed().toString(), run.optimizedPlan().toString(), run.executedPlan().toString()]
        return Explanation(time.perf_counter() - began, q.pattern, *plans)

    @staticmethod
    def _native(v: Val) -> Column:
        if v.type == "dateTime":
            return v.col.cast("timestamp_ntz")
        if v.type == "null":
            return F.lit(None).cast("string")
        return lexical(v) if v.type in ("iri", "bnode", "term") else v.col

    def _select(self, rel: Rel, q: A.Query, native: bool) -> DataFrame:
        names = q.names or tuple(rel.vars)
        return rel.df.select(*((self._native if native else to_term)(rel.value(n)).alias(n) for n in names))

    def _construct(self, rel: Rel, q: A.Query) -> DataFrame:
        """The template filled in for each solution; incomplete and illegal triples are left out, and equal ones merged.

        Blank nodes of the template are fresh in each solution: their labels hold a random solution id.
        """
        fresh = any(isinstance(n, BNode) for t in q.template for n in (t.s, t.p, t.o))
        df = rel.df.withColumn("__row", F.regexp_replace(F.expr("uuid()"), "-", "")) if fresh else rel.df

        def node(n) -> Column:
            if isinstance(n, A.Var):
                return to_term(rel.value(n.name))
            if isinstance(n, BNode):
                return term_column(1, F.concat(F.col("__row"), F.lit(n.label)))
            return to_term(of_term(n))

        if not q.template:
            q = A.Query("CONSTRUCT", q.pattern, (A.Triple(A.Var("?"), A.Var("?"), A.Var("?")),))
        cells = F.array(*(F.struct(node(t.s).alias("subject"), node(t.p).alias("predicate"), node(t.o).alias("object")) for t in q.template))
        out = df.select(F.inline(cells))
        legal = F.col("subject").isNotNull() & (F.col("subject.kind") != 2) & (F.col("predicate.kind") == 0) & F.col("object").isNotNull()
        return out.filter(legal).distinct()

    def _describe(self, compiler: Compiler, q: A.Query) -> DataFrame:
        """The types of the described resources."""
        active, parts = compiler.default(), []
        rel = compiler.run() if any(isinstance(n, A.Var) for n in q.describe) else None
        for n in q.describe:
            if not isinstance(n, A.Var):
                types = self.source.scan([A.Triple(n, IRI(RDF_TYPE), A.Var("?o"))], active, {"?o"})
                parts.append((types.df, of_term(n), types.vars["?o"]))
            elif n.name in rel.vars:
                (v,) = (one := rel.keep([n.name])).vars.values()
                types = self.source.types(v, active)
                types = semi(types, Rel(one.df.filter(v.col.isNotNull()), {"?s": v}, frozenset({"?s"})))
                parts.append((types.df, types.vars["?s"], types.vars["?o"]))
        if not parts:
            parts.append((self.spark.range(0), NULL, NULL))
        laid = [df.select(to_term(s).alias("subject"), to_term(of_term(IRI(RDF_TYPE))).alias("predicate"), to_term(o).alias("object")) for df, s, o in parts]
        return reduce(DataFrame.unionByName, laid).distinct()
