"""Relational tables seen as RDF.

A row's subject is <urn:t:TABLE/KEY>, a column one predicate <urn:t:...>, a null cell no triple. A foreign key's object is the other
table's subject, held as the native key. All patterns on one subject over one table become a single scan of the columns they name.
Every table is a named graph <urn:g:TABLE> too; the default graph is all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.values import Val, of_term, same, to_term
from graphloom.operators.relation import Rel, build, union
from graphloom.plans.algebra import Triple, Var
from graphloom.sources.base import Active
from graphloom.terms import IRI, RDF_LANG, RDF_TYPE, TERM_DDL, Literal, Term, term_column

BASE, GRAPHS = "urn:t:", "urn:g:"
_TYPES = {T.StringType: "string", T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime", T.DateType: "date"}


@dataclass
class TableMap:
    """name, how to load it, its key columns; per column a predicate's local name and, for foreign keys, the other table."""

    name: str
    load: Callable[[], DataFrame]
    key: tuple[str, ...]
    predicates: dict[str, str] = field(default_factory=dict)  # column: local name
    foreign: dict[str, str] = field(default_factory=dict)  # column: table
    subject: str | None = None  # the table whose rows are the subjects, if not this one
    tags: dict[str, str] = field(default_factory=dict)  # text column: column of its language
    unique: bool = True

    @property
    def prefix(self) -> str:
        return f"{BASE}{self.subject or self.name}/"


class MappedSource:
    def __init__(self, spark: SparkSession, tables: Iterable[TableMap]):
        self.spark = spark
        self.tables = {t.name: t for t in tables}
        self.frames: dict[str, DataFrame] = {}
        self.by_predicate = {BASE + p: (t, c) for t in self.tables.values() for c, p in t.predicates.items()}

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.tables[name].load()
        return self.frames[name]

    # Values of a row
    def subject(self, t: TableMap) -> Val:
        if len(t.key) == 1 and t.unique:
            return Val("iri", F.col(t.key[0]), t.prefix)
        parts = [F.col(k).cast("string") for k in t.key]
        if not t.unique:  # equal keys are told apart by all other columns; computed only where the subject is used
            rest = [c for c in self.frame(t.name).columns if c not in t.key]
            parts.append(F.row_number().over(Window.partitionBy(*t.key).orderBy(*rest)).cast("string"))
        return Val("iri", F.concat_ws("-", *parts), t.prefix)

    def cell(self, t: TableMap, column: str) -> Val | None:
        if column in t.foreign:
            return Val("iri", F.col(column), self.tables[t.foreign[column]].prefix)
        if column in t.tags:
            return Val("term", term_column(2, F.col(column), RDF_LANG, F.col(t.tags[column])))
        kind = _TYPES.get(type(self.frame(t.name).schema[column].dataType))
        return None if kind is None else Val(kind, F.col(column))

    # Grouping
    def table_of(self, triple: Triple) -> str | None:
        if isinstance(triple.p, IRI):
            if triple.p.value == RDF_TYPE:
                if isinstance(triple.o, IRI) and triple.o.value.startswith(BASE) and triple.o.value[len(BASE) :] in self.tables:
                    return triple.o.value[len(BASE) :]
            elif triple.p.value in self.by_predicate:
                return self.by_predicate[triple.p.value][0].name
        return None

    def groups(self, triples: Iterable[Triple]) -> list[list[Triple]]:
        out: dict[object, list[Triple]] = {}
        for k, t in enumerate(triples):
            table = self.table_of(t)
            out.setdefault((t.s, table) if table else k, []).append(t)
        return list(out.values())

    def _graph(self, table: str, active: Active) -> bool:
        return active.graphs is None or GRAPHS + table in active.graphs

    def scan(self, triples: list[Triple], active: Active, wanted: set[str]) -> Rel:
        table = self.table_of(triples[0])
        if table is not None:
            return self._star(self.tables[table], triples, active, wanted)
        (t,) = triples
        open_ = isinstance(t.p, Var) or (isinstance(t.p, IRI) and t.p.value == RDF_TYPE and isinstance(t.o, Var))
        if not open_:
            return self._nothing(triples, active)
        return self._open(t, active, wanted)

    def _nothing(self, triples: list[Triple], active: Active) -> Rel:
        names = dict.fromkeys(n.name for t in triples for n in (t.s, t.p, t.o) if isinstance(n, Var))
        if active.var:
            names.setdefault(active.var)
        rel = build(self.spark.range(0), {n: Val("iri", F.lit(None).cast("string")) for n in names})
        return Rel(rel.df, rel.vars, frozenset(names))

    def _star(self, t: TableMap, triples: list[Triple], active: Active, wanted: set[str]) -> Rel:
        if not self._graph(t.name, active):
            return self._nothing(triples, active)
        df, vals, tests = self.frame(t.name), {}, []

        def put(node, v: Val) -> None:
            if isinstance(node, Var):
                if node.name in vals:
                    tests.append(same(vals[node.name], v))
                else:
                    vals[node.name] = v
            else:
                tests.append(same(v, of_term(node)))

        s = triples[0].s
        if not isinstance(s, Var) or s.name in wanted or any(x.o == s for x in triples):
            put(s, self.subject(t))
        for triple in triples:
            if triple.p.value == RDF_TYPE:
                continue
            column = self.by_predicate[triple.p.value][1]
            v = self.cell(t, column)
            if v is None:
                return self._nothing(triples, active)
            tests.append(F.col(column).isNotNull())
            put(triple.o, v)
        if active.var:
            put(Var(active.var), Val("iri", F.lit(GRAPHS + t.name)))
        if not t.unique and isinstance(s, Var) and s.name in vals:  # number equal keys over all rows, before any is dropped
            df = df.withColumn("__subject", vals[s.name].col)
            vals[s.name] = Val("iri", F.col("__subject"), t.prefix)
        for c in tests:
            df = df.filter(c)
        return build(df, vals, vals.keys())

    def _rows(self, t: TableMap, df: DataFrame | None = None) -> DataFrame:
        """All triples of a table as terms: one scan, then its cells one under the other. df: rows of the table with their subjects' keys."""
        subject = self.subject(t) if df is None else Val("iri", F.col("__subject"), t.prefix)
        df = self.frame(t.name) if df is None else df
        cells = [F.struct(F.lit(BASE + p).alias("p"), to_term(v).alias("o")) for c, p in t.predicates.items() if (v := self.cell(t, c)) is not None]
        if t.subject is None:
            cells.append(F.struct(F.lit(RDF_TYPE).alias("p"), term_column(0, F.lit(BASE + t.name)).alias("o")))
        kind = f"array<struct<p:string,o:{TERM_DDL}>>"
        laid = df.select(to_term(subject).alias("s"), F.explode(F.array(*cells).cast(kind)).alias("c"))
        return laid.select("s", F.col("c.p").alias("p"), F.col("c.o").alias("o"), F.lit(GRAPHS + t.name).alias("g")).filter("o is not null")

    def _may_meet(self, v: Val, term: Term) -> bool:
        """Whether a cell can hold a term, as far as types tell."""
        if v.const is not None:
            return v.const == term
        if v.type == "term":  # tagged text
            return isinstance(term, Literal) and term.lang is not None
        if v.type == "iri":
            return isinstance(term, IRI) and term.value.startswith(v.extra or "")
        return isinstance(term, Literal) and of_term(term).type in (v.type, "term")

    def _open(self, t: Triple, active: Active, wanted: set[str], tables: list[TableMap] | None = None) -> Rel:
        """A pattern with a variable predicate or class: over the tables and columns that it may touch.

        Constants are compared with native cells first, which scans can do, and a subject that nobody asks for isn't computed.
        """
        rels = []
        for table in self.tables.values() if tables is None else tables:
            if not self._graph(table.name, active) or isinstance(t.s, IRI) and not t.s.value.startswith(table.prefix):
                continue
            cells = [(BASE + p, v) for c, p in table.predicates.items() if (v := self.cell(table, c)) is not None]
            if table.subject is None:
                cells.append((RDF_TYPE, Val("iri", F.lit(BASE + table.name), const=IRI(BASE + table.name))))
            if isinstance(t.p, IRI):
                cells = [(p, v) for p, v in cells if p == t.p.value]
            if not isinstance(t.o, Var):
                cells = [(p, v) for p, v in cells if self._may_meet(v, t.o)]
            if cells:
                rels.append(self._cells(table, cells, t, active, wanted))
        return union(rels) if rels else self._nothing([t], active)

    def _cells(self, table: TableMap, cells: list[tuple[str, Val]], t: Triple, active: Active, wanted: set[str]) -> Rel:
        df, found = self.frame(table.name), {}
        named = not isinstance(t.s, Var) or t.s.name in wanted or t.s in (t.p, t.o) or t.s.name == active.var
        subject = self.subject(table) if named else None
        if named and not table.unique:  # number equal keys over all rows, before any is dropped
            df, subject = df.withColumn("__subject", subject.col), Val("iri", F.col("__subject"), table.prefix)
        if isinstance(t.s, IRI):
            df = df.filter(same(subject, of_term(t.s)))
        if not isinstance(t.o, Var) and all(v.type in ("iri", "string", "integer") for _, v in cells):
            df = df.filter(reduce(Column.__or__, (same(v, of_term(t.o)) for _, v in cells)))
        if len(cells) == 1:
            ((name, o),) = cells
            df, p = df.filter(o.col.isNotNull()), Val("iri", F.lit(name))
        else:
            laid = F.array(*(F.struct(F.lit(name).alias("p"), to_term(v).alias("o")) for name, v in cells)).cast(f"array<struct<p:string,o:{TERM_DDL}>>")
            df = df.select(*([subject.col.alias("s")] if named else []), F.explode(laid).alias("c")).filter("c.o is not null")
            subject, p, o = named and Val("iri", F.col("s"), table.prefix), Val("iri", F.col("c.p")), Val("term", F.col("c.o"))
        values = [(t.s, subject)] if named else []
        values += [(t.p, p), (t.o, o)]
        if active.var:
            values.append((Var(active.var), Val("iri", F.lit(GRAPHS + table.name))))
        for node, v in values:
            if not isinstance(node, Var):
                df = df.filter(to_term(v) == to_term(of_term(node)))
            elif node.name in found:
                df = df.filter(same(found[node.name], v))
            else:
                found[node.name] = v
        return build(df, found, found.keys())

    def types(self, subject: Val, active: Active) -> Rel:
        near = [t for t in self.tables.values() if subject.type in ("iri", "term") and (subject.extra is None or t.prefix.startswith(subject.extra) or subject.extra.startswith(t.prefix))]
        return self._open(Triple(Var("?s"), IRI(RDF_TYPE), Var("?o")), active, {"?s", "?o"}, near)

    def nodes(self, active: Active) -> Rel:
        rels = [self._rows(t).select(F.explode(F.array("s", "o")).alias("node"), "g") for t in self.tables.values() if self._graph(t.name, active)]
        if not rels:
            return self._nothing([Triple(Var("?node"), Var("?node"), Var("?node"))], active)
        df = rels[0]
        for x in rels[1:]:
            df = df.unionByName(x)
        vals = {"?node": Val("term", F.col("node"))} | ({active.var: Val("iri", F.col("g"))} if active.var else {})
        rel = build(df, vals, vals.keys())
        return Rel(rel.df.distinct(), rel.vars, rel.bound)

    def quads(self) -> DataFrame:
        """Everything as quads in the default graph, each once.

        A table with one row for each subject has no triple twice, which its keys tell; of other tables only the rows that share a
        subject are merged. So the terms themselves, many times larger than the rows, aren't compared.
        """
        keyed = {t.name: self.frame(t.name).withColumn("__subject", self.subject(t).col) for t in self.tables.values()}
        shared = {n: df.groupBy("__subject").count().filter("count > 1").select(F.col("__subject").alias("__shared")) for n, df in keyed.items()}
        found = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("name")) for n, df in shared.items()))
        merge = {r[0] for r in found.distinct().collect()}
        out = []
        for t in self.tables.values():
            if t.name not in merge:
                out.append(self._rows(t))
                continue
            df, other = keyed[t.name], shared[t.name]
            on = F.col("__subject").eqNullSafe(F.col("__shared"))
            out += [self._rows(t, df.join(other, on, "left_anti")), self._rows(t, df.join(other, on, "left_semi")).distinct()]
        rows = reduce(DataFrame.unionByName, out)
        return rows.select(F.lit(None).cast(TERM_DDL).alias("graph"), F.col("s").alias("subject"), term_column(0, F.col("p")).alias("predicate"), F.col("o").alias("object"))


def warehouse(spark: SparkSession, folder: str) -> MappedSource:
    """The driver's tables below `folder`."""

    def table(name: str, key: str, foreign: dict[str, str] | None = None, unique: bool = True, subject: str | None = None, tags=None, prefix: str | None = None, columns: str = "") -> TableMap:
        cols = columns.split()
        names = {c: c if prefix is None else f"{prefix}_{c}" for c in cols}
        return TableMap(name, lambda: spark.read.parquet(f"{folder}/{name}.parquet"), tuple(key.split()), names, foreign or {}, subject, tags or {}, unique)

    return MappedSource(spark, [
        table("region", "r_regionkey", columns="r_regionkey r_name"),
        table("nation", "n_nationkey", {"n_regionkey": "region"}, columns="n_nationkey n_name n_regionkey"),
        table("customer", "c_custkey", {"c_nationkey": "nation"}, columns="c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
        table("supplier", "s_suppkey", {"s_nationkey": "nation"}, columns="s_suppkey s_name s_nationkey s_acctbal"),
        table("part", "p_partkey", columns="p_partkey p_name p_brand p_type p_size p_retailprice"),
        table("orders", "o_orderkey", {"o_custkey": "customer"}, columns="o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
        table("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, unique=False, columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"),
        table("events", "event_id", prefix="events", columns="event_id ts user_id event_type value props"),
        table("documents", "doc_id", prefix="documents", tags={"text": "lang"}, columns="doc_id text lang source n_chars"),
        table("labels", "doc_id", prefix="labels", subject="documents", columns="quality toxic"),
        table("pages", "page_id", prefix="pages", columns="page_id url html"),
        table("conversations", "conv_id turn", prefix="conversations", columns="conv_id turn role text"),
        table("benchmark", "item_id", prefix="benchmark", columns="item_id text"),
    ])


