"""A quad store over immutable DataFrames.

Quads are a set. A change makes a new DataFrame; frames handed out before stay as they were. Named graphs may be empty, so
their names are kept beside the quads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.engine import Engine, Explanation
from graphloom.operators.written import write
from graphloom.sources import rdfio
from graphloom.sources.quads import QuadTableSource, folder_column
from graphloom.sources.rdfio import Quad
from graphloom.streaming import results
from graphloom.terms import QUADS, IRI, Term, constant, term_of

COLUMNS = ("graph", "subject", "predicate", "object")


def _same(a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for c in COLUMNS:
        on = on & (a[c].eqNullSafe(b[c]) if c == "graph" else a[c] == b[c])
    return on


class Store:
    """Single changes are kept aside and laid over the quads in one step, so that plans don't grow with their number; many are written."""

    #: Single changes kept aside, and changes of whole frames planned on top of each other, before all is written anew.
    ASIDE, DEPTH = 10_000, 16
    #: Files that a task writes at once (what goes to more is sorted first), and bytes of a table that it reads and of a file's row groups.
    WRITERS, SPLIT = 64, 16 << 20

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, union_default: bool = False, base: str | None = None, unique: bool = False):
        """unique: no two of `quads` are equal."""
        self.spark, self.union_default, self.base = spark, union_default, base
        self._depth = 0
        self.quads = spark.createDataFrame([], QUADS) if quads is None else quads.select(*COLUMNS) if unique else quads.select(*COLUMNS).dropDuplicates()
        self.names: set[str] = set()
        self.custom: dict = {}

    @property
    def quads(self) -> DataFrame:
        if self._seen is None:
            self._seen = self._held
            if self._gone:
                gone = rdfio.to_frame(self.spark, list(self._gone))
                self._seen = self._seen.join(gone, _same(self._seen, gone), "left_anti")
            if self._added:  # none of them is among the others
                self._seen = self._seen.unionByName(rdfio.to_frame(self.spark, list(self._added)).select(*COLUMNS))
        return self._seen

    @quads.setter
    def quads(self, df: DataFrame) -> None:
        self._depth += 1
        if self._depth > self.DEPTH:
            df, _ = write(df)
            self._depth = 0
        self._held, self._seen, self._added, self._gone = df, None, {}, {}
        self._files: DataFrame | None = None  # what is held, as read from write_parquet's folders

    def _changed(self) -> None:
        self._seen = None
        if len(self._added) + len(self._gone) > self.ASIDE:
            self._depth = self.DEPTH
            self.quads = self.quads

    # Queries
    @property
    def engine(self) -> Engine:
        e = Engine(self.spark, QuadTableSource(self.quads, self.union_default, None if self._added or self._gone else self._files), self.base)
        e.custom = self.custom
        return e

    def register_function(self, iri: str, function, result: str = "term") -> None:
        self.engine.register_function(iri, function, result)  # engines share this store's table of functions

    def query(self, text: str, native: bool = False) -> DataFrame:
        return self.engine.query(text, native)

    def ask(self, text: str) -> bool:
        return self.engine.ask(text)

    def solutions(self, text: str) -> Iterator[results.Solution]:
        return results.solutions(self.query(text))

    def explain(self, text: str) -> str:
        return self.engine.explain(text)

    def explanation(self, text: str) -> Explanation:
        return self.engine.explanation(text)

    def serialize(self, text: str, format: str) -> Iterator[str]:
        """A query's result as a document: results formats for SELECT and ASK, RDF formats for CONSTRUCT and DESCRIBE."""
        q = self.engine.parse(text)
        df = self.engine.query(q)
        if q.form == "SELECT":
            return results.write_solutions(list(df.columns), results.solutions(df), format)
        if q.form == "ASK":
            return iter([results.write_boolean(bool(df.first()[0]), format)])
        triples = ((None, *(term_of(r[c]) for c in COLUMNS[1:])) for r in df.toLocalIterator())
        return rdfio.serialize(triples, format)

    # Quads
    def matching(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None | str = "any") -> DataFrame:
        """Quads by pattern; g None is the default graph. Blank nodes are constants."""
        return QuadTableSource(self.quads).matching(s, p, o, g)

    def contains(self, quad: Quad) -> bool:
        return quad in self._added or quad not in self._gone and self._holds(quad)

    def _holds(self, quad: Quad) -> bool:
        g, s, p, o = quad
        return not QuadTableSource(self._held).matching(s, p, o, g).isEmpty()

    def __len__(self) -> int:
        return self.quads.count()

    def is_empty(self) -> bool:
        return self.quads.isEmpty()

    def insert(self, quad: Quad) -> bool:
        """Whether the quad is new."""
        if self.contains(quad):
            return False
        if quad in self._gone:
            del self._gone[quad]
        else:
            self._added[quad] = None
        self._changed()
        return True

    def extend(self, quads: Iterable[Quad] | DataFrame) -> None:
        df = quads if isinstance(quads, DataFrame) else rdfio.to_frame(self.spark, quads)
        self.quads = self.quads.unionByName(df.select(*COLUMNS)).dropDuplicates()

    def remove(self, quad: Quad) -> bool:
        """Whether the quad was there."""
        if not self.contains(quad):
            return False
        if quad in self._added:
            del self._added[quad]
        else:
            self._gone[quad] = None
        self._changed()
        return True

    # Graphs
    def named_graphs(self) -> set[str]:
        return self.names | {r[0] for r in self.quads.filter("graph is not null").select("graph.lex").distinct().toLocalIterator()}

    def contains_named_graph(self, name: str) -> bool:
        return name in self.names or not self.matching(g=IRI(name)).isEmpty()

    def insert_named_graph(self, name: str) -> bool:
        new = not self.contains_named_graph(name)
        self.names.add(name)
        return new

    def clear_graph(self, name: str | None = None) -> None:
        """Without its quads the graph is still there; None: the default graph."""
        if name is None:
            self.quads = self.quads.filter("graph is not null")
        else:
            if self.contains_named_graph(name):
                self.names.add(name)
            self.quads = self.quads.filter(F.col("graph").isNull() | (F.col("graph.lex") != name))

    def remove_named_graph(self, name: str) -> bool:
        there = self.contains_named_graph(name)
        self.clear_graph(name)
        self.names.discard(name)
        return there

    def clear(self) -> None:
        self.quads = self.spark.createDataFrame([], QUADS)
        self.names = set()

    # Input and output
    def load(self, text: str, format: str, base: str | None = None, to_graph: str | None = None) -> None:
        """One document; nothing is added if it has an error. Blank nodes are renamed."""
        quads = rdfio.parse(text, format, base or self.base)
        if to_graph is not None:
            if any(q[0] is not None for q in quads):
                raise ValueError("a dataset can't go into one graph")
            quads = [(IRI(to_graph), *q[1:]) for q in quads]
        self.extend(quads)

    def load_path(self, path: str, format: str, lenient: bool = False, to_graph: str | None = None) -> None:
        """Files of any size for line formats; others are read whole."""
        if format in ("nt", "nq"):
            df = rdfio.read_lines(self.spark, path, lenient)
            self.extend(df if to_graph is None else df.withColumn("graph", constant(IRI(to_graph))))
            return
        for r in self.spark.read.text(path, wholetext=True).toLocalIterator():
            self.load(r[0], format, to_graph=to_graph)

    def dump(self, format: str) -> Iterator[str]:
        """The whole dataset in a dataset format."""
        if format not in ("nq", "trig"):
            raise ValueError(f"{format} can't hold graphs")
        ordered = self.quads.orderBy("graph", "subject")
        return rdfio.serialize((tuple(term_of(r[c]) for c in COLUMNS) for r in ordered.toLocalIterator()), format)

    def dump_graph(self, format: str, name: str | None = None) -> Iterator[str]:
        one = self.matching(g=None if name is None else IRI(name)).orderBy("subject")
        return rdfio.serialize(((None, *(term_of(r[c]) for c in COLUMNS[1:])) for r in one.toLocalIterator()), format)

    def write_lines(self, path: str, graphs: bool = True) -> None:
        """N-Quads or N-Triples files, in parallel."""
        rdfio.line_frame(self.quads, graphs).write.text(path)

    def write_parquet(self, path: str, gather: bool = True) -> None:
        """Quads by predicate: scans of one predicate read its files only.

        gather: the quads of a predicate are brought together and sorted by subject; adaptive execution splits those of many quads.
        Without it each task writes what it reads as it comes, to a file for each of its predicates: nothing is shuffled or sorted,
        which suits quads read from tables, where a task meets few predicates.
        """
        named = self.quads.withColumn("p", folder_column())
        if gather:
            named.hint("rebalance", F.col("p")).sortWithinPartitions("p", "subject").write.partitionBy("p").parquet(path)
            return
        conf, split = self.spark.conf, self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        own = {"spark.sql.maxConcurrentOutputFileWriters": str(self.WRITERS), "spark.sql.files.maxPartitionBytes": str(min(split, self.SPLIT))}
        held = {k: conf.get(k) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            named.write.partitionBy("p").option("parquet.block.size", self.SPLIT).parquet(path)
        finally:
            for k, v in held.items():
                conf.set(k, v)

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str, **options) -> Store:
        store = cls(spark, **options)
        files = spark.read.schema(StructType([*QUADS, StructField("p", StringType())])).parquet(path)
        store.quads = files.select(*COLUMNS)  # written from a set
        store._files = files
        return store
