"""Steps that must not grow with one key, one predicate or the whole warehouse."""

import glob
import re

import pytest
from oracle import FOLDER
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.functions import library
from graphloom.functions.values import Val, of_term
from graphloom.sources.mapped import MappedSource, TableMap
from graphloom.store import Store
from graphloom.terms import IRI, TERM_DDL, XSD, Literal


def people(spark, rows):
    df = spark.createDataFrame(rows, "k long, a string, b long")
    return MappedSource(spark, [TableMap("people", lambda: df, ("k",), {"k": "k", "a": "a", "b": "b"})])


def test_quads_of_tables_are_a_set(spark):
    """Rows that share a key are merged, triple by triple, with nothing lost."""
    source = people(spark, [(1, "x", 1), (1, "x", 1), (1, "y", 1), (2, "x", None), (3, "x", 1), (None, "z", 5), (None, "z", 6)])
    got = [tuple(str(r[c]) for c in ("subject", "predicate", "object")) for r in source.quads().collect()]
    want = {tuple(str(r[c]) for c in ("subject", "predicate", "object")) for t in source.tables.values() for r in source._rows(t).selectExpr("s subject", "struct(0Y kind, p lex, CAST(NULL AS STRING) dt, CAST(NULL AS STRING) lang) predicate", "o object").collect()}
    assert len(got) == len(set(got)) and set(got) == want
    once = people(spark, [(1, "x", 1), (2, "x", None)]).quads()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in once and "Join" not in once  # terms aren't compared


def test_a_predicate_is_written_by_many_tasks(spark, tmp_path):
    """No task gets all quads of a predicate to sort, whether they are gathered or not."""
    source = people(spark, [(k, f"n{k}", k % 7) for k in range(4000)])
    quads, held = source.quads(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert quads.rdd.getNumPartitions() > 1
    Store(spark, quads, unique=True).write_parquet(str(tmp_path / "plain"), gather=False)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == held
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        Store(spark, quads, unique=True).write_parquet(str(tmp_path / "gathered"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    for kind in ("plain", "gathered"):
        folders = glob.glob(str(tmp_path / kind / "p=*"))
        assert len(folders) == 4 and all(len(glob.glob(f"{d}/part-*")) > 1 for d in folders)
        store = Store.read_parquet(spark, str(tmp_path / kind))
        assert len(store) == 16_000 and store.quads.exceptAll(quads).isEmpty()


def test_a_constant_predicate_reads_its_folder(spark, tmp_path):
    """Spark knows the size of one folder, so that it can choose a join by it; a changed store is still read whole."""
    people(spark, [(k, f"n{k}", k) for k in range(50)]).quads().transform(lambda q: Store(spark, q, unique=True).write_parquet(str(tmp_path / "q")) or q)
    store = Store.read_parquet(spark, str(tmp_path / "q"))
    text = "SELECT ?s WHERE { ?s <urn:t:a> 'n7' }"
    assert "isnotnull(p#" in store.explain(text) and [r.s.lex for r in store.query(text).collect()] == ["urn:t:people/7"]
    store.insert((None, IRI("urn:x"), IRI("urn:t:a"), IRI("urn:y")))
    assert store.query("SELECT ?s ?o WHERE { ?s <urn:t:a> ?o }").count() == 51
    store.clear_graph()
    assert store.query("SELECT ?s ?o WHERE { ?s <urn:t:a> ?o }").count() == 0


def test_arithmetic_reads_a_number_once(spark):
    """A row's term is parsed as a number once for an operation, not wherever the result's text names it."""
    df = spark.createDataFrame([((2, x, XSD + t, None),) for x, t in (("1.5", "double"), ("7", "integer"), ("0.10", "decimal"), ("x", "integer"))], f"b {TERM_DDL}")
    for name, args in (("*", [of_term(Literal("40", XSD + "integer"))]), ("u-", []), ("ROUND", [])):
        out = df.select(library.call(library.Context(), name, [Val("term", F.col("b")), *args]).col["lex"].alias("x"))
        assert out._jdf.queryExecution().analyzed().toString().count("RLIKE") <= 8, name
        assert [r.x for r in out.collect()] == {"*": ["60", "280", "4", None], "u-": ["-1.5", "-7", "-0.1", None], "ROUND": ["2", "7", "0", None]}[name]


def scans(df):
    """The tables that a plan reads."""
    return {f.rsplit("/", 1)[-1].removesuffix(".parquet") for f in re.findall(r"file:[^\s,\]]+\.parquet", df._jdf.queryExecution().executedPlan().toString())}


def test_describe_reads_the_tables_of_its_subjects(spark):
    """the type of a nation is looked for among nations, by their keys."""
    df = catalog.queries()["describe_type"](spark, FOLDER)
    assert scans(df) == {"nation"} and "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    e = catalog.engine(spark, FOLDER)
    kind = lambda text: sorted(r.object for r in e.query(text, native=True).collect())
    assert kind("DESCRIBE <urn:t:region/2> <urn:t:part/5> <urn:x>") == ["urn:t:part", "urn:t:region"]
    assert kind("DESCRIBE ?x ?y WHERE { VALUES ?x { <urn:t:nation/3> 'text' UNDEF } }") == ["urn:t:nation"]
    assert kind("DESCRIBE ?n WHERE { ?s :s_suppkey 1 OPTIONAL { ?s :s_nationkey ?n . ?n :n_regionkey <urn:x> } }") == []
    assert kind("DESCRIBE ?n FROM g:region WHERE { VALUES ?n { <urn:t:nation/3> <urn:t:region/3> } }") == ["urn:t:region"]


def test_a_constant_object_reads_the_tables_that_can_hold_it(spark):
    """F8: a customer is the object of orders only, and their rows are picked by the scan."""
    df = catalog.queries()["bsbm_like_q11"](spark, FOLDER)
    assert scans(df) == {"customer", "orders"} and "EqualTo(o_custkey,9)" in df._jdf.queryExecution().executedPlan().toString()
    e = catalog.engine(spark, FOLDER)
    many = e.query("SELECT ?s ?p WHERE { ?s ?p ?o . FILTER(?o = <urn:t:part/7>) }", native=True).collect()
    assert many and sorted(e.query("SELECT ?s ?p WHERE { ?s ?p <urn:t:part/7> }", native=True).collect()) == sorted(many)
    name = f"'{spark.read.parquet(f'{FOLDER}/nation.parquet').first().n_name}'"
    for term in ("1", "'1'", "01", "1.0e0", name, "<urn:t:nation>", "<urn:t:region/001>", f"{name}@en", "true"):
        one = e.query(f"SELECT ?s ?p WHERE {{ GRAPH g:nation {{ ?s ?p {term} }} }}", native=True).collect()
        all_ = e.query(f"SELECT ?s ?p WHERE {{ GRAPH g:nation {{ ?s ?p ?o . FILTER(SAMETERM(?o, {term})) }} }}", native=True).collect()
        assert sorted(one) == sorted(all_), term
        assert bool(one) == (term in ("1", name, "<urn:t:nation>"))


def test_classes_are_counted_without_cells_or_subjects(spark):
    """of tables that the filter leaves out nothing is read, and no row is numbered or laid out as triples."""
    df = catalog.queries()["class_variable"](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert scans(df) == {"nation", "region", "supplier"} and "Generate" not in plan and "Window" not in plan


#: Queries over the store of tables: each scan of a constant predicate reads one folder, written without comparing or sorting terms.
BY_FOLDER = ["quads_filter", "quads_minus", "quads_blank_node", "quads_join", "quads_bind"]


@pytest.mark.parametrize("name", BY_FOLDER)
def test_quad_queries_read_folders(spark, name):
    text = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*", text)
    assert scans and all("PartitionFilters: [isnotnull(p#" in s for s in scans)
