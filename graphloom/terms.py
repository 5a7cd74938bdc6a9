"""RDF terms in Python and as Spark columns.

A term column is a struct (kind, lex, dt, lang): kind 0 IRI, 1 blank node, 2 literal. Simple literals have dt xsd:string;
tagged ones rdf:langString. Struct equality is term identity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE, RDF_LANG = RDF + "type", RDF + "langString"
XSD_STRING = XSD + "string"
TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
TERM_DDL = "struct<kind:tinyint,lex:string,dt:string,lang:string>"
QUADS = T.StructType([T.StructField(n, TERM) for n in ("graph", "subject", "predicate", "object")])
#: The datatypes that count as integers, and those of each other number type.
INTEGERS = ("integer", "byte", "short", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "positiveInteger", "negativeInteger", "nonPositiveInteger", "nonNegativeInteger")


@dataclass(frozen=True)
class IRI:
    value: str

    def row(self) -> tuple:
        return (0, self.value, None, None)


@dataclass(frozen=True)
class BNode:
    label: str

    def row(self) -> tuple:
        return (1, self.label, None, None)


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str = XSD_STRING
    lang: str | None = None

    def row(self) -> tuple:
        return (2, self.lex, RDF_LANG if self.lang else self.dt, self.lang.lower() if self.lang else None)


Term = IRI | BNode | Literal


def term_of(row) -> Term | None:
    if row is None:
        return None
    if row[0] == 0:
        return IRI(row[1])
    return BNode(row[1]) if row[0] == 1 else Literal(row[1], row[2], row[3])


def term_column(kind, lex: Column, dt=None, lang=None) -> Column:
    """A term; null where `lex` is null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    built = F.struct(lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), lit(dt).cast("string").alias("dt"), lit(lang).cast("string").alias("lang"))
    return F.when(lex.isNotNull(), built)


def constant(term: Term) -> Column:
    kind, lex, dt, lang = term.row()
    return term_column(kind, F.lit(lex), dt, lang)
