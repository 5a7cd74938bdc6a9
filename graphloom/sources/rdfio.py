"""RDF text formats.

N-Triples and N-Quads lines are split and parsed on the executors. Turtle, TriG and RDF/XML need their whole document,
so they are parsed in Python and made a DataFrame. Writers produce N-Triples, N-Quads, Turtle, TriG and RDF/XML.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import algebra as A
from graphloom.plans.parser import Parser, SparqlError, unescape
from graphloom.terms import QUADS, RDF, RDF_LANG, TERM_DDL, XSD_STRING, BNode, IRI, Literal, Term

Quad = tuple[Term | None, Term, Term, Term]  # graph, subject, predicate, object
FORMATS = {"nt": "application/n-triples", "nq": "application/n-quads", "ttl": "text/turtle", "trig": "application/trig", "rdf": "application/rdf+xml", "n3": "text/n3"}
_IRI, _BN, _LIT = r"<[^<>\x00-\x20]*>", r"_:[^\s<>]+?", r'"(?:[^"\\]|\\.)*"(?:\^\^<[^<>\x00-\x20]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
LINE = rf"^\s*({_IRI}|{_BN})\s*({_IRI})\s*({_IRI}|{_BN}|{_LIT})\s*({_IRI}|{_BN})?\s*\.\s*(?:#.*)?$"


# Lines
def _plain(c: Column) -> Column:
    """Escapes of N-Triples; texts without a backslash are taken as they are."""
    return F.when(~c.contains("\\"), c).otherwise(_unescaped(c))


def _unescaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\ue000"))
    for k, v in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'")):
        out = F.replace(out, F.lit(f"\\{k}"), F.lit(v))
    # \uXXXX and \UXXXXXXXX: the text is cut at them, and each piece begins with a code.
    parts = F.split(out, r"\\(?=[uU])", -1)

    def one(x: Column, i: Column) -> Column:
        long = x.startswith("U")
        code = F.conv(F.when(long, F.substring(x, 2, 8)).otherwise(F.substring(x, 2, 4)), 16, 10).cast("int")
        rest = F.when(long, F.substring(x, 10, 1 << 30)).otherwise(F.substring(x, 6, 1 << 30))
        utf8 = F.decode(F.unhex(_utf8_hex(code)), "UTF-8")
        return F.when(i == 0, x).otherwise(F.concat(utf8, rest))

    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("\ue000"), F.lit("\\"))


def _utf8_hex(c: Column) -> Column:
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda k: byte(F.shiftright(c, 6 * k).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)))
    return (
        F.when(c < 0x80, byte(c))
        .when(c < 0x800, F.concat(byte(F.shiftright(c, 6).bitwiseOR(F.lit(0xC0))), tail(0)))
        .when(c < 0x10000, F.concat(byte(F.shiftright(c, 12).bitwiseOR(F.lit(0xE0))), tail(1), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(c, 18).bitwiseOR(F.lit(0xF0))), tail(2), tail(1), tail(0)))
    )


def _term(c: Column, scope: str) -> Column:
    """A term from its N-Triples text; null for no text. Blank nodes are renamed with `scope`."""
    body = F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<[^<>]*>|@[A-Za-z0-9\-]+)?$', 1)
    dt = F.regexp_extract(c, r'"\^\^<([^<>]*)>$', 1)
    lang = F.regexp_extract(c, r'"@([A-Za-z0-9\-]+)$', 1)
    make = lambda kind, lex, d=None, g=None: F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), (d if d is not None else F.lit(None)).cast("string").alias("dt"), (g if g is not None else F.lit(None)).cast("string").alias("lang"))
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast(TERM_DDL))
        .when(c.startswith("<"), make(0, _plain(F.substring(c, F.lit(2), F.char_length(c) - 2))))
        .when(c.startswith("_:"), make(1, F.concat(F.lit(scope), F.substring(c, 3, 1 << 30))))
        .when(lang != "", make(2, _plain(body), F.lit(RDF_LANG), F.lower(lang)))
        .otherwise(make(2, _plain(body), F.when(dt != "", _plain(dt)).otherwise(XSD_STRING)))
    )


def read_lines(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Quads of N-Triples or N-Quads files, however large. A bad line fails the read, or is left out if `lenient`."""
    scope = uuid.uuid4().hex[:12]
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(LINE)
    if lenient:
        lines = lines.filter(good)
    part = lambda k: F.when(good, F.regexp_extract("value", LINE, k)).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))).cast("string"))
    laid = lines.select(part(4).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    return laid.select(_term(F.col("g"), scope).alias("graph"), _term(F.col("s"), scope).alias("subject"), _term(F.col("p"), scope).alias("predicate"), _term(F.col("o"), scope).alias("object"))


# Documents
class _Turtle(Parser):
    """Turtle and TriG with the query parser's terms; blank nodes are constants."""

    def __init__(self, text: str, base: str | None, scope: str):
        super().__init__(text, base)
        self.in_template, self.scope, self.out, self.graph = True, scope, [], None

    def anonymous(self):
        self.fresh += 1
        return BNode(f"{self.scope}-{self.fresh}")

    def named(self, n):
        return BNode(f"{self.scope}{n.label}") if isinstance(n, BNode) and not n.label.startswith(self.scope) else n

    def at_graph(self) -> bool:
        kind, text = self.peek()
        return (kind in ("iri", "pname", "bnode") and self.peek(1)[1] == "{") or (text == "[" and self.peek(1)[1] == "]" and self.peek(2)[1] == "{")

    def at_triples(self) -> bool:
        return super().at_triples() and not self.at_graph()

    def emit(self) -> None:
        for t in self.triples_block():
            if not isinstance(t, A.Triple):
                raise SparqlError("a path isn't a triple")
            s, p, o = map(self.named, (t.s, t.p, t.o))
            if any(isinstance(x, A.Var) for x in (s, p, o)) or isinstance(s, Literal):
                raise SparqlError("not a triple")
            self.out.append((self.graph, s, p, o))

    def document(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "lang" and text in ("@prefix", "@base") or self.is_word("PREFIX", "BASE"):
                self.at += 1
                if text.lower().endswith("prefix"):
                    name = self.take()
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if kind == "lang":
                    self.need(".")
            elif self.is_op("{"):
                self.block(None)
            elif self.word("GRAPH"):
                self.block(self.named(self.term()))
            elif self.at_graph():
                self.block(self.named(self.term()))
            else:
                before = self.at
                self.emit()
                if self.at == before:
                    raise SparqlError(f"unexpected {text!r}")
        return self.out

    def block(self, graph) -> None:
        self.need("{")
        self.graph = graph
        while not self.op("}"):
            before = self.at
            self.emit()
            if self.at == before and not self.is_op("}"):
                raise SparqlError(f"unexpected {self.peek()[1]!r}")
        self.graph = None


def parse_rdf_xml(text: str, base: str | None, scope: str) -> list[Quad]:
    root, out, count = ET.fromstring(text), [], [0]
    xml = "{http://www.w3.org/XML/1998/namespace}"
    rdf = f"{{{RDF}}}"
    name = lambda tag: tag[1:].replace("}", "", 1)

    def fresh() -> BNode:
        count[0] += 1
        return BNode(f"{scope}-{count[0]}")

    def subject_of(e, here: str | None) -> Term:
        if rdf + "about" in e.attrib:
            return IRI(urljoin(here or "", e.attrib[rdf + "about"]))
        if rdf + "ID" in e.attrib:
            return IRI(urljoin(here or "", "#" + e.attrib[rdf + "ID"]))
        if rdf + "nodeID" in e.attrib:
            return BNode(scope + e.attrib[rdf + "nodeID"])
        return fresh()

    def node(e, here, lang) -> Term:
        here, lang = e.attrib.get(xml + "base", here), e.attrib.get(xml + "lang", lang)
        s = subject_of(e, here)
        if e.tag != rdf + "Description":
            out.append((None, s, IRI(RDF + "type"), IRI(name(e.tag))))
        for k, v in e.attrib.items():
            if k == rdf + "type":
                out.append((None, s, IRI(RDF + "type"), IRI(urljoin(here or "", v))))
            elif not k.startswith((xml, rdf)) and k.startswith("{"):
                out.append((None, s, IRI(name(k)), Literal(v, lang=lang) if lang else Literal(v)))
        item = 0
        for p in e:
            tag = name(p.tag)
            if p.tag == rdf + "li":
                item += 1
                tag = f"{RDF}_{item}"
            prop(s, IRI(tag), p, p.attrib.get(xml + "base", here), p.attrib.get(xml + "lang", lang))
        return s

    def prop(s, p, e, here, lang) -> None:
        kind = e.attrib.get(rdf + "parseType")
        if rdf + "resource" in e.attrib:
            o: Term = IRI(urljoin(here or "", e.attrib[rdf + "resource"]))
        elif rdf + "nodeID" in e.attrib:
            o = BNode(scope + e.attrib[rdf + "nodeID"])
        elif kind == "Resource":
            o = fresh()
            for x in e:
                prop(o, IRI(name(x.tag)), x, here, lang)
        elif kind == "Collection":
            items = [node(x, here, lang) for x in e]
            o = IRI(RDF + "nil")
            for x in reversed(items):
                cell = fresh()
                out.append((None, cell, IRI(RDF + "first"), x))
                out.append((None, cell, IRI(RDF + "rest"), o))
                o = cell
        elif kind == "Literal":
            o = Literal((e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e), RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], here, lang)
        elif rdf + "datatype" in e.attrib:
            o = Literal(e.text or "", urljoin(here or "", e.attrib[rdf + "datatype"]))
        else:
            o = Literal(e.text or "", lang=lang) if lang else Literal(e.text or "")
        out.append((None, s, p, o))

    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, root.attrib.get(xml + "base", base), root.attrib.get(xml + "lang"))
    return out


def parse(text: str, format: str, base: str | None = None, scope: str | None = None) -> list[Quad]:
    """Quads of one document; blank nodes get new labels."""
    scope = scope or "b" + uuid.uuid4().hex[:12]
    if format == "rdf":
        return parse_rdf_xml(text, base, scope)
    out = []
    if format in ("nt", "nq"):
        for line in text.splitlines():
            if not re.match(r"^\s*(#.*)?$", line):
                m = re.match(LINE, line)
                if not m:
                    raise SparqlError(f"bad line: {line}")
                s, p, o, g = (None if x is None else _from_line(x, scope) for x in m.groups())
                out.append((g, s, p, o))
        return out
    out = _Turtle(text, base, scope).document()
    if format in ("ttl", "n3") and any(q[0] is not None for q in out):
        raise SparqlError("Turtle has no graphs")
    return out


def _from_line(text: str, scope: str) -> Term:
    if text[0] == "<":
        return IRI(unescape(text[1:-1]))
    if text[0] == "_":
        return BNode(scope + text[2:])
    m = re.match(r'(?s)^"(.*)"(?:\^\^<(.*)>|@([A-Za-z0-9\-]+))?$', text)
    return Literal(unescape(m[1]), unescape(m[2]) if m[2] else XSD_STRING, m[3].lower() if m[3] else None)


def to_frame(spark: SparkSession, quads: Iterable[Quad]) -> DataFrame:
    return spark.createDataFrame([tuple(None if t is None else t.row() for t in q) for q in quads], QUADS)


# Writers
def _quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def term_text(c: Column) -> Column:
    """A term in N-Triples."""
    tail = F.when(c["lang"].isNotNull(), F.concat(F.lit("@"), c["lang"])).when(c["dt"] != XSD_STRING, F.concat(F.lit("^^<"), c["dt"], F.lit(">"))).otherwise("")
    return F.when(c["kind"] == 0, F.concat(F.lit("<"), c["lex"], F.lit(">"))).when(c["kind"] == 1, F.concat(F.lit("_:"), c["lex"])).otherwise(F.concat(_quoted(c["lex"]), tail))


def line_frame(quads: DataFrame, graphs: bool) -> DataFrame:
    """One text column of N-Quads (or N-Triples) lines, to be written in parallel."""
    parts = [term_text(F.col(c)) for c in ("subject", "predicate", "object")]
    if graphs:
        parts.append(F.when(F.col("graph").isNotNull(), term_text(F.col("graph"))))
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def show(t: Term) -> str:
    if isinstance(t, IRI):
        return f"<{t.value}>"
    if isinstance(t, BNode):
        return f"_:{t.label}"
    body = '"' + t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    return body + (f"@{t.lang}" if t.lang else "" if t.dt == XSD_STRING else f"^^<{t.dt}>")


def serialize(quads: Iterable[Quad], format: str) -> Iterator[str]:
    """Text of a document, piece by piece. Turtle and TriG group what comes one after another."""
    if format in ("nt", "nq"):
        for g, s, p, o in quads:
            yield f"{show(s)} {show(p)} {show(o)}{f' {show(g)}' if g is not None and format == 'nq' else ''} .\n"
    elif format in ("ttl", "trig", "n3"):
        before: tuple | None = None
        for g, s, p, o in quads:
            if format != "trig":
                g = None
            if before and before[:2] == (g, s):
                yield f" ;\n    {show(p)} {show(o)}"
            else:
                if before:
                    yield " .\n" + ("}\n" if before[0] is not None and before[0] != g else "")
                if g is not None and (before is None or before[0] != g):
                    yield f"{show(g)} {{\n"
                yield f"{show(s)} {show(p)} {show(o)}"
            before = (g, s)
        if before:
            yield " .\n" + ("}\n" if before[0] is not None else "")
    elif format == "rdf":
        yield f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n'
        for _, s, p, o in quads:
            cut = re.search(r"[A-Za-z_][\w.\-]*$", p.value)
            if not cut or cut.start() == 0:
                raise ValueError(f"{p.value} has no XML name")
            who = f"rdf:about={quoteattr(s.value)}" if isinstance(s, IRI) else f"rdf:nodeID={quoteattr(s.label)}"
            tag, ns = f"n:{cut[0]}", f"xmlns:n={quoteattr(p.value[: cut.start()])}"
            if isinstance(o, IRI):
                inner = f"<{tag} {ns} rdf:resource={quoteattr(o.value)}/>"
            elif isinstance(o, BNode):
                inner = f"<{tag} {ns} rdf:nodeID={quoteattr(o.label)}/>"
            else:
                extra = f" xml:lang={quoteattr(o.lang)}" if o.lang else "" if o.dt == XSD_STRING else f" rdf:datatype={quoteattr(o.dt)}"
                inner = f"<{tag} {ns}{extra}>{escape(o.lex)}</{tag}>"
            yield f"<rdf:Description {who}>{inner}</rdf:Description>\n"
        yield "</rdf:RDF>\n"
    else:
        raise ValueError(f"unknown format {format!r}")

