"""Results delivered row by row: solutions, serialised documents, and readers of such documents."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from graphloom.plans.parser import Parser
from graphloom.sources.rdfio import show
from graphloom.terms import XSD, XSD_STRING, BNode, IRI, Literal, Term, term_of

NS = "http://www.w3.org/2005/sparql-results#"
FORMATS = {"json": "application/sparql-results+json", "xml": "application/sparql-results+xml", "csv": "text/csv", "tsv": "text/tab-separated-values"}
Solution = dict[str, Term]


def solutions(df: DataFrame) -> Iterator[Solution]:
    """Solutions of a frame of term columns, one partition at a time in the driver."""
    for row in df.toLocalIterator():
        yield {n: term_of(v) for n, v in zip(df.columns, row) if v is not None}


def _json(t: Term) -> dict:
    if isinstance(t, IRI):
        return {"type": "uri", "value": t.value}
    if isinstance(t, BNode):
        return {"type": "bnode", "value": t.label}
    return {"type": "literal", "value": t.lex} | ({"xml:lang": t.lang} if t.lang else {"datatype": t.dt} if t.dt != XSD_STRING else {})


def _xml(t: Term) -> str:
    if isinstance(t, IRI):
        return f"<uri>{escape(t.value)}</uri>"
    if isinstance(t, BNode):
        return f"<bnode>{escape(t.label)}</bnode>"
    extra = f" xml:lang={quoteattr(t.lang)}" if t.lang else f" datatype={quoteattr(t.dt)}" if t.dt != XSD_STRING else ""
    return f"<literal{extra}>{escape(t.lex)}</literal>"


def _csv(t: Term | None) -> str:
    text = "" if t is None else t.value if isinstance(t, IRI) else f"_:{t.label}" if isinstance(t, BNode) else t.lex
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def _tsv(t: Term | None) -> str:
    if t is None:
        return ""
    if isinstance(t, Literal) and t.dt == XSD + "integer" and t.lex.lstrip("+-").isdigit():
        return t.lex
    return show(t)


def write_solutions(names: list[str], rows: Iterator[Solution], format: str) -> Iterator[str]:
    if format == "json":
        yield json.dumps({"head": {"vars": names}})[:-1] + ', "results": {"bindings": ['
        for k, r in enumerate(rows):
            yield (", " if k else "") + json.dumps({n: _json(t) for n, t in r.items()}, ensure_ascii=False)
        yield "]}}"
    elif format == "xml":
        yield f'<?xml version="1.0"?><sparql xmlns="{NS}"><head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head><results>"
        for r in rows:
            yield "<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml(t)}</binding>" for n, t in r.items()) + "</result>"
        yield "</results></sparql>"
    elif format == "csv":
        yield ",".join(names) + "\r\n"
        for r in rows:
            yield ",".join(_csv(r.get(n)) for n in names) + "\r\n"
    elif format == "tsv":
        yield "\t".join(f"?{n}" for n in names) + "\n"
        for r in rows:
            yield "\t".join(_tsv(r.get(n)) for n in names) + "\n"
    else:
        raise ValueError(f"unknown format {format!r}")


def write_boolean(value: bool, format: str) -> str:
    word = "true" if value else "false"
    if format == "json":
        return json.dumps({"head": {}, "boolean": value})
    return f'<?xml version="1.0"?><sparql xmlns="{NS}"><head></head><boolean>{word}</boolean></sparql>' if format == "xml" else word


def read_results(text: str, format: str) -> bool | tuple[list[str], list[Solution]]:
    """A result document read back: its boolean, or its variables and solutions. Unknown keys are passed over."""
    if format == "json":
        doc = json.loads(text)
        if "boolean" in doc:
            return doc["boolean"]
        names = list(doc["head"].get("vars", []))
        if len(set(names)) < len(names):
            raise ValueError("a variable is declared twice")

        def term(x: dict) -> Term:
            if x["type"] in ("uri", "bnode"):
                return IRI(x["value"]) if x["type"] == "uri" else BNode(x["value"])
            return Literal(x["value"], x.get("datatype", XSD_STRING), x.get("xml:lang"))

        return names, [{n: term(t) for n, t in b.items()} for b in doc["results"]["bindings"]]
    if format == "xml":
        root, at = ET.fromstring(text), f"{{{NS}}}"
        if (b := root.find(f"{at}boolean")) is not None:
            return b.text.strip() == "true"
        names = [v.attrib["name"] for v in root.iter(f"{at}variable")]
        if len(set(names)) < len(names):
            raise ValueError("a variable is declared twice")

        def value(e) -> Term:
            if e.tag == f"{at}uri":
                return IRI(e.text or "")
            if e.tag == f"{at}bnode":
                return BNode(e.text or "")
            return Literal(e.text or "", e.attrib.get("datatype", XSD_STRING), e.attrib.get("{http://www.w3.org/XML/1998/namespace}lang"))

        return names, [{b.attrib["name"]: value(b[0]) for b in r} for r in root.iter(f"{at}result")]
    if format == "tsv":
        lines = text.rstrip("\n").split("\n")
        if lines[0].strip() in ("true", "false"):
            return lines[0].strip() == "true"
        names = [n.lstrip("?$") for n in lines[0].split("\t")] if lines[0] else []
        if len(set(names)) < len(names):
            raise ValueError("a variable is declared twice")

        def cell(x: str) -> Term:
            p = Parser(x)
            p.in_template = True
            return p.term(variables=False)

        return names, [{n: cell(x) for n, x in zip(names, line.split("\t")) if x} for line in lines[1:]]
    if format == "csv":
        head, *rows = list(csv.reader(io.StringIO(text)))
        return head, [{n: Literal(x) for n, x in zip(head, r) if x} for r in rows]
    raise ValueError(f"unknown format {format!r}")
