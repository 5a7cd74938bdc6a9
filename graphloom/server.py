"""HTTP: GET and POST /repositories/default/query, POST /repositories/default/data."""

from __future__ import annotations

from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from graphloom.plans.algebra import Query
from graphloom.plans.parser import SparqlError
from graphloom.sources import rdfio
from graphloom.store import Store
from graphloom.streaming import results
from graphloom.terms import term_of

RESULT_TYPES = {v: k for k, v in results.FORMATS.items()} | {"application/json": "json", "application/xml": "xml"}
RDF_TYPES = {v: k for k, v in rdfio.FORMATS.items()}
BASE = "http://localhost/repositories/default/query"


def choose(accept: str, types: dict[str, str], default: str) -> tuple[str, str] | None:
    """The media type and format that an Accept header likes best; None if none will do."""
    wanted = []
    for k, part in enumerate((accept or "*/*").split(",")):
        kind, *params = (x.strip() for x in part.split(";"))
        q = next((float(p[2:]) for p in params if p.startswith("q=")), 1.0)
        wanted.append((-q, k, kind))
    for q, _, kind in sorted(wanted):
        if q == 0:
            continue
        if kind == "*/*":
            return next(m for m, f in types.items() if f == default), default
        for m, f in types.items():
            if kind == m or (kind.endswith("/*") and m.startswith(kind[:-1])):
                return m, f
    return None


def description() -> str:
    """What this endpoint offers, in Turtle."""
    sd, formats = "http://www.w3.org/ns/sparql-service-description#", "http://www.w3.org/ns/formats/"
    names = {"json": "SPARQL_Results_JSON", "xml": "SPARQL_Results_XML", "csv": "SPARQL_Results_CSV", "tsv": "SPARQL_Results_TSV", "nt": "N-Triples", "nq": "N-Quads", "ttl": "Turtle", "trig": "TriG", "rdf": "RDF_XML", "n3": "N3"}
    out = " , ".join(f"<{formats}{names[f]}>" for f in [*results.FORMATS, *rdfio.FORMATS])
    return f"@prefix sd: <{sd}> .\n[] a sd:Service ;\n  sd:endpoint <{BASE}> ;\n  sd:supportedLanguage sd:SPARQL11Query ;\n  sd:resultFormat {out} .\n"


def answer(store: Store, text: str, accept: str, default: list[str] = (), named: list[str] = ()) -> tuple[int, str, str | Iterator[str]]:
    """Status, media type and body; a result comes in pieces, so that no more than some rows are in the driver at a time."""
    engine = store.engine
    engine.base = engine.base or BASE
    try:
        q = engine.parse(text)
    except SparqlError as e:
        return 400, "text/plain", str(e)
    if default or named:
        q = Query(q.form, q.pattern, q.template, q.describe, tuple(default), tuple(named), q.base, q.names)
    graph = q.form in ("CONSTRUCT", "DESCRIBE")
    chosen = choose(accept, RDF_TYPES if graph else RESULT_TYPES, "nt" if graph else "json")
    if chosen is None:
        return 406, "text/plain", "no acceptable format"
    media, form = chosen
    df = engine.query(q)
    if q.form == "SELECT":
        return 200, media, results.write_solutions(list(df.columns), results.solutions(df), form)
    if q.form == "ASK":
        return 200, media, results.write_boolean(bool(df.first()[0]), form)
    triples = ((None, *map(term_of, r)) for r in df.toLocalIterator())
    return 200, media, rdfio.serialize(triples, form)


def make_server(store: Store, host: str = "localhost", port: int = 7878, cors: bool = False) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, kind: str, body: str | Iterator[str]) -> None:
            """Text has a length; pieces end with the connection. The first is made before the status is sent."""
            pieces = iter([body] if isinstance(body, str) else body)
            first = next(pieces, "")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if isinstance(body, str):
                self.send_header("Content-Length", str(len(body.encode())))
            else:
                self.send_header("Connection", "close")
            if cors:
                self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.begun = True
            self.wfile.write(first.encode())
            for piece in pieces:
                self.wfile.write(piece.encode())

        def run(self, params: dict[str, list[str]]) -> None:
            text, self.begun = params.get("query", [""])[0], False
            if not text:
                self.send(200, "text/turtle", description())
                return
            try:
                self.send(*answer(store, text, self.headers.get("Accept", ""), params.get("default-graph-uri", []), params.get("named-graph-uri", [])))
            except Exception as e:  # a failed query must not end the server
                if self.begun:
                    self.close_connection = True
                    return
                self.send(500, "text/plain", str(e)[:2000])

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/repositories/default/query":
                self.run(parse_qs(url.query))
            else:
                self.send(404, "text/plain", "not found")

        def do_POST(self) -> None:
            url, kind = urlsplit(self.path), (self.headers.get("Content-Type") or "").split(";")[0].strip()
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            params = parse_qs(url.query)
            if url.path == "/repositories/default/query":
                if kind == "application/sparql-query":
                    self.run(params | {"query": [body]})
                else:
                    self.run(params | parse_qs(body))
            elif url.path == "/repositories/default/data":
                if kind not in RDF_TYPES:
                    self.send(415, "text/plain", f"unknown media type {kind}")
                    return
                try:
                    store.load(body, RDF_TYPES[kind], to_graph=params.get("graph", [None])[0])
                    self.send(204, "text/plain", "")
                except ValueError as e:
                    self.send(400, "text/plain", str(e))
            else:
                self.send(404, "text/plain", "not found")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
