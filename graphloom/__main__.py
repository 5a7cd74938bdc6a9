"""python -m graphloom serve | convert | query"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from graphloom.server import make_server
from graphloom.sources.rdfio import FORMATS
from graphloom.store import Store
from graphloom.terms import IRI, constant


def _format(path: str | None, given: str | None) -> str:
    out = given or (path or "").rsplit(".", 1)[-1]
    if out not in FORMATS:
        raise SystemExit(f"unknown format {out!r}: one of {', '.join(FORMATS)}")
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("graphloom")
    commands = parser.add_subparsers(dest="command", required=True)
    serve = commands.add_parser("serve", help="answer SPARQL over HTTP")
    serve.add_argument("--bind", default="localhost:7878")
    serve.add_argument("--cors", action="store_true")
    serve.add_argument("--union-default-graph", action="store_true")
    serve.add_argument("--load", action="append", default=[], metavar="FILE")
    convert = commands.add_parser("convert", help="from one RDF format to another")
    convert.add_argument("--from-file")
    convert.add_argument("--from-format")
    convert.add_argument("--to-file")
    convert.add_argument("--to-format")
    convert.add_argument("--from-graph", help="only this graph; 'default' for the default graph")
    convert.add_argument("--to-graph")
    convert.add_argument("--lenient", action="store_true")
    query = commands.add_parser("query", help="one query over files")
    query.add_argument("text")
    query.add_argument("--load", action="append", default=[], metavar="FILE")
    query.add_argument("--format", default="json")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, union_default=getattr(a, "union_default_graph", False))
    for path in getattr(a, "load", []):
        store.load_path(path, _format(path, None))
    if a.command == "serve":
        host, port = a.bind.rsplit(":", 1)
        make_server(store, host, int(port), a.cors).serve_forever()
    elif a.command == "query":
        sys.stdout.writelines(store.serialize(a.text, a.format))
    else:
        source, target = _format(a.from_file, a.from_format), _format(a.to_file, a.to_format)
        if a.from_file:
            store.load_path(a.from_file, source, a.lenient)
        else:
            store.load(sys.stdin.read(), source)
        if a.from_graph:
            name = None if a.from_graph == "default" else a.from_graph
            if name is not None and not store.contains_named_graph(name):
                raise SystemExit(f"no graph {name}")
            text = store.dump_graph(target, name)
        elif target in ("nq", "trig"):
            if a.to_graph:
                store.quads = store.quads.withColumn("graph", constant(IRI(a.to_graph)))
            text = store.dump(target)
        else:
            if store.named_graphs():
                raise SystemExit(f"{target} can't hold graphs: choose one with --from-graph")
            text = store.dump_graph(target)
        if a.to_file:
            with open(a.to_file, "w", encoding="utf-8") as f:
                f.writelines(text)
        else:
            sys.stdout.writelines(text)


if __name__ == "__main__":
    main()
