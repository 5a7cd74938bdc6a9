"""Random queries against a small interpreter of the algebra over Python dictionaries."""

import random

import pytest

from graphloom.engine import Engine
from graphloom.plans import algebra as A
from graphloom.sources.quads import QuadTableSource
from graphloom.sources.rdfio import to_frame
from graphloom.streaming.results import solutions
from graphloom.terms import XSD, IRI, Literal

NODES = [IRI(f"n:{k}") for k in range(5)]
PREDICATES = [IRI(f"p:{k}") for k in range(3)]
VARS = [A.Var(v) for v in "abcd"]


def number(k):
    return Literal(str(k), XSD + "integer")


def compatible(x, y):
    return all(x[k] == y[k] for k in x.keys() & y.keys())


def evaluate(p, triples, outer={}):
    """Solutions as a list of dictionaries. Expressions see `outer`, too: the solution for which an EXISTS is asked."""
    match p:
        case A.BGP(ts):
            out = [{}]
            for t in ts:
                after = []
                for s in out:
                    for triple in triples:
                        new = dict(s)
                        for node, term in zip((t.s, t.p, t.o), triple):
                            if isinstance(node, A.Var):
                                if new.setdefault(node.name, term) != term:
                                    break
                            elif node != term:
                                break
                        else:
                            after.append(new)
                out = after
            return out
        case A.Join(a, b):
            right = evaluate(b, triples, outer)
            return [x | y for x in evaluate(a, triples, outer) for y in right if compatible(x, y)]
        case A.LeftJoin(a, b, c):
            out, right = [], evaluate(b, triples, outer)
            for x in evaluate(a, triples, outer):
                met = [x | y for y in right if compatible(x, y) and (c is None or holds(c, x | y, triples, outer))]
                out += met or [x]
            return out
        case A.Union(a, b):
            return evaluate(a, triples, outer) + evaluate(b, triples, outer)
        case A.Minus(a, b):
            right = evaluate(b, triples, outer)
            return [x for x in evaluate(a, triples, outer) if not any(compatible(x, y) and x.keys() & y.keys() for y in right)]
        case A.Filter(c, q):
            return [x for x in evaluate(q, triples, outer) if holds(c, x, triples, outer)]
    raise NotImplementedError


def holds(c, x, triples, outer):
    if isinstance(c, A.Exists):
        return any(compatible(x, y) for y in evaluate(c.pattern, triples, outer | x)) != c.negated
    return test(c, outer | x)


def test(c, x):
    """BOUND, = and != between variables; None is an error."""
    if c.name == "BOUND":
        return c.args[0].name in x
    a, b = (x.get(v.name) for v in c.args)
    if a is None or b is None:
        return None
    if isinstance(a, Literal) and isinstance(b, Literal):
        eq = int(a.lex) == int(b.lex)
    else:
        eq = a == b
    return eq if c.name == "=" else not eq


test.__test__ = False


def random_bgp(rng):
    def triple():
        o = rng.choice([*VARS, *VARS, rng.choice(NODES), number(rng.randint(0, 2))])
        return A.Triple(rng.choice([*VARS, *VARS, rng.choice(NODES)]), rng.choice([*PREDICATES, *PREDICATES, rng.choice(VARS)]), o)

    return A.BGP(tuple(triple() for _ in range(rng.randint(1, 2))))


def random_pattern(rng, depth):
    if depth == 0:
        return random_bgp(rng)
    a, b = random_pattern(rng, depth - 1), random_pattern(rng, depth - 1)
    condition = rng.choice([A.Call("BOUND", (rng.choice(VARS),)), A.Call("=", (rng.choice(VARS), rng.choice(VARS))), A.Call("!=", (rng.choice(VARS), rng.choice(VARS)))])
    return rng.choice([A.Join(a, b), A.LeftJoin(a, b), A.LeftJoin(a, b, condition), A.Union(a, b), A.Minus(a, b), A.Filter(condition, a), A.Filter(exists(rng), a), A.LeftJoin(a, b, exists(rng))])


def exists(rng):
    """An EXISTS whose inner filters may name outer variables at any depth."""
    parts = []
    for _ in range(2):
        c = rng.choice([A.Call("BOUND", (rng.choice(VARS),)), A.Call("=", (rng.choice(VARS), rng.choice(VARS))), A.Call("!=", (rng.choice(VARS), rng.choice(VARS)))])
        parts.append(rng.choice([random_bgp(rng), A.Filter(c, random_bgp(rng))]))
    return A.Exists(rng.choice([parts[0], A.Join(*parts), A.Union(*parts), A.Filter(A.Call("!=", (rng.choice(VARS), rng.choice(VARS))), A.Union(*parts))]), rng.random() < 0.4)


@pytest.mark.parametrize("seed", range(40))
def test_random_patterns(spark, seed):
    rng = random.Random(seed)
    triples = list({(rng.choice(NODES), rng.choice(PREDICATES), rng.choice([*NODES, number(0), number(1)])) for _ in range(12)})
    p = random_pattern(rng, 2)
    names = tuple(A.in_scope(p))
    engine = Engine(spark, QuadTableSource(to_frame(spark, [(None, *t) for t in triples])))
    got = [tuple(sorted((k, str(v)) for k, v in s.items())) for s in solutions(engine.query(A.Query("SELECT", A.Project(p, names), names=names)))]
    want = [tuple(sorted((k, str(v)) for k, v in s.items())) for s in evaluate(p, triples)]
    assert sorted(got) == sorted(want)
