"""Solutions as DataFrames: one physical column for each variable, and which variables are certainly bound."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import NULL, Val, common, meets

_numbers = count()


def fresh(name: str) -> str:
    return f"{name.strip('?') or 'v'}_{next(_numbers)}"


@dataclass
class Rel:
    """`vars`: each variable's value over `df`'s columns, which hold nothing else. `bound`: variables that are never null."""

    df: DataFrame
    vars: dict[str, Val] = field(default_factory=dict)
    bound: frozenset[str] = frozenset()

    def value(self, name: str) -> Val:
        return self.vars.get(name, NULL)

    def filter(self, condition: Column) -> Rel:
        return Rel(self.df.filter(condition), self.vars, self.bound)

    def keep(self, names) -> Rel:
        return build(self.df, {n: self.vars[n] for n in names if n in self.vars}, self.bound)

    def renamed(self, names: dict[str, str]) -> Rel:
        return Rel(self.df, {names.get(n, n): v for n, v in self.vars.items()}, frozenset(names.get(n, n) for n in self.bound))


def build(df: DataFrame, vals: dict[str, Val], bound=frozenset()) -> Rel:
    """A relation of `vals`, expressions over `df`, under new column names. With no variable a row still counts."""
    cols, out = [], {}
    for n, v in vals.items():
        c = fresh(n)
        cols.append(v.col.alias(c))
        out[n] = Val(v.type, F.col(f"`{c}`"), v.extra, made=v.made)
    return Rel(df.select(*cols), out, frozenset(bound) & set(vals))


def union(rels: list[Rel]) -> Rel:
    names = list(dict.fromkeys(n for r in rels for n in r.vars))
    both = {n: common([r.value(n) for r in rels]) for n in names}
    bound = frozenset.intersection(*(r.bound for r in rels))
    cols = {n: fresh(n) for n in names}
    out = None
    for k, r in enumerate(rels):
        df = r.df.select(*(both[n][k].col.alias(cols[n]) for n in names))
        out = df if out is None else out.unionByName(df)
    return Rel(out, {n: Val(both[n][0].type, F.col(f"`{cols[n]}`"), both[n][0].extra, made=any(v.made for v in both[n])) for n in names}, bound)


def compatible(l: Rel, r: Rel, names) -> Column:
    """Equal where both are bound."""
    out = F.lit(True)
    for n in names:
        a, b = l.value(n), r.value(n)
        if "null" in (a.type, b.type):
            continue
        eq = meets(a, b)
        for side, v in ((l, a), (r, b)):
            if n not in side.bound:
                eq = v.col.isNull() | eq
        out = eq if out is None else out & eq
    return out


def _all_bound(rel: Rel, names) -> tuple[Rel, Rel | None]:
    """The rows with all of `names` bound, and the rest (None: there can't be any)."""
    loose = [n for n in names if n not in rel.bound]
    if not loose:
        return rel, None
    ok = F.lit(True)
    for n in loose:
        ok = ok & rel.value(n).col.isNotNull()
    rest = rel.filter(~ok)
    if len(loose) == 1:  # null in all rows of the rest, so that the others can be compared by equality
        rest = Rel(rest.df, rest.vars | {loose[0]: NULL}, rest.bound)
    return Rel(rel.df.filter(ok), rel.vars, rel.bound | set(loose)), rest


def merged(l: Rel, r: Rel) -> dict[str, Val]:
    """The variables of joined rows, over the columns of both sides."""
    out = {}
    for n in dict.fromkeys([*l.vars, *r.vars]):
        if n not in r.vars or n in l.bound:
            out[n] = l.vars[n]
        elif n not in l.vars or n in r.bound:
            out[n] = r.vars[n]
        else:
            a, b = common([l.vars[n], r.vars[n]])
            out[n] = Val(a.type, F.coalesce(a.col, b.col), a.extra, made=a.made or b.made)
    return out


def _pairs(l: Rel, r: Rel) -> tuple[list[str], list[tuple[Rel, Rel]]]:
    """Shared variables, and parts of both sides whose joins make up the whole.

    Rows with every shared variable bound on both sides meet by equality; only rows with an unbound one need comparing with all.
    """
    shared = [n for n in l.vars if n in r.vars and l.vars[n].type != "null" and r.vars[n].type != "null"]
    (lf, lr), (rf, rr) = _all_bound(l, shared), _all_bound(r, shared)
    parts = [(lf, rf)]
    if rr is not None:
        parts.append((lf, rr))
    if lr is not None:
        parts.append((lr, r))
    return shared, parts


def join(l: Rel, r: Rel, condition=None) -> Rel:
    """Rows of both sides that agree on the variables bound in both; `condition` maps joined variables to a filter."""
    shared, parts = _pairs(l, r)
    done = []
    for a, b in parts:
        on = compatible(a, b, shared) if shared else None
        if condition is not None:
            extra = condition(merged(a, b))
            on = extra if on is None else on & extra
        df = a.df.crossJoin(b.df) if on is None else a.df.join(b.df, on)
        done.append(build(df, merged(a, b), l.bound | r.bound))
    return done[0] if len(done) == 1 else union(done)


def without(l: Rel, r: Rel, condition=None, names=None) -> Rel:
    """The rows of `l` that no row of `r` matches."""
    shared, _ = _pairs(l, r)
    (lf, lr), (rf, rr) = _all_bound(l, shared), _all_bound(r, shared)

    def anti(a: Rel, b: Rel) -> Rel:
        on = compatible(a, b, shared)
        if condition is not None:
            on = on & condition(merged(a, b))
        return Rel(a.df.join(b.df, on, "left_anti"), a.vars, a.bound)

    out = anti(lf, rf)
    if rr is not None:
        out = anti(out, rr)
    if lr is None:
        return out
    rest = anti(lr, r)
    return Rel(out.df.unionByName(rest.df), l.vars, l.bound)


def semi(l: Rel, r: Rel, condition=None) -> Rel:
    """The rows of `l` that some row of `r` matches."""
    shared, _ = _pairs(l, r)
    if not shared and condition is None:
        return Rel(l.df.join(r.df.limit(1).select(), F.lit(True), "left_semi"), l.vars, l.bound)
    (lf, lr), (rf, rr) = _all_bound(l, shared), _all_bound(r, shared)

    def met(a: Rel, b: Rel, kind: str = "left_semi") -> DataFrame:
        on = compatible(a, b, shared)
        if condition is not None:
            on = on & condition(merged(a, b))
        return a.df.join(b.df, on, kind)

    out = met(lf, rf)
    if rr is not None:  # rows that an all-bound row matched already aren't asked again
        out = out.unionByName(met(Rel(met(lf, rf, "left_anti"), lf.vars, lf.bound), rr))
    if lr is not None:
        out = out.unionByName(met(lr, r))
    return Rel(out, l.vars, l.bound)


def lacking(l: Rel, r: Rel) -> Rel:
    """The rows of `l` that aren't among those of `r`, which has the same variables; unbound is equal to unbound."""
    on = F.lit(True)
    for n in l.vars:
        a, b = l.vars[n].col, r.vars[n].col
        on = on & (a == b if n in l.bound else a.eqNullSafe(b))
    return Rel(l.df.join(r.df, on, "left_anti"), l.vars, l.bound)


def left_join(l: Rel, r: Rel, condition=None) -> Rel:
    """OPTIONAL: the condition sees the joined row and is part of the match."""
    shared, parts = _pairs(l, r)
    if len(parts) == 1:
        a, b = parts[0]
        on = compatible(a, b, shared) if shared else F.lit(True)
        if condition is not None:
            on = on & condition(merged(a, b))
        return build(a.df.join(b.df, on, "left"), merged(a, b), l.bound)
    rest = without(l, r, condition)
    return union([join(l, r, condition), build(rest.df, rest.vars, rest.bound)])


def minus(l: Rel, r: Rel, aside: str) -> Rel:
    """MINUS: a row goes if a row of `r` agrees with it and shares at least one bound variable, other than those that begin with `aside`."""
    shared = [n for n in l.vars if n in r.vars and l.vars[n].type != "null" and r.vars[n].type != "null" and not n.startswith(aside)]
    if not shared:
        return l
    if any(n in l.bound and n in r.bound for n in shared):
        return without(l, r)

    # The values below are those of the parts that are being joined: a null column where a part has the variable unbound.
    def met(_) -> Column:
        out = F.lit(False)
        for n in shared:
            out = out | (l.vars[n].col.isNotNull() & r.vars[n].col.isNotNull())
        return out

    return without(l, r, met)


def distinct(rel: Rel) -> Rel:
    return Rel(rel.df.distinct(), rel.vars, rel.bound)
