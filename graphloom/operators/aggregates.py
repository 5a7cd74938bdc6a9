"""SPARQL aggregates as Spark aggregates, all with partial sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import values as V
from graphloom.functions.values import Val
from graphloom.plans import algebra as A
from graphloom.terms import RDF_LANG, XSD_STRING, term_column


def compile(a: A.Aggregate, arg: Val | None, row: Val | None) -> tuple[Val, bool]:
    """The aggregate over rows whose argument is `arg`, and whether it is certainly bound. `row`: the whole solution."""
    match a.name:
        case "COUNT":
            if arg is None:
                return Val("integer", F.count_distinct(row.col) if a.distinct else F.count(F.lit(1))), True
            return Val("integer", F.count_distinct(arg.col) if a.distinct else F.count(arg.col)), True
        case "SUM":
            return _sum(a, arg), False
        case "AVG":
            return _avg(a, arg), False
        case "MIN" | "MAX":
            best = F.min if a.name == "MIN" else F.max
            if arg.type == "term":
                by = F.min_by if a.name == "MIN" else F.max_by
                return Val("term", by(arg.col, F.when(arg.col.isNotNull(), V.sort_key(arg)))), False
            if arg.type == "iri":
                return Val("iri", best(V.lexical(arg))), False
            return Val(arg.type, best(arg.col), arg.extra), False
        case "SAMPLE":
            return Val(arg.type, F.first(arg.col, ignorenulls=True), arg.extra), False
        case "GROUP_CONCAT":
            return _concat(a, arg), False
    raise NotImplementedError(a.name)




def _sum(a: A.Aggregate, arg: Val) -> Val:
    """Any value that is no number is an error; the sum of nothing is integer 0."""
    if arg.type in V.NUMERIC:
        kind = "integer" if arg.type in ("int", "integer") else arg.type
        c = arg.col.cast("decimal(28,16)") if kind == "decimal" else arg.col.cast(V.NATIVE[kind])
        total = F.sum_distinct(c) if a.distinct else F.try_sum(c)
        if kind == "float":
            total = total.cast("float")
        return Val(kind, F.coalesce(total.try_cast(V.NATIVE[kind]), F.when(F.count(arg.col) == 0, F.lit(0).cast(V.NATIVE[kind]))))
    if arg.type != "term":
        return Val("integer", F.when(F.count(arg.col) == 0, F.lit(0).cast("bigint")))
    return _dynamic(a, arg, average=False)


def _avg(a: A.Aggregate, arg: Val) -> Val:
    if arg.type in V.NUMERIC:
        c = arg.col.cast("double") if arg.type in ("float", "double") else arg.col.cast("decimal(31,12)")
        if a.distinct:
            mean = F.try_divide(F.sum_distinct(c), F.count_distinct(c))
        else:
            mean = F.avg(c)
        kind = arg.type if arg.type in ("float", "double") else "decimal"
        return Val(kind, F.coalesce(mean.cast(V.NATIVE[kind]), F.when(F.count(arg.col) == 0, F.lit(0).cast(V.NATIVE[kind]))))
    if arg.type != "term":
        return Val("integer", F.when(F.count(arg.col) == 0, F.lit(0).cast("bigint")))
    return _dynamic(a, arg, average=True)


def _dynamic(a: A.Aggregate, arg: Val, average: bool) -> Val:
    n = V.number(arg)
    wrong = F.max(F.when(arg.col.isNotNull() & n.rank.isNull(), True))
    exact, real = n.dec.cast("decimal(28,16)"), F.when(n.rank >= 4, n.real)
    total = F.sum_distinct if a.distinct else F.try_sum
    dec, dbl, rank = F.coalesce(total(exact).try_cast(V.DECIMAL), F.lit(0).cast(V.DECIMAL)), F.coalesce(F.sum_distinct(real) if a.distinct else F.sum(real), F.lit(0.0)), F.coalesce(F.max(n.rank), F.lit(2))
    rank = F.when(rank == 1, 2).otherwise(rank)
    dbl = dbl + dec.cast("double")
    if average:
        count = F.count_distinct(arg.col) if a.distinct else F.count(n.rank)
        dec, dbl = F.coalesce(F.try_divide(dec, count).try_cast(V.DECIMAL), F.lit(0).cast(V.DECIMAL)), F.try_divide(dbl, count)
        rank = F.when((rank == 2) & (count > 0), 3).otherwise(rank)
    return V.number_term(F.when(wrong.isNull(), rank), dec.try_cast("bigint"), dec, dbl)


def _concat(a: A.Aggregate, arg: Val) -> Val:
    """In the order of the values, so that it is the same in every run; anything but strings is an error."""
    s = V.text(arg)
    if s is None:
        return Val("string", F.when(F.count(arg.col) == 0, ""))
    if s.lang is None:
        held = F.collect_list(s.lex)
        return Val("string", F.array_join(F.array_sort(F.array_distinct(held) if a.distinct else held), a.separator))
    held = F.collect_list(F.when(s.lex.isNotNull(), F.struct(s.lex.alias("l"), F.coalesce(s.lang, F.lit("")).alias("t"))))
    lex = F.array_join(F.transform(F.array_sort(F.array_distinct(held) if a.distinct else held), lambda x: x["l"]), a.separator)
    wrong = F.max(F.when(arg.col.isNotNull() & s.lex.isNull(), True))
    tags = F.collect_set(F.coalesce(s.lang, F.when(s.lex.isNotNull(), F.lit(""))))
    tag = F.when((F.size(tags) == 1) & (F.get(tags, F.lit(0)) != ""), F.get(tags, F.lit(0)))
    return Val("term", term_column(2, F.when(wrong.isNull(), lex), F.when(tag.isNotNull(), RDF_LANG).otherwise(XSD_STRING), tag))
