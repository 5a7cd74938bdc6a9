"""Values during compilation: a static type and a Spark column.

A variable whose type is known has a native column, so Catalyst sees plain expressions. Others are `term` structs. An error
is null, like an unbound variable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.terms import INTEGERS, RDF_LANG, TERM_DDL, XSD, XSD_STRING, BNode, IRI, Literal, Term, constant, term_column

NUMERIC = ("int", "integer", "decimal", "float", "double")
DECIMAL = "decimal(38,16)"
NATIVE = {"iri": "string", "bnode": "string", "string": "string", "boolean": "boolean", "int": "int", "integer": "bigint", "decimal": DECIMAL, "float": "float", "double": "double", "dateTime": "timestamp_ntz", "date": "date", "term": TERM_DDL}
DATE_TIME = r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"
DATE = r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$"
_NUMBER = {"decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "integer": r"^[+-]?\d+$", "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$"}


@dataclass(frozen=True)
class Val:
    """type: a key of NATIVE, or null. extra: for iri the prefix before a native key (None: `col` is the whole IRI).

    made: a term that is computed, not stored. Its expression is long, and the optimiser may put it wherever `col` is named.
    num: the term as a number, where that has been computed already.
    """

    type: str
    col: Column
    extra: str | None = None
    const: Term | None = None
    made: bool = False
    num: Num | None = None

    @property
    def kind(self) -> tuple[str, str | None]:
        return (self.type, self.extra)


class _Null:
    """The value of an unbound variable."""

    type, extra, const, made, num, kind = "null", None, None, False, None, ("null", None)

    @property
    def col(self) -> Column:
        return F.lit(None)


NULL = _Null()


def boolean(c: Column) -> Val:
    return Val("boolean", c)


def literal_type(dt: str) -> str | None:
    if dt == XSD_STRING:
        return "string"
    if not dt.startswith(XSD):
        return None
    name = dt[len(XSD) :]
    if name in INTEGERS:
        return "integer"
    return name if name in ("int", "decimal", "float", "double", "boolean", "dateTime", "date") else None


def of_term(term: Term | None) -> Val:
    """A constant. Literals that aren't canonical, and zoned times, stay terms, so that they print as written."""
    if term is None:
        return NULL
    if isinstance(term, IRI):
        return Val("iri", F.lit(term.value), const=term)
    if isinstance(term, BNode):
        return Val("bnode", F.lit(term.label), const=term)
    if term.lang is None:
        kind = literal_type(term.dt)
        if kind == "string":
            return Val("string", F.lit(term.lex), const=term)
        if kind == "boolean" and term.lex in ("true", "false"):
            return Val("boolean", F.lit(term.lex == "true"), const=term)
        if kind == "integer" and term.dt == XSD + "integer" and term.lex.lstrip("-").isdigit() and str(int(term.lex)) == term.lex and abs(int(term.lex)) < 1 << 63:
            return Val("integer", F.lit(int(term.lex)).cast("bigint"), const=term)
        if kind in ("decimal", "double", "float"):
            try:
                v = float(term.lex.replace("INF", "inf"))
            except ValueError:
                return Val("term", constant(term), const=term)
            digits = term.lex.lower().lstrip("+-").partition("e")[0].replace(".", "")
            if len(digits) <= 18 and v == v and abs(v) != float("inf"):
                return Val(kind, F.lit(term.lex).cast(NATIVE[kind]) if kind == "decimal" else F.lit(v).cast(kind), const=term)
        if kind in ("dateTime", "date") and term.lex[-1:] != "Z" and "+" not in term.lex and term.lex.count("-") == 2:
            return Val(kind, F.try_to_timestamp(F.lit(term.lex)).cast(NATIVE[kind]) if kind == "dateTime" else F.lit(term.lex).try_cast("date"), const=term)
    return Val("term", constant(term), const=term)


# Text forms
def double_text(c: Column) -> Column:
    """Shortest digits without an exponent: 10, 0.5, 12345678.9; INF, -INF, NaN."""
    s = c.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    wide = F.regexp_replace(F.regexp_replace(F.coalesce(s.try_cast("decimal(38,9)").cast("string"), s.try_cast("decimal(38,0)").cast("string"), s), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = F.regexp_replace(s.try_cast("decimal(38,30)").cast("string"), r"0+$", "")
    text = F.when(~s.contains("E"), plain).when(F.abs(c) >= 1, wide).otherwise(F.coalesce(small, s))
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(text)


def decimal_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast(DECIMAL).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def date_time_text(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), " ", "T")
    return s


def lexical(v: Val) -> Column:
    match v.type:
        case "iri" if v.extra is not None:
            return F.concat(F.lit(v.extra), v.col.cast("string"))
        case "iri" | "bnode" | "string":
            return v.col
        case "float" | "double":
            return double_text(v.col)
        case "decimal":
            return decimal_text(v.col)
        case "dateTime":
            return date_time_text(v.col)
        case "term":
            return v.col["lex"]
        case "null":
            return F.lit(None).cast("string")
    return v.col.cast("string")


def to_term(v: Val) -> Column:
    if v.type == "term":
        return v.col
    if v.type == "null":
        return F.lit(None).cast(TERM_DDL)
    if v.const is not None:
        return constant(v.const)
    kind = {"iri": 0, "bnode": 1}.get(v.type, 2)
    return term_column(kind, lexical(v), XSD + v.type if kind == 2 else None)


def as_iri(v: Val) -> Val:
    return Val("iri", lexical(v)) if v.type == "iri" else v


def common(vals: list[Val]) -> list[Val]:
    """The values in one representation: their own where they agree, else IRIs as strings, else terms."""
    kinds = {v.kind for v in vals if v.type != "null"}
    if len(kinds) == 1:
        (kind,) = kinds
        made = any(v.made for v in vals)
        return [Val(kind[0], v.col if v.type != "null" else F.lit(None), kind[1], made=made) for v in vals]
    if not kinds:
        return [Val("null", F.lit(None)) for _ in vals]
    if {k for k, _ in kinds} == {"iri"}:
        return [as_iri(v) if v.type == "iri" else Val("iri", F.lit(None).cast("string")) for v in vals]
    made = any(v.made or v.type in (*NUMERIC, "dateTime") and v.const is None for v in vals)
    return [Val("term", to_term(v), made=made) for v in vals]


def same(a: Val, b: Val) -> Column:
    """Term identity; null only where a side is."""
    if a.kind == b.kind:
        return a.col == b.col
    if "null" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if a.type == b.type == "iri":
        for x, y in ((a, b), (b, a)):
            if x.extra is not None and y.extra is None:
                if y.const is not None:  # a constant key: pushed into the scan
                    key = y.const.value[len(x.extra) :] if y.const.value.startswith(x.extra) else None
                    return F.lit(False) if key is None else x.col == F.lit(key).try_cast("bigint") if key.isdigit() else x.col.cast("string") == key
                return F.when(y.col.startswith(x.extra), x.col.cast("string") == F.substring(y.col, len(x.extra) + 1, 1 << 30)).otherwise(F.when(y.col.isNotNull(), False))
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if "term" in (a.type, b.type):
        return to_term(a) == to_term(b)
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def meets(a: Val, b: Val) -> Column:
    """same() for joins, where null will do for false: an equation of one side's expression with the other's wherever there can be one."""
    for x, y in ((a, b), (b, a)):
        if x.type == y.type == "iri" and x.extra is not None and y.extra is None and y.const is None:
            return x.col.cast("string") == F.when(y.col.startswith(x.extra), F.substring(y.col, len(x.extra) + 1, 1 << 30))
    return same(a, b)


# Dynamic numbers
@dataclass(frozen=True)
class Num:
    """rank: 1 int, 2 integer, 3 decimal, 4 float, 5 double; null if not a number."""

    rank: Column
    whole: Column
    dec: Column
    real: Column


def real_of(lex: Column) -> Column:
    return F.when(lex == "INF", float("inf")).when(lex == "+INF", float("inf")).when(lex == "-INF", float("-inf")).otherwise(lex.try_cast("double"))


def number(v: Val) -> Num | None:
    if v.type in NUMERIC:
        rank = F.when(v.col.isNotNull(), NUMERIC.index(v.type) + 1)
        if v.type in ("float", "double"):
            return Num(rank, F.lit(None).cast("bigint"), F.lit(None).cast(DECIMAL), v.col.cast("double"))
        return Num(rank, v.col.try_cast("bigint"), v.col.cast(DECIMAL), v.col.cast("double"))
    if v.type != "term":
        return None
    return v.num or number_of_rank(v.col, rank_of(v.col))


def rank_of(term: Column) -> Column:
    dt, lex = term["dt"], F.trim(term["lex"])
    ints = [XSD + x for x in INTEGERS]
    return (
        F.when(term["kind"] != 2, None)
        .when((dt == XSD + "int") & lex.rlike(_NUMBER["integer"]) & lex.try_cast("int").isNotNull(), 1)
        .when(dt.isin(ints) & lex.rlike(_NUMBER["integer"]) & lex.try_cast("bigint").isNotNull(), 2)
        .when((dt == XSD + "decimal") & lex.rlike(_NUMBER["decimal"]) & lex.try_cast(DECIMAL).isNotNull(), 3)
        .when((dt == XSD + "float") & lex.rlike(_NUMBER["double"]), 4)
        .when((dt == XSD + "double") & lex.rlike(_NUMBER["double"]), 5)
    )


def number_of_rank(term: Column, rank: Column) -> Num:
    lex = F.trim(term["lex"])
    return Num(rank, F.when(rank <= 2, lex.try_cast("bigint")), F.when(rank <= 3, lex.try_cast(DECIMAL)), F.when(rank == 4, real_of(lex).cast("float").cast("double")).when(rank.isNotNull(), real_of(lex)))


def number_term(rank: Column, whole: Column, dec: Column, real: Column) -> Val:
    """A number of dynamic type as a term. Its parts are computed once, though the text names them many times."""

    def term(n: Column) -> Column:
        r = n["r"]
        lex = F.when(r <= 2, n["w"].cast("string")).when(r == 3, decimal_text(n["d"])).when(r == 4, double_text(n["f"].cast("float"))).otherwise(double_text(n["f"]))
        dt = F.when(r == 1, XSD + "int").when(r == 2, XSD + "integer").when(r == 3, XSD + "decimal").when(r == 4, XSD + "float").otherwise(XSD + "double")
        return term_column(2, F.when(r.isNotNull(), lex), dt)

    parts = F.struct(rank.alias("r"), whole.alias("w"), dec.alias("d"), real.alias("f"))
    return Val("term", F.get(F.transform(F.array(parts), term), F.lit(0)))


@dataclass(frozen=True)
class Text:
    lex: Column
    lang: Column | None  # None: certainly a simple literal


def text(v: Val) -> Text | None:
    """A simple or tagged literal as an argument of a string function."""
    if v.type == "string":
        return Text(v.col, None)
    if v.type == "term":
        fits = (v.col["kind"] == 2) & v.col["dt"].isin(XSD_STRING, RDF_LANG)
        return Text(F.when(fits, v.col["lex"]), F.when(fits, v.col["lang"]))
    return None


def text_val(lex: Column, lang: Column | None) -> Val:
    if lang is None:
        return Val("string", lex)
    return Val("term", term_column(2, lex, F.when(lang.isNull(), XSD_STRING).otherwise(RDF_LANG), lang))


def moment(v: Val) -> tuple[Column, Column] | None:
    """A dateTime as (timestamp with zoneless ones taken as UTC, whether it has a zone)."""
    if v.type == "dateTime":
        return v.col.cast("timestamp"), F.lit(False)
    if v.type == "term":
        ok = (v.col["kind"] == 2) & (v.col["dt"] == XSD + "dateTime") & v.col["lex"].rlike(DATE_TIME)
        lex = F.when(ok, v.col["lex"])
        return lex.try_cast("timestamp"), lex.rlike(r"(Z|[+-]\d\d:\d\d)$")
    return None


def day(v: Val) -> Column | None:
    if v.type == "date":
        return v.col
    if v.type == "term":
        ok = (v.col["kind"] == 2) & (v.col["dt"] == XSD + "date") & v.col["lex"].rlike(DATE)
        return F.when(ok, F.substring(v.col["lex"], 1, 10).try_cast("date"))
    return None


def truth(v: Val) -> Column | None:
    """An xsd:boolean's value."""
    if v.type == "boolean":
        return v.col
    if v.type == "term":
        return F.when((v.col["kind"] == 2) & (v.col["dt"] == XSD + "boolean"), F.when(v.col["lex"].isin("true", "1"), True).when(v.col["lex"].isin("false", "0"), False))
    return None


def ebv(v: Val) -> Column:
    """Effective boolean value; null is an error."""
    match v.type:
        case "boolean":
            return v.col
        case "string":
            return F.length(v.col) > 0
        case "float" | "double":
            return (v.col != 0) & ~F.isnan(v.col)
        case "int" | "integer" | "decimal":
            return v.col != 0
        case "term":
            n, s = number(v), text(v)
            return F.coalesce(truth(v), F.when(n.rank.isNotNull(), (n.real != 0) & ~F.isnan(n.real)), F.length(s.lex) > 0)
    return F.lit(None).cast("boolean")


#: Days from which months are counted to compare durations: those of the XML Schema recommendation.
_FROM = ("1696-09-01", "1697-02-01", "1903-03-01", "1903-07-01")
_DURATION = r"^-?P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d*)?)S)?)?$"


def duration(v: Val) -> tuple[Column, Column] | None:
    """A duration as (months, seconds)."""
    if v.type != "term":
        return None
    ok = (v.col["kind"] == 2) & v.col["dt"].isin(*(XSD + x for x in ("duration", "yearMonthDuration", "dayTimeDuration"))) & v.col["lex"].rlike(_DURATION)
    lex = F.when(ok, v.col["lex"])
    sign = F.when(lex.startswith("-"), -1).otherwise(1)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(lex, _DURATION, k), F.lit("")).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    months = F.when(ok, sign * (part(1) * 12 + part(2))).try_cast("int")
    return months, F.when(ok, sign * (part(3) * 86400 + part(4) * 3600 + part(5) * 60 + part(6))).try_cast("decimal(24,6)")


def _durations(m: tuple[Column, Column], n: tuple[Column, Column], op: str) -> Column:
    """A partial order: months have no fixed length, so both are added to several days, and `<` is null where these disagree."""
    known = m[0].isNotNull() & m[1].isNotNull() & n[0].isNotNull() & n[1].isNotNull()
    if op == "=":
        return F.when(known, (m[0] == n[0]) & (m[1] == n[1]))
    at = lambda x, d: F.datediff(F.add_months(F.lit(d).cast("date"), x[0]), F.lit(d).cast("date")).cast("decimal(24,6)") * 86400 + x[1]
    less = [at(m, d) < at(n, d) for d in _FROM]
    return F.when(known, F.when(less[0] & less[1] & less[2] & less[3], True).when(~(less[0] | less[1] | less[2] | less[3]), False))


def compare(a: Val, b: Val, op: str) -> Column:
    """`=` or `<` by value; null where the values can't be compared."""
    hit = (lambda x, y: x == y) if op == "=" else (lambda x, y: x < y)
    none = F.lit(None).cast("boolean")
    if "null" in (a.type, b.type):
        return none
    if a.type in NUMERIC and b.type in NUMERIC:
        if "float" in (a.type, b.type) or "double" in (a.type, b.type):
            x, y = a.col.cast("double"), b.col.cast("double")
            safe = [~F.isnan(v.col) for v in (a, b) if v.type in ("float", "double") and v.const is None]
            if a.type == b.type:
                x, y = a.col, b.col
            out = hit(x, y)
            for s in safe:
                out = out & s
            return out
        return hit(a.col, b.col)
    if a.type == b.type and a.type not in ("term", "iri", "bnode"):
        return hit(a.col, b.col)
    if op == "=" and a.type in ("iri", "bnode") and b.type != "term":
        return same(a, b) if a.type == b.type else F.when(a.col.isNotNull() & b.col.isNotNull(), False)
    if op == "=" and b.type in ("iri", "bnode") and a.type != "term":
        return F.when(a.col.isNotNull() & b.col.isNotNull(), False)
    if "term" not in (a.type, b.type):
        return none
    out: list[Column] = []
    m, n = number(a), number(b)
    if m and n:
        exact = F.greatest(m.rank, n.rank) <= 3
        real = F.when(F.isnan(m.real) | F.isnan(n.real), False).otherwise(hit(m.real, n.real))
        out.append(F.when(m.rank.isNotNull() & n.rank.isNotNull(), F.when(exact, hit(m.dec, n.dec)).otherwise(real)))
    s, t = text(a), text(b)
    if s and t:
        tags = (s.lang if s.lang is not None else F.lit(None).cast("string")).eqNullSafe(t.lang if t.lang is not None else F.lit(None).cast("string"))
        out.append(F.when(tags & s.lex.isNotNull() & t.lex.isNotNull(), hit(s.lex, t.lex)))
    p, q = truth(a), truth(b)
    if p is not None and q is not None:
        out.append(hit(p, q))
    d, e = moment(a), moment(b)
    if d and e:
        apart = F.abs(F.unix_micros(d[0]) - F.unix_micros(e[0])) > 14 * 3600 * 1_000_000
        out.append(F.when((d[1] == e[1]) | apart, hit(d[0], e[0])))
    f, g = day(a), day(b)
    if f is not None and g is not None:
        out.append(hit(f, g))
    u, v = duration(a), duration(b)
    if u and v:
        out.append(_durations(u, v, op))
    if op == "=":
        x, y = to_term(a), to_term(b)
        out.append(F.when(x == y, True).when((x["kind"] != 2) | (y["kind"] != 2), False))
    return F.coalesce(*out) if out else none


def sort_key(v: Val) -> Column:
    """A column that orders like SPARQL terms; unbound first."""
    if v.type == "iri":
        return lexical(v)
    if v.type != "term":
        return v.col
    n, s, d = number(v), text(v), moment(v)
    c = v.col
    other = F.when(c["dt"] == XSD + "time", 7).when(c["dt"] == XSD + "duration", 9).when(c["dt"] == XSD + "yearMonthDuration", 10).when(c["dt"] == XSD + "dayTimeDuration", 11).otherwise(12)
    rank = (
        F.when(c.isNull(), 0).when(c["kind"] == 1, 1).when(c["kind"] == 0, 2).when(truth(v).isNotNull(), 3).when(n.rank.isNotNull(), 4)
        .when(s.lex.isNotNull(), 5).when(d[0].isNotNull(), 6).when(day(v).isNotNull(), 8).when(c["dt"].isin(*[XSD + x for x in (*NUMERIC, *INTEGERS, "boolean", "dateTime", "date")]), 0).otherwise(other)
    )
    span = duration(v)
    value = F.coalesce(n.real, truth(v).cast("int").cast("double"), F.unix_micros(d[0]).cast("double"), F.unix_date(day(v)).cast("double"), span[0] * 2_629_746.0 + span[1].cast("double"))
    return F.struct(rank.alias("rank"), value.alias("num"), c["lex"].alias("text"))
