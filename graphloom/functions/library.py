"""SPARQL's operators and functions as Column expressions."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import replace
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import values as V
from graphloom.functions.values import NULL, Val, boolean
from graphloom.terms import RDF_LANG, XSD, XSD_STRING, IRI, term_column

TABLE: dict[str, Callable] = {}


class Context:
    """What functions need besides their arguments: the base IRI and the time of the query."""

    def __init__(self, base: str | None = None, custom: dict[str, Callable] | None = None):
        self.base, self.custom = base, custom or {}
        self.now = datetime.datetime.now(datetime.timezone.utc)


def function(*names: str):
    def keep(f: Callable) -> Callable:
        for n in names:
            TABLE[n] = f
        return f

    return keep


def call(ctx: Context, name: str, args: list[Val]) -> Val:
    if name in ctx.custom:
        return ctx.custom[name](*args)
    if name not in TABLE:
        return NULL  # an unknown function is an error in every row
    once = name not in ("REGEX", "REPLACE") and any(a.made for a in args) or name in ARITHMETIC and any(a.type == "term" and a.const is None for a in args)
    out = _named_once(name, ctx, args) if once else TABLE[name](ctx, *args)
    return replace(out, made=True) if out.type == "term" else out


#: Functions that take terms as numbers: these are parsed once, however often the function names them. Comparisons of stored terms
#: stay plain, so that they are compiled and reach scans.
ARITHMETIC = {"+", "-", "*", "/", "u+", "u-", "ABS", "CEIL", "FLOOR", "ROUND"}
NUMBERS = ARITHMETIC | {"=", "!=", "<", ">", "<=", ">="}


def _named_once(name: str, ctx: Context, args: list[Val]) -> Val:
    """The function of args with computed terms bound to a name once. Functions name their arguments dozens of times, so expressions
    of expressions would grow exponentially where they are put in place of their names."""
    numbers = name in NUMBERS
    at, told = [k for k, a in enumerate(args) if a.made or numbers and a.type == "term" and a.const is None], []

    def body(x: Column) -> Column:
        bound = [Val("term", x[f"a{k}"], num=V.Num(*(x[f"{c}{k}"] for c in "rwdf")) if numbers else None) if k in at else a for k, a in enumerate(args)]
        told.append(TABLE[name](ctx, *bound))
        return told[-1].col

    def ranked(x: Column) -> Column:
        return F.struct(*(x[f"a{k}"].alias(f"a{k}") for k in at), *(V.rank_of(x[f"a{k}"]).alias(f"r{k}") for k in at))

    def parsed(x: Column) -> Column:
        nums = {k: V.number_of_rank(x[f"a{k}"], x[f"r{k}"]) for k in at}
        return F.struct(*(x[f"a{k}"].alias(f"a{k}") for k in at), *(c.alias(f"{n}{k}") for k, m in nums.items() for n, c in zip("rwdf", (m.rank, m.whole, m.dec, m.real))))

    held = F.array(F.struct(*(args[k].col.alias(f"a{k}") for k in at)))
    if numbers:
        held = F.transform(F.transform(held, ranked), parsed)
    col = F.get(F.transform(held, body), F.lit(0))
    return told[-1] if told[-1].type == "null" else Val(told[-1].type, col, told[-1].extra)


# Logic and comparison
@function("&&")
def _and(_, a, b):
    return boolean(V.ebv(a) & V.ebv(b))


@function("||")
def _or(_, a, b):
    return boolean(V.ebv(a) | V.ebv(b))


@function("!")
def _not(_, a):
    return boolean(~V.ebv(a))


for _op, _f in {
    "=": lambda a, b: V.compare(a, b, "="), "!=": lambda a, b: ~V.compare(a, b, "="), "<": lambda a, b: V.compare(a, b, "<"), ">": lambda a, b: V.compare(b, a, "<"),
    "<=": lambda a, b: V.compare(a, b, "<") | V.compare(a, b, "="), ">=": lambda a, b: V.compare(b, a, "<") | V.compare(a, b, "="),
}.items():
    TABLE[_op] = lambda _, a, b, f=_f: boolean(f(a, b))


def _native_order(op: str, plain: Callable[[Column, Column], Column]) -> None:
    """<= and >= on native columns of one type as single comparisons, which scans can use."""
    slow = TABLE[op]

    def fast(ctx, a: Val, b: Val) -> Val:
        exact = ("int", "integer", "decimal", "string", "dateTime", "date", "boolean")
        if a.type in exact and (a.type == b.type or {a.type, b.type} <= {"int", "integer", "decimal"}):
            return boolean(plain(a.col, b.col))
        if a.type in V.NUMERIC and b.type in V.NUMERIC:
            out = plain(a.col if a.type == b.type else a.col.cast("double"), b.col if a.type == b.type else b.col.cast("double"))
            for v in (a, b):
                if v.type in ("float", "double") and v.const is None:
                    out = out & ~F.isnan(v.col)
            return boolean(out)
        return slow(ctx, a, b)

    TABLE[op] = fast


_native_order("<=", lambda x, y: x <= y)
_native_order(">=", lambda x, y: x >= y)


@function("IN")
def _in(_, a, *items):
    if not items:
        return boolean(F.lit(False))
    if all(i.const is not None and i.type == a.type and i.type in ("string", "integer", "int", "dateTime", "date") for i in items):
        return boolean(a.col.isin([i.col for i in items]))
    out = V.compare(a, items[0], "=")
    for i in items[1:]:
        out = out | V.compare(a, i, "=")
    return boolean(out)


@function("SAMETERM")
def _same_term(_, a, b):
    return boolean(V.same(a, b))


@function("IF")
def _if(_, c, a, b):
    x, y = V.common([a, b])
    cond = V.ebv(c)
    return Val(x.type, F.when(cond, x.col).when(~cond, y.col), x.extra)


@function("COALESCE")
def _coalesce(_, *args):
    vals = [v for v in V.common(list(args)) if v.type != "null"]
    return Val(vals[0].type, F.coalesce(*(v.col for v in vals)), vals[0].extra) if vals else NULL


# Arithmetic
def _arith(op: str):
    native = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}

    def on(kind: str, x: Column, y: Column) -> Column:
        if kind in ("float", "double"):
            if op == "/":
                x, y = x.cast("double"), y.cast("double")
                zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
                out = F.when(y == 0, zero).otherwise(F.try_divide(x, y))
            else:
                out = {"+": x + y, "-": x - y, "*": x * y}[op]
            return out.cast(kind)
        if kind == "decimal":
            if op == "/":
                return F.try_divide(x.cast("decimal(27,9)"), y.cast("decimal(27,9)")).try_cast(V.DECIMAL)
            if op == "*":
                return F.try_multiply(x.cast("decimal(29,8)"), y.cast("decimal(29,8)")).try_cast(V.DECIMAL)
            return native[op](x.cast("decimal(37,16)"), y.cast("decimal(37,16)")).try_cast(V.DECIMAL)
        return native[op](x, y)

    def run(_, a: Val, b: Val) -> Val:
        if a.type in V.NUMERIC and b.type in V.NUMERIC:
            if op == "/" and {a.type, b.type} <= {"int", "integer"}:  # enough digits for all of the quotient's scale
                return Val("decimal", F.try_divide(a.col.cast("decimal(19,0)"), b.col.cast("decimal(19,0)")).try_cast(V.DECIMAL))
            kind = V.NUMERIC[max(V.NUMERIC.index(a.type), V.NUMERIC.index(b.type))]
            return Val(kind, on(kind, a.col.cast(V.NATIVE[kind]), b.col.cast(V.NATIVE[kind])))
        m, n = V.number(a), V.number(b)
        if not m or not n:
            return NULL
        rank = F.when(m.rank.isNotNull() & n.rank.isNotNull(), F.greatest(m.rank, n.rank))
        if op == "/":
            rank = F.greatest(rank, F.when(rank.isNotNull(), 3))
        whole = on("integer", m.whole, n.whole) if op != "/" else F.lit(None).cast("bigint")
        dec, real = on("decimal", m.dec, n.dec), on("double", m.real, n.real)
        fits = F.when(rank <= 2, whole.isNotNull()).when(rank == 3, dec.isNotNull()).otherwise(real.isNotNull())
        return V.number_term(F.when(fits, rank), whole, dec, real)

    return run


for _op in "+-*/":
    TABLE[_op] = _arith(_op)


def _each_number(on: Callable[[str, Column], Column]):
    """A function of one number that keeps its type."""

    def run(_, a: Val) -> Val:
        if a.type in V.NUMERIC:
            return Val(a.type, on(a.type, a.col).try_cast(V.NATIVE[a.type]))
        n = V.number(a)
        if not n:
            return NULL
        whole, dec, real = on("integer", n.whole).try_cast("bigint"), on("decimal", n.dec).try_cast(V.DECIMAL), on("double", n.real)
        return V.number_term(F.when(F.when(n.rank <= 2, whole.isNotNull()).when(n.rank == 3, dec.isNotNull()).otherwise(n.rank.isNotNull()), n.rank), whole, dec, real)

    return run


def _real(k: str) -> bool:
    return k in ("float", "double")


TABLE["u+"] = _each_number(lambda k, c: c)
TABLE["u-"] = _each_number(lambda k, c: F.try_subtract(F.lit(0).cast(c_type(k)), c) if not _real(k) else -c)
TABLE["ABS"] = _each_number(lambda k, c: F.abs(c) if _real(k) else F.when(c >= 0, c).otherwise(F.try_subtract(F.lit(0).cast(c_type(k)), c)))
TABLE["CEIL"] = _each_number(lambda k, c: c if k in ("int", "integer") else F.ceil(c) if k == "decimal" else _whole(F.ceil, c))
TABLE["FLOOR"] = _each_number(lambda k, c: c if k in ("int", "integer") else F.floor(c) if k == "decimal" else _whole(F.floor, c))
TABLE["ROUND"] = _each_number(lambda k, c: c if k in ("int", "integer") else F.floor(c + F.lit("0.5").cast("decimal(2,1)")) if k == "decimal" else _whole(F.floor, c + F.lit(0.5)))


def c_type(k: str) -> str:
    return {"decimal": "decimal(37,16)"}.get(k, V.NATIVE[k])


def _whole(f: Callable, c: Column) -> Column:
    """Numbers beyond 2**53 are whole already."""
    return F.when(F.isnan(c) | (F.abs(c) >= float(1 << 53)), c.cast("double")).otherwise(f(c).cast("double"))


@function("RAND")
def _rand(_):
    return Val("double", F.rand())


# Terms
def _kind(n: int, *types: str):
    def run(_, a: Val) -> Val:
        if a.type == "term":
            return boolean(a.col["kind"] == n)
        return boolean(F.when(a.col.isNotNull(), F.lit(a.type in types or (n == 2 and a.type not in ("iri", "bnode", "null")))))

    return run


TABLE["ISIRI"], TABLE["ISBLANK"], TABLE["ISLITERAL"] = _kind(0, "iri"), _kind(1, "bnode"), _kind(2)


@function("ISNUMERIC")
def _is_numeric(_, a):
    n = V.number(a)
    present = V.to_term(a).isNotNull()
    return boolean(F.when(present, n.rank.isNotNull() if n else F.lit(False)))


@function("BOUND")
def _bound(_, a):
    return boolean(F.lit(False) if a.type == "null" else a.col.isNotNull())


@function("STR")
def _str(_, a):
    return Val("string", V.lexical(a) if a.const is None else F.lit(a.const.row()[1]))


@function("LANG")
def _lang(_, a):
    if a.type == "term":
        return Val("string", F.when(a.col["kind"] == 2, F.coalesce(a.col["lang"], F.lit(""))))
    return NULL if a.type in ("iri", "bnode", "null") else Val("string", F.when(a.col.isNotNull(), ""))


@function("DATATYPE")
def _datatype(_, a):
    if a.type == "term":
        return Val("iri", F.when(a.col["kind"] == 2, a.col["dt"]))
    return NULL if a.type in ("iri", "bnode", "null") else Val("iri", F.when(a.col.isNotNull(), XSD + a.type))


@function("IRI")
def _iri(ctx, a):
    if a.type == "iri":
        return a
    if a.type == "term":
        s = F.when(a.col["kind"] == 0, a.col["lex"]).when(a.col["dt"] == XSD_STRING, a.col["lex"])
    elif a.type == "string":
        s = a.col
    else:
        return NULL
    if a.const is not None:
        return V.of_term(IRI(urljoin(ctx.base, a.const.lex) if ctx.base else a.const.lex))
    if not ctx.base:
        return Val("iri", s)
    root = re.match(r"^([a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/?#]*)?)", ctx.base)
    folder = re.sub(r"[^/]*([?#].*)?$", "", ctx.base)
    relative = F.when(s == "", F.lit(ctx.base)).when(s.startswith("/"), F.concat(F.lit(root[1] if root else ""), s)).when(s.startswith("#"), F.concat(F.lit(ctx.base.split("#")[0]), s)).otherwise(F.concat(F.lit(folder), s))
    return Val("iri", F.when(s.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), s).otherwise(relative))


@function("BNODE")
def _bnode(_, a=None):
    if a is None:
        return Val("bnode", F.regexp_replace(F.expr("uuid()"), "-", ""))
    s = V.text(a)
    return Val("bnode", s.lex) if s else NULL


@function("STRDT")
def _strdt(ctx, a, dt):
    s = V.text(a)
    if not s or dt.type not in ("iri", "term"):
        return NULL
    simple = s.lex if s.lang is None else F.when(s.lang.isNull(), s.lex)
    if dt.const is not None:
        if dt.const.value == XSD_STRING:
            return Val("string", simple)
        made = Val("term", term_column(2, simple, dt.const.value))
        kind = V.literal_type(dt.const.value)
        if kind in V.NUMERIC:
            return Val("term", F.when(V.number(made).rank.isNotNull(), made.col))
        check = {"boolean": V.truth, "dateTime": lambda v: V.moment(v)[0], "date": V.day}.get(kind or "")
        return Val("term", F.when(check(made).isNotNull(), made.col)) if check else made
    return Val("term", term_column(2, simple, V.lexical(dt)))


@function("STRLANG")
def _strlang(_, a, tag):
    s, t = V.text(a), V.text(tag)
    if not s or not t:
        return NULL
    simple = s.lex if s.lang is None else F.when(s.lang.isNull(), s.lex)
    return Val("term", term_column(2, F.when(t.lex.isNotNull(), simple), RDF_LANG, F.lower(t.lex)))


@function("UUID")
def _uuid(_):
    return Val("iri", F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))


@function("STRUUID")
def _struuid(_):
    return Val("string", F.expr("uuid()"))


# Strings
def _fits(s: V.Text, t: V.Text) -> Column | None:
    """SPARQL's argument compatibility; None: always."""
    if t.lang is None:
        return None
    own = s.lang if s.lang is not None else F.lit(None).cast("string")
    return t.lang.isNull() | t.lang.eqNullSafe(own)


def _of_text(f: Callable[[Column], Column], keep_lang: bool):
    def run(_, a: Val) -> Val:
        s = V.text(a)
        if not s:
            return NULL
        return V.text_val(f(s.lex), s.lang if keep_lang else None)

    return run


TABLE["UCASE"], TABLE["LCASE"] = _of_text(F.upper, True), _of_text(F.lower, True)
_uri = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
TABLE["ENCODE_FOR_URI"] = _of_text(_uri, False)
for _name, _f in {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}.items():
    TABLE[_name] = _of_text(_f, False)


@function("STRLEN")
def _strlen(_, a):
    s = V.text(a)
    return Val("integer", F.char_length(s.lex).cast("bigint")) if s else NULL


def _two_texts(f: Callable[[Column, Column], Column]):
    def run(_, a: Val, b: Val) -> Val:
        s, t = V.text(a), V.text(b)
        if not s or not t:
            return NULL
        ok = _fits(s, t)
        hit = f(s.lex, t.lex)
        return boolean(hit if ok is None else F.when(ok, hit))

    return run


TABLE["CONTAINS"], TABLE["STRSTARTS"], TABLE["STRENDS"] = _two_texts(F.contains), _two_texts(F.startswith), _two_texts(F.endswith)


def _cut(before: bool):
    def run(_, a: Val, b: Val) -> Val:
        s, t = V.text(a), V.text(b)
        if not s or not t:
            return NULL
        at = F.instr(s.lex, t.lex)
        part = F.substring(s.lex, F.lit(1), at - 1) if before else F.substring(s.lex, at + F.char_length(t.lex), F.char_length(s.lex))
        lex = F.when(t.lex == "", F.lit("") if before else s.lex).when(at > 0, part).when(at == 0, "")
        ok = _fits(s, t)
        lex = lex if ok is None else F.when(ok, lex)
        return V.text_val(lex, None if s.lang is None else F.when((at > 0) | (t.lex == ""), s.lang))

    return run


TABLE["STRBEFORE"], TABLE["STRAFTER"] = _cut(True), _cut(False)


def _long(v: Val) -> Column | None:
    """A number argument as a whole number."""
    if v.type in ("int", "integer"):
        return v.col
    n = V.number(v)
    return n.real.try_cast("bigint") if n else None


@function("SUBSTR")
def _substr(_, a, start, length=None):
    s, i = V.text(a), _long(start)
    n = _long(length) if length is not None else F.lit((1 << 31) - 1)
    if not s or i is None or n is None:
        return NULL
    ok = (i >= 1) & (n >= 0)
    part = F.substring(s.lex, F.least(i, F.lit((1 << 31) - 1)).cast("int"), F.least(n, F.lit((1 << 31) - 1)).cast("int"))
    return V.text_val(F.when(ok, part), s.lang)


@function("CONCAT")
def _concat(_, *args):
    parts = [V.text(a) for a in args]
    if any(p is None for p in parts):
        return NULL
    lex = F.concat(*(p.lex for p in parts)) if parts else F.lit("")
    if not parts or any(p.lang is None for p in parts):
        return Val("string", lex)
    agree = F.lit(True)
    for p in parts[1:]:
        agree = agree & p.lang.eqNullSafe(parts[0].lang)
    return V.text_val(lex, F.when(agree, parts[0].lang))


@function("LANGMATCHES")
def _lang_matches(_, tag, wanted):
    s, t = V.text(tag), V.text(wanted)
    if not s or not t:
        return NULL
    a, b = F.lower(s.lex), F.lower(t.lex)
    return boolean(F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))


def _java_flags(flags: str) -> str | None:
    return None if set(flags) - set("smixq") else flags


def _valid(pattern: str) -> bool:
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}", "a", pattern))
        return True
    except re.error:
        return False


def _constant_pattern(pattern: Val, flags: Val | None) -> str | None:
    """The Java pattern for a constant pattern and constant flags; None if they are an error."""
    given = "" if flags is None else flags.const.lex
    if _java_flags(given) is None:
        return None
    p = pattern.const.lex
    if "q" in given:
        p = re.escape(p)
    elif not _valid(p):
        return None
    mode = "".join(f for f in given if f in "smix") + ("u" if "i" in given else "")
    return f"(?{mode}){p}" if mode else p


def _row_regex(lex: Column, pattern: Column, flags: Column, replacement: Column | None = None) -> Column:
    """Patterns from data: Spark fails on a bad one, so they are matched in batches where a bad one gives null."""
    kind = "string" if replacement is not None else "boolean"

    @F.pandas_udf(kind)
    def run(s: pd.Series, p: pd.Series, f: pd.Series, r: pd.Series) -> pd.Series:
        made: dict = {}

        def one(x, pat, fl, rep):
            if x is None or pat is None or fl is None or rep is None or set(fl) - set("smixq"):
                return None
            if (pat, fl) not in made:
                try:
                    bits = sum({"s": re.S, "m": re.M, "i": re.I, "x": re.X}[c] for c in set(fl) if c != "q")
                    made[pat, fl] = re.compile(re.escape(pat) if "q" in fl else pat, bits)
                except re.error:
                    made[pat, fl] = None
            c = made[pat, fl]
            if c is None:
                return None
            return bool(c.search(x)) if kind == "boolean" else c.sub(re.sub(r"\$(\d+)", r"\\g<\1>", rep), x)

        return pd.Series([one(*x) for x in zip(s, p, f, r)], dtype=object)

    return run(lex, pattern, flags, replacement if replacement is not None else F.lit(""))


@function("REGEX")
def _regex(_, a, pattern, flags=None):
    s, p = V.text(a), V.text(pattern)
    if not s or not p:
        return NULL
    if pattern.const is not None and (flags is None or flags.const is not None):
        made = _constant_pattern(pattern, flags)
        return NULL if made is None else boolean(F.rlike(s.lex, F.lit(made)))
    f = V.text(flags).lex if flags is not None else F.lit("")
    return boolean(_row_regex(s.lex, p.lex, f))


@function("REPLACE")
def _replace(_, a, pattern, replacement, flags=None):
    s, p, r = V.text(a), V.text(pattern), V.text(replacement)
    if not s or not p or not r:
        return NULL
    if pattern.const is not None and replacement.const is not None and (flags is None or flags.const is not None):
        made = _constant_pattern(pattern, flags)
        if made is None:
            return NULL
        to = re.sub(r"\$\{(\w+)\}", r"$\1", replacement.const.lex)
        if flags is not None and "q" in flags.const.lex:
            to = to.replace("\\", "\\\\").replace("$", "\\$")
        return V.text_val(F.regexp_replace(s.lex, made, to), s.lang)
    f = V.text(flags).lex if flags is not None else F.lit("")
    return V.text_val(_row_regex(s.lex, p.lex, f, r.lex), s.lang)


# Dates
@function("NOW")
def _now(ctx):
    lex = ctx.now.strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".") + "Z"
    return Val("term", term_column(2, F.lit(lex), XSD + "dateTime"))


def _field(native: Callable[[Column], Column], pattern: str):
    def run(_, a: Val) -> Val:
        if a.type == "dateTime":
            return Val("integer", native(a.col).cast("bigint"))
        if a.type == "term":
            ok = V.moment(a)[0].isNotNull()
            return Val("integer", F.when(ok, F.regexp_extract(a.col["lex"], pattern, 1).try_cast("bigint")))
        return NULL

    return run


TABLE["YEAR"] = _field(F.year, r"^(-?\d+)-")
TABLE["MONTH"] = _field(F.month, r"^-?\d+-(\d\d)-")
TABLE["DAY"] = _field(F.dayofmonth, r"^-?\d+-\d\d-(\d\d)")
TABLE["HOURS"] = _field(F.hour, r"T(\d\d):")
TABLE["MINUTES"] = _field(F.minute, r"T\d\d:(\d\d):")


@function("SECONDS")
def _seconds(_, a):
    if a.type == "dateTime":
        return Val("decimal", F.extract(F.lit("SECOND"), a.col).cast(V.DECIMAL))
    if a.type == "term":
        return Val("decimal", F.when(V.moment(a)[0].isNotNull(), F.regexp_extract(a.col["lex"], r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast(V.DECIMAL)))
    return NULL


def _zone(a: Val) -> Column | None:
    """Z, +hh:mm, -hh:mm or nothing; null for what isn't a dateTime."""
    if a.type == "dateTime":
        return F.when(a.col.isNotNull(), "")
    return F.when(V.moment(a)[0].isNotNull(), F.regexp_extract(a.col["lex"], r"(Z|[+-]\d\d:\d\d)$", 1)) if a.type == "term" else None


@function("TZ")
def _tz(_, a):
    z = _zone(a)
    return NULL if z is None else Val("string", z)


@function("TIMEZONE")
def _timezone(_, a):
    z = _zone(a)
    if z is None:
        return NULL
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    lex = F.when((z == "Z") | z.rlike("00:00$"), "PT0S").when(z != "", F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), parts))
    return Val("term", term_column(2, lex, XSD + "dayTimeDuration"))


# Casts
def _string_form(a: Val) -> Column | None:
    s = V.text(a)
    return None if s is None else F.trim(s.lex if s.lang is None else F.when(s.lang.isNull(), s.lex))


def _numeric_cast(kind: str):
    form = {"int": V._NUMBER["integer"], "integer": V._NUMBER["integer"], "decimal": V._NUMBER["decimal"]}.get(kind, V._NUMBER["double"])

    def run(_, a: Val) -> Val:
        to, out = V.NATIVE[kind], []
        t, n, s = V.truth(a), V.number(a), _string_form(a)
        if a.type in V.NUMERIC:
            c = a.col
            if a.type in ("float", "double") and kind not in ("float", "double"):
                c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)) if kind != "decimal" else c)
            elif a.type == "decimal" and kind in ("int", "integer"):
                c = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
            return Val(kind, c.try_cast(to))
        if t is not None:
            out.append(t.cast("int").cast(to))
        if n is not None:
            if kind in ("float", "double"):
                out.append(n.real.cast(to))
            else:
                cut = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)) if kind != "decimal" else c
                out += [cut(n.dec).try_cast(to), F.when(~F.isnan(n.real) & (F.abs(n.real) != float("inf")), cut(n.real)).try_cast(to)]
        if s is not None:
            out.append(F.when(s.rlike(form), V.real_of(s).cast(to) if kind in ("float", "double") else s.try_cast(to)))
        return Val(kind, F.coalesce(*out)) if out else NULL

    return run


for _kind_name in V.NUMERIC:
    TABLE[XSD + _kind_name] = _numeric_cast(_kind_name)


@function(XSD + "boolean")
def _to_boolean(_, a):
    t, n, s = V.truth(a), V.number(a), _string_form(a)
    out = [] if t is None else [t]
    if n is not None:
        out.append(F.when(n.rank.isNotNull(), (n.real != 0) & ~F.isnan(n.real)))
    if s is not None:
        out.append(F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False))
    return boolean(F.coalesce(*out)) if out else NULL


@function(XSD + "string")
def _to_string(_, a):
    if a.type == "term":
        n = V.number(a)
        canonical = V.number_term(n.rank, n.whole, n.dec, n.real).col["lex"]
        return Val("string", F.when(a.col["kind"] != 1, F.coalesce(F.when(n.rank.isNotNull(), canonical), F.when(V.truth(a).isNotNull(), V.truth(a).cast("string")), a.col["lex"])))
    return NULL if a.type in ("bnode", "null") else Val("string", V.lexical(a))


@function(XSD + "dateTime")
def _to_date_time(_, a):
    if a.type == "dateTime":
        return a
    if a.type not in ("string", "term"):
        return NULL
    lex = _string_form(a)
    if a.type == "term":
        lex = F.coalesce(lex, F.when(V.moment(a)[0].isNotNull(), a.col["lex"]))
    made = Val("term", term_column(2, lex, XSD + "dateTime"))
    return Val("term", F.when(V.moment(made)[0].isNotNull(), made.col))
