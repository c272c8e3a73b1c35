"""SPARQL's operators and functions over typed columns. An error is null; ANSI errors are avoided by try_ forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.terms import (
    BLANK, BOOL, DATE, DATETIME, DBL, DEC, INT, INTEGERS, IRI, IRI_T, LANG_STRING, LITERAL, NUMERIC, STR, STRING, TERM, TRIPLE, XSD, Term, Type, Value, as_term, constant, lexical, lit, parse_native, struct,
)

FLT = lit("float")
#: Decimals as they are compared and added, and as they are multiplied and divided (so that the result keeps its places).
WIDE, EXACT = "decimal(38,18)", "decimal(28,10)"
DTD = lit("dayTimeDuration")


def string(c: Column) -> Value:
    return Value(c, STR)


def boolean(c: Column) -> Value:
    return Value(c, BOOL)


def is_string(t: Type) -> bool:
    return t.kind == "lit" and t.dt in (STRING, LANG_STRING)


def naive(t: Type) -> bool:
    return t.kind == "lit" and t.dt == XSD + "dateTime"


# --- numbers -----------------------------------------------------------------------------------


def rank(t: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; null if a term is no number."""
    return F.when(t["k"] == LITERAL, F.when(t["dt"].isin(*INTEGERS), 1).when(t["dt"] == XSD + "decimal", 2).when(t["dt"] == XSD + "float", 3).when(t["dt"] == XSD + "double", 4))


def as_double(v: Value) -> Column:
    if v.numeric:
        return v.col.cast("double")
    t = as_term(v)
    return F.when(rank(t).isNotNull(), parse_native(t["v"], XSD + "double"))


def as_exact(v: Value) -> Column:
    if v.numeric and v.type.dt not in (XSD + "double", XSD + "float"):
        return v.col.try_cast(WIDE)
    t = as_term(v)
    return F.when(rank(t) <= 2, t["v"].try_cast(WIDE))


def number_term(r: Column, exact: Column, double: Column) -> Value:
    """A number whose datatype is known by row only."""
    lex = F.when(r == 1, exact.try_cast("bigint").cast("string")).when(r == 2, lexical(Value(exact, DEC))).otherwise(lexical(Value(double, DBL)))
    dt = F.when(r == 1, XSD + "integer").when(r == 2, XSD + "decimal").when(r == 3, XSD + "float").otherwise(XSD + "double")
    return Value(F.when(r.isNotNull() & lex.isNotNull(), struct(LITERAL, lex, dt)), TERM)


TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.numeric and b.numeric:
        dts = {a.type.dt, b.type.dt}
        if dts & {XSD + "double", XSD + "float"}:
            x, y = a.col.cast("double"), b.col.cast("double")
            out = F.when(y != 0, x / F.when(y != 0, y)).otherwise(F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op]
            return Value(F.when(x.isNotNull() & y.isNotNull(), out), DBL if XSD + "double" in dts else FLT)
        if XSD + "decimal" in dts or op == "/":
            own = lambda v: v.col if v.type.dt == XSD + "decimal" else v.col.cast("decimal(19,0)")
            if op == "/":
                return Value(F.try_divide(a.col.try_cast(EXACT), b.col.try_cast(EXACT)), DEC)
            return Value(TRY[op](own(a), own(b)), DEC)
        return Value(TRY[op](a.col.cast("bigint"), b.col.cast("bigint")), INT)
    s, t = as_term(a), as_term(b)
    r = F.when(rank(s).isNotNull() & rank(t).isNotNull(), F.greatest(rank(s), rank(t), F.lit(2 if op == "/" else 1)))
    double = arithmetic(op, Value(as_double(a), DBL), Value(as_double(b), DBL)).col
    kind = EXACT if op in "*/" else WIDE
    return number_term(r, TRY[op](as_exact(a).try_cast(kind), as_exact(b).try_cast(kind)).try_cast(kind), double)


def unary_number(v: Value, whole: Callable[[Column], Column], double: Callable[[Column], Column]) -> Value:
    """A function that keeps its argument's datatype."""
    if v.numeric:
        if v.type.dt in INTEGERS:
            return Value(whole(v.col).cast("bigint"), INT)
        return Value(double(v.col), v.type)
    return number_term(rank(as_term(v)), double(as_exact(v)).try_cast(WIDE), double(as_double(v)).cast("double"))


def half_up(c: Column) -> Column:
    """Rounds halves up, towards positive infinity."""
    return F.floor(c + F.lit(0.5).cast("decimal(2,1)"))


# --- comparison --------------------------------------------------------------------------------

COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
ZONE = r"(Z|[+-]\d\d:\d\d)$"


def compare(op: str, a: Value, b: Value) -> Value:
    f, equality = COMPARE[op], op in ("=", "!=")
    x, y = a.type, b.type
    if x.kind == "iri" and y.kind == "iri":
        if not equality:
            return boolean(F.lit(None).cast("boolean"))
        if x.prefix is not None and x.prefix == y.prefix:
            return boolean(f(a.col, b.col))
        if x.prefix is not None and y.prefix is None:  # a constant is compared by its key, which reaches the scan
            return boolean(f(lexical(a), b.col))
        return boolean(f(lexical(a), lexical(b)))
    if x.kind == "lit" and y.kind == "lit":
        if a.numeric and b.numeric:
            if (XSD + "double" in (x.dt, y.dt)) or (XSD + "float" in (x.dt, y.dt)):
                return boolean(f(a.col.cast("double"), b.col.cast("double")))
            return boolean(f(a.col, b.col))
        if x.dt == y.dt and (x.dt != LANG_STRING or x.lang == y.lang) and (x.dt in (STRING, LANG_STRING, XSD + "boolean", XSD + "dateTime", XSD + "date")):
            return boolean(f(a.col, b.col))
    if {x.kind, y.kind} == {"iri", "lit"}:
        there = a.col.isNotNull() & b.col.isNotNull()
        return boolean(F.when(there, F.lit(op == "!=")) if equality else F.lit(None).cast("boolean"))
    s, t = as_term(a), as_term(b)
    both = s.isNotNull() & t.isNotNull()
    numbers = F.when((rank(s) <= 2) & (rank(t) <= 2), f(as_exact(Value(s, TERM)), as_exact(Value(t, TERM)))).otherwise(f(as_double(Value(s, TERM)), as_double(Value(t, TERM))))
    dated = lambda c: c["dt"].isin(XSD + "dateTime", XSD + "dateTimeStamp")
    zoned = lambda c: c["v"].rlike(ZONE)
    moment = lambda c: F.to_timestamp(F.when(zoned(c), c["v"]).otherwise(F.concat(c["v"], F.lit("Z"))))
    apart = F.abs(F.unix_micros(moment(s)) - F.unix_micros(moment(t))) > 14 * 3600 * 1_000_000
    dates = F.when((zoned(s) == zoned(t)) | apart, f(moment(s), moment(t)))
    same = (s["k"] == t["k"]) & (s["v"] == t["v"]) & (s["dt"] == t["dt"]) & (s["lang"] == t["lang"])
    known = lambda c: c["dt"].isin(STRING, LANG_STRING, XSD + "boolean", XSD + "dateTime", XSD + "date", *NUMERIC)
    out = F.when(rank(s).isNotNull() & rank(t).isNotNull(), numbers)
    out = out.when((s["dt"] == STRING) & (t["dt"] == STRING), f(s["v"], t["v"]))
    out = out.when((s["dt"] == XSD + "boolean") & (t["dt"] == XSD + "boolean"), f(s["v"].isin("true", "1"), t["v"].isin("true", "1")))
    out = out.when(dated(s) & dated(t), dates)
    out = out.when((s["dt"] == XSD + "date") & (t["dt"] == XSD + "date"), f(s["v"].try_cast("date"), t["v"].try_cast("date")))
    if equality:
        out = out.when(same, F.lit(op == "="))
        out = out.when((s["k"] != t["k"]) | (s["k"] != LITERAL), F.lit(op == "!="))
        out = out.when((s["dt"] == LANG_STRING) & (t["dt"] == LANG_STRING), F.lit(op == "!="))
        out = out.when(known(s) & known(t) & ((s["dt"] == LANG_STRING) | (t["dt"] == LANG_STRING)), F.lit(op == "!="))
    return boolean(F.when(both, out))


def ebv(v: Value) -> Column:
    t = v.type
    if t.kind == "lit":
        if t == BOOL:
            return v.col
        if v.numeric:
            return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        if is_string(t):
            return F.length(v.col) > 0
        return F.lit(None).cast("boolean")
    if t.kind == "iri":
        return F.lit(None).cast("boolean")
    c = v.col
    n = as_double(v)
    return F.when(c["dt"] == XSD + "boolean", c["v"].isin("true", "1")).when(c["dt"].isin(STRING, LANG_STRING), F.length(c["v"]) > 0).when(rank(c).isNotNull(), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))


def same_term(a: Value, b: Value) -> Column:
    if a.type == b.type and a.type.kind != "term":
        return a.col == b.col
    return as_term(a) == as_term(b)


# --- strings -----------------------------------------------------------------------------------


def text(v: Value) -> Column:
    """The characters of a string literal; null for other terms."""
    if is_string(v.type):
        return v.col
    if v.type.kind == "term":
        return F.when(v.col["dt"].isin(STRING, LANG_STRING), v.col["v"])
    return F.lit(None).cast("string")


def like(v: Value, c: Column) -> Value:
    """A string with the language of v."""
    if v.type.kind == "term":
        return Value(F.when(c.isNotNull(), struct(LITERAL, c, v.col["dt"], v.col["lang"])), TERM)
    return Value(c, v.type if is_string(v.type) else STR)


def compatible(a: Value, b: Value) -> Column:
    """Whether b may be an argument to a: plain, or of a's language."""
    if is_string(a.type) and is_string(b.type):
        return F.lit(b.type.dt == STRING or b.type.lang == a.type.lang)
    s, t = as_term(a), as_term(b)
    return (t["dt"] == STRING) | (s["lang"] == t["lang"])


def two_strings(f: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    return lambda a, b: boolean(F.when(compatible(a, b), f(text(a), text(b))))


def before_after(after: bool) -> Callable[[Value, Value], Value]:
    def f(a: Value, b: Value) -> Value:
        x, y = text(a), text(b)
        at = F.position(y, x)
        got = F.substring(x, at + F.char_length(y), F.char_length(x)) if after else F.substring(x, F.lit(1), at - 1)
        return like(a, F.when(compatible(a, b) & x.isNotNull() & y.isNotNull(), F.when(at > 0, got).otherwise("")))

    return f


def java_flags(pattern: Value, flags: Value | None) -> Column:
    """The pattern with its flags in front; q quotes it."""
    p = text(pattern)
    if flags is None:
        return p
    f = text(flags)
    return F.when(f.contains("q"), F.concat(F.lit("\\Q"), p, F.lit("\\E"))).otherwise(F.when(F.length(f) > 0, F.concat(F.lit("(?"), f, F.lit(")"), p)).otherwise(p))


def regex(v: Value, pattern: Value, flags: Value | None = None) -> Value:
    return boolean(F.rlike(text(v), java_flags(pattern, flags)))


def replace(v: Value, pattern: Value, to: Value, flags: Value | None = None) -> Value:
    return like(v, F.regexp_replace(text(v), java_flags(pattern, flags), text(to)))


def substr(v: Value, start: Value, length: Value | None = None) -> Value:
    x = text(v)
    a = half_up(as_exact(start)).cast("int")
    b = F.lit(2**31 - 1).cast("bigint") if length is None else a.cast("bigint") + half_up(as_exact(length))
    first = F.greatest(a, F.lit(1))
    return like(v, F.substring(x, first, F.greatest(F.lit(0), F.least(b - first, F.lit(2**31 - 1).cast("bigint"))).cast("int")))


def encode_for_uri(v: Value) -> Value:
    c = F.url_encode(text(v))
    for a, b in (("\\+", "%20"), ("\\*", "%2A"), ("%7E", "~")):
        c = F.regexp_replace(c, a, b)
    return string(c)


def concat(*vs: Value) -> Value:
    kinds = {v.type for v in vs}
    c = F.concat(*[text(v) for v in vs]) if vs else F.lit("")
    return Value(c, vs[0].type) if len(kinds) == 1 and is_string(vs[0].type) else string(c)


# --- dates -------------------------------------------------------------------------------------


def stamp(v: Value) -> tuple[Column, Column]:
    """(local time without zone, lexical zone or '') of a dateTime."""
    if naive(v.type):
        return v.col, F.when(v.col.isNotNull(), "")
    if v.type == DATE:
        return v.col.cast("timestamp_ntz"), F.when(v.col.isNotNull(), "")
    t = as_term(v)
    there = t["dt"].isin(XSD + "dateTime", XSD + "dateTimeStamp", XSD + "date")
    zone = F.when(there, F.regexp_extract(t["v"], ZONE, 1))
    return F.when(there, F.regexp_replace(t["v"], ZONE, "").try_cast("timestamp_ntz")), zone


def part_of(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value(f(stamp(v)[0]).cast("bigint"), INT)


def seconds(v: Value) -> Value:
    return Value(F.extract(F.lit("SECOND"), stamp(v)[0]).cast("decimal(10,6)"), DEC)


def timezone(v: Value) -> Value:
    z = stamp(v)[1]
    sign, h, m = F.when(z.startswith("-"), "-").otherwise(""), F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    span = F.concat(sign, F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    lex = F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").when(z != "", span)
    return Value(struct(LITERAL, lex, DTD.dt), TERM)


def adjust(v: Value, zone: Value | None = None) -> Value:
    """A dateTime in another time zone ('Z', '+02:00' or a dayTimeDuration); naive ones count as UTC. Fractions of seconds are cut."""
    local, own = stamp(v)
    z = lexical(zone) if zone is not None else F.lit("Z")
    minutes = lambda c: F.when(c.isin("Z", ""), 0).otherwise(F.when(c.startswith("-"), -1).otherwise(1) * (F.substring(c, 2, 2).try_cast("int") * 60 + F.substring(c, 5, 2).try_cast("int")))
    hours = lambda c, u: F.coalesce(F.regexp_extract(c, rf"(\d+){u}", 1).try_cast("int"), F.lit(0))
    span = F.when(z.rlike("^-?P"), F.when(z.startswith("-"), -1).otherwise(1) * (hours(z, "H") * 60 + hours(z, "M"))).otherwise(minutes(z))
    at = F.timestamp_add("MINUTE", span - minutes(own), local)
    shown = F.when(span == 0, F.when(z.isin("+00:00"), "+00:00").otherwise("Z")).otherwise(F.concat(F.when(span < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(span) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(span) % 60).cast("string"), 2, "0")))
    return Value(struct(LITERAL, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), shown), XSD + "dateTime"), TERM)


# --- terms -------------------------------------------------------------------------------------


def lang(v: Value) -> Value:
    if v.type.kind == "lit":
        return string(F.when(v.col.isNotNull(), F.lit(v.type.lang)))
    t = as_term(v)
    return string(F.when(t["k"] == LITERAL, t["lang"]))


def datatype(v: Value) -> Value:
    if v.type.kind == "lit":
        return Value(F.when(v.col.isNotNull(), F.lit(v.type.dt)), IRI_T)
    t = as_term(v)
    return Value(F.when(t["k"] == LITERAL, t["dt"]), IRI_T)


def lang_matches(a: Value, b: Value) -> Value:
    x, y = F.lower(text(a)), F.lower(text(b))
    return boolean(F.when(y == "*", x != "").otherwise((x == y) | x.startswith(F.concat(y, F.lit("-")))))


def kind_is(*kinds: int) -> Callable[[Value], Value]:
    def f(v: Value) -> Value:
        if v.type.kind == "term":
            return boolean(v.col["k"].isin(*kinds))
        own = IRI if v.type.kind == "iri" else LITERAL
        return boolean(F.when(v.col.isNotNull(), F.lit(own in kinds)))

    return f


def is_numeric(v: Value) -> Value:
    if v.type.kind == "term":
        return boolean(F.when(v.col.isNotNull(), F.coalesce(rank(v.col).isNotNull() & as_double(v).isNotNull(), F.lit(False))))
    return boolean(F.when(v.col.isNotNull(), F.lit(v.numeric)))


def strdt(v: Value, dt: Value) -> Value:
    return Value(struct(LITERAL, text(v), lexical(dt)), TERM)


def strlang(v: Value, tag: Value) -> Value:
    return Value(struct(LITERAL, text(v), LANG_STRING, F.lower(text(tag))), TERM)


def canonical(v: Value) -> Column:
    """N-Triples text of a term, by which quoted triples are kept."""
    t = as_term(v)
    esc = t["v"]
    for a, b in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r")):
        esc = F.regexp_replace(esc, a, b)
    quoted = F.concat(F.lit('"'), esc, F.lit('"'))
    tail = F.when(t["lang"] != "", F.concat(F.lit("@"), t["lang"])).when(t["dt"] == STRING, "").otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == BLANK, F.concat(F.lit("_:"), t["v"])).when(t["k"] == TRIPLE, t["v"]).otherwise(F.concat(quoted, tail))


def triple(s: Value, p: Value, o: Value) -> Value:
    return Value(struct(TRIPLE, F.concat(F.lit("<< "), canonical(s), F.lit(" "), canonical(p), F.lit(" "), canonical(o), F.lit(" >>"))), TERM)


_ONE = r"""(<< .* >>|<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)"""
_QUOTED = rf"(?s)^<< {_ONE} (<[^>]*>) {_ONE} >>$"


def part(v: Value, n: int) -> Value:
    """The n-th term of a quoted triple, from its canonical text."""
    t = as_term(v)
    x = F.when((t["k"] == TRIPLE), F.regexp_extract(t["v"], _QUOTED, n))
    body = F.regexp_extract(x, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\\\n", "\n"), ("\\\\r", "\r"), ('\\\\"', '"'), ("\\\\\\\\", "\\\\")):
        body = F.regexp_replace(body, a, b)
    tag, dt = F.regexp_extract(x, r'"@([\w-]+)$', 1), F.regexp_extract(x, r'"\^\^<([^>]*)>$', 1)
    value = F.when(x.startswith("<<"), struct(TRIPLE, x)).when(x.startswith("<"), struct(IRI, F.regexp_extract(x, "^<(.*)>$", 1))).when(x.startswith("_:"), struct(BLANK, F.substring(x, F.lit(3), F.length(x))))
    value = value.when(x.startswith('"'), struct(LITERAL, body, F.when(tag != "", LANG_STRING).when(dt != "", dt).otherwise(STRING), tag))
    return Value(value, TERM)


def if_(c: Value, a: Value, b: Value) -> Value:
    test = ebv(c)
    x, y, t = unified(a, b)
    return Value(F.when(test.isNotNull(), F.when(test, x).otherwise(y)), t)


def unified(*vs: Value) -> tuple:
    """The values' columns in one type, and that type."""
    known = [v for v in vs if not is_null(v)]
    types = {v.type for v in known}
    if len(types) == 1 and known[0].type.kind != "term":
        t = next(iter(types))
        none = F.lit(None)
        return (*[none if is_null(v) else v.col for v in vs], t)
    if types and all(x.kind == "iri" for x in types):
        return (*[lexical(v) for v in vs], IRI_T)
    return (*[as_term(v) for v in vs], TERM)


def is_null(v: Value) -> bool:
    return v.type == TERM and str(v.col).startswith("Column<'CAST(NULL")


def coalesce(*vs: Value) -> Value:
    *cols, t = unified(*vs)
    return Value(F.coalesce(*cols), t)


def in_(v: Value, *options: Value) -> Value:
    return boolean(reduce(lambda a, b: a | b, [compare("=", v, o).col for o in options], F.lit(False)))


def cast_to(dt: str) -> Callable[[Value], Value]:
    def f(v: Value) -> Value:
        own = v.type
        if dt == STRING:
            return string(lexical(v))
        if own.kind == "lit" and own.dt == dt:
            return v
        if v.numeric or own == BOOL:
            c = v.col.cast("int") if own == BOOL else v.col
            if dt in INTEGERS:
                return Value((F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)) if v.numeric and own.dt not in INTEGERS else c).try_cast("bigint"), lit(dt))
            if dt == XSD + "decimal":
                return Value(c.try_cast(WIDE), DEC)
            if dt in (XSD + "double", XSD + "float"):
                return Value(c.cast("double"), lit(dt))
            if dt == XSD + "boolean":
                return Value((c != 0) & ~F.isnan(c.cast("double")), BOOL)
        if naive(own) and dt == XSD + "date":
            return Value(v.col.cast("date"), DATE)
        if own == DATE and dt == XSD + "dateTime":
            return Value(v.col.cast("timestamp_ntz"), DATETIME)
        lex = lexical(v)
        t = as_term(v)
        if dt == XSD + "dateTime":
            full = F.when(lex.rlike(r"^-?\d{4,}-\d\d-\d\d$"), F.concat(lex, F.lit("T00:00:00"))).otherwise(lex)
            return Value(struct(LITERAL, F.when(F.regexp_replace(full, ZONE, "").try_cast("timestamp_ntz").isNotNull() & full.contains("T"), full), dt), TERM)
        if dt in INTEGERS:
            number = F.when(rank(t).isNotNull(), F.coalesce(lex.try_cast(EXACT), lex.try_cast("double").try_cast(EXACT)))
            cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("bigint")
            return Value(F.coalesce(parse_native(F.trim(lex), dt), cut, F.when(t["dt"] == XSD + "boolean", F.when(lex.isin("true", "1"), 1).otherwise(0)).cast("bigint")), lit(dt))
        return Value(parse_native(lex, dt), lit(dt))

    return f


CASTS = {XSD + n: cast_to(XSD + n) for n in "integer int long short byte decimal double float boolean string dateTime date".split()}


def digest(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: string(f(text(v)))


def make_iri(v: Value) -> Value:
    t = as_term(v)
    return v if v.type.kind == "iri" else Value(F.when((t["k"] == IRI) | (t["dt"] == STRING), t["v"]), IRI_T)


def blank(v: Value | None = None) -> Value:
    return Value(struct(BLANK, F.concat(F.lit("n"), F.replace(F.uuid(), F.lit("-"), F.lit(""))) if v is None else F.concat(F.lit("l"), F.md5(text(v)))), TERM)


REGISTRY: dict[str, Callable[..., Value]] = {
    "STR": lambda v: string(lexical(v)),
    "LANG": lang,
    "LANGMATCHES": lang_matches,
    "DATATYPE": datatype,
    "IRI": make_iri,
    "URI": make_iri,
    "BNODE": blank,
    "STRDT": strdt,
    "STRLANG": strlang,
    "SAMETERM": lambda a, b: boolean(same_term(a, b)),
    "ISIRI": kind_is(IRI),
    "ISURI": kind_is(IRI),
    "ISBLANK": kind_is(BLANK),
    "ISLITERAL": kind_is(LITERAL),
    "ISTRIPLE": kind_is(TRIPLE),
    "ISNUMERIC": is_numeric,
    "ABS": lambda v: unary_number(v, F.abs, F.abs),
    "CEIL": lambda v: unary_number(v, lambda c: c, F.ceil),
    "FLOOR": lambda v: unary_number(v, lambda c: c, F.floor),
    "ROUND": lambda v: unary_number(v, lambda c: c, half_up),
    "RAND": lambda: Value(F.rand(), DBL),
    "NEGATE": lambda v: unary_number(v, lambda c: -c, lambda c: -c),
    "STRLEN": lambda v: Value(F.char_length(text(v)).cast("bigint"), INT),
    "SUBSTR": substr,
    "UCASE": lambda v: like(v, F.upper(text(v))),
    "LCASE": lambda v: like(v, F.lower(text(v))),
    "STRSTARTS": two_strings(lambda a, b: a.startswith(b)),
    "STRENDS": two_strings(lambda a, b: a.endswith(b)),
    "CONTAINS": two_strings(lambda a, b: a.contains(b)),
    "STRBEFORE": before_after(False),
    "STRAFTER": before_after(True),
    "CONCAT": concat,
    "ENCODE_FOR_URI": encode_for_uri,
    "REGEX": regex,
    "REPLACE": replace,
    "MD5": digest(F.md5),
    "SHA1": digest(F.sha1),
    "SHA256": digest(lambda c: F.sha2(c, 256)),
    "SHA384": digest(lambda c: F.sha2(c, 384)),
    "SHA512": digest(lambda c: F.sha2(c, 512)),
    "NOW": lambda: Value(struct(LITERAL, F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), XSD + "dateTime"), TERM),
    "YEAR": part_of(F.year),
    "MONTH": part_of(F.month),
    "DAY": part_of(F.day),
    "HOURS": part_of(F.hour),
    "MINUTES": part_of(F.minute),
    "SECONDS": seconds,
    "TZ": lambda v: string(stamp(v)[1]),
    "TIMEZONE": timezone,
    "ADJUST": adjust,
    "UUID": lambda: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI_T),
    "STRUUID": lambda: string(F.uuid()),
    "TRIPLE": triple,
    "SUBJECT": lambda v: part(v, 1),
    "PREDICATE": lambda v: part(v, 2),
    "OBJECT": lambda v: part(v, 3),
    "IF": if_,
    "COALESCE": coalesce,
    "IN": in_,
    **CASTS,
}


def register(name: str, f: Callable[..., Value]) -> None:
    """A custom function by IRI: takes and gives Values."""
    REGISTRY[name] = f


def order_key(v: Value) -> list[Column]:
    """Columns that sort as SPARQL does: unbound, blank nodes, IRIs, literals."""
    if v.type.kind != "term":
        return [native_order(v)]
    t = v.col
    number = as_double(v)
    return [F.when(t.isNull(), 0).otherwise(t["k"]), F.when(rank(t).isNotNull(), 1).otherwise(2), number, t["v"], t["dt"], t["lang"]]


def native_order(v: Value) -> Column:
    return lexical(v) if v.type.kind == "iri" else v.col


def from_constant(t: Term) -> Value:
    return constant(t)
