"""RDF terms: constants on the driver, and the column forms of variables.

A column of known type is native (BIGINT, DOUBLE, STRING ...), so that filters, joins and aggregates stay in
generated code and reach the scan. Only a variable of mixed type is a struct, TERM. Null is unbound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
GEO = "http://www.opengis.net/ont/geosparql#"
GEOF = "http://www.opengis.net/def/function/geosparql/"
LANG_STRING = RDF + "langString"
STRING = XSD + "string"
TYPE = RDF + "type"

#: Kinds of a term, in the order in which SPARQL sorts them.
BLANK, IRI, LITERAL, TRIPLE = 1, 2, 3, 4
TERM_TYPE = "struct<k:tinyint,v:string,dt:string,lang:string>"

INTEGERS = tuple(XSD + n for n in "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
NUMERIC = (*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double")


@dataclass(frozen=True)
class Term:
    """A constant. lex is the IRI, the blank node's label, the lexical form, or a quoted triple's canonical text."""

    kind: int
    lex: str
    dt: str = ""
    lang: str = ""

    def nt(self) -> str:
        if self.kind == IRI:
            return f"<{self.lex}>"
        if self.kind == BLANK:
            return f"_:{self.lex}"
        if self.kind == TRIPLE:
            return self.lex
        text = self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        if self.lang:
            return f'"{text}"@{self.lang}'
        return f'"{text}"' if self.dt == STRING else f'"{text}"^^<{self.dt}>'


def iri(x: str) -> Term:
    return Term(IRI, x)


def literal(x: object, dt: str | None = None, lang: str = "") -> Term:
    if lang:
        return Term(LITERAL, str(x), LANG_STRING, lang.lower())
    if dt is None:
        dt = XSD + ("boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "double" if isinstance(x, float) else "string")
    return Term(LITERAL, str(x).lower() if isinstance(x, bool) else str(x), dt)


@dataclass(frozen=True)
class Type:
    """What all values of a column are: 'iri' (a string, or a key under a prefix), 'lit' of one datatype, or 'term' (anything)."""

    kind: str
    dt: str = ""
    lang: str = ""
    prefix: str | None = None


TERM = Type("term")
IRI_T = Type("iri")


def lit(dt: str, lang: str = "") -> Type:
    return Type("lit", dt if dt.startswith("http") else XSD + dt, lang)


BOOL, INT, DEC, DBL, STR = lit("boolean"), lit("integer"), lit("decimal"), lit("double"), lit("string")
DATETIME, DATE = lit("dateTime"), lit("date")


@dataclass(frozen=True)
class Value:
    """An expression's column and type."""

    col: Column
    type: Type

    @property
    def numeric(self) -> bool:
        return self.type.kind == "lit" and self.type.dt in NUMERIC


def struct(kind: Column | int, v: Column, dt: Column | str = "", lang: Column | str = "") -> Column:
    c = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    return F.when(v.isNotNull(), F.struct(c(kind).cast("tinyint").alias("k"), v.alias("v"), c(dt).alias("dt"), c(lang).alias("lang")))


def lexical(v: Value) -> Column:
    """The lexical form (STR): canonical for native columns."""
    t = v.type
    if t.kind == "term":
        return v.col["v"]
    if t.kind == "iri":
        return v.col if t.prefix is None else F.concat(F.lit(t.prefix), v.col.cast("string"))
    if t.dt == XSD + "dateTime":
        text = F.regexp_replace(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        return F.regexp_replace(text, r"(T\d\d:\d\d)$", "$1:00")  # seconds of 00 lose their zeros above
    if t.dt == XSD + "decimal":
        return F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if t.dt in (XSD + "double", XSD + "float"):
        c = v.col.cast("string")
        return F.regexp_replace(F.when(c == "Infinity", "INF").when(c == "-Infinity", "-INF").otherwise(c), r"\.0$", "")
    return v.col.cast("string")


def as_term(v: Value) -> Column:
    if v.type.kind == "term":
        return v.col
    if v.type.kind == "iri":
        return struct(IRI, lexical(v))
    return struct(LITERAL, lexical(v), v.type.dt, v.type.lang)


def native(v: Value) -> Column:
    """The column for results: IRIs as strings, others as they are."""
    return lexical(v) if v.type.kind == "iri" else v.col


def parse_native(lex: Column, dt: str) -> Column:
    """A lexical form as the native value of a datatype; null if it is ill-formed."""
    if dt in INTEGERS:
        return F.when(lex.rlike(r"^\s*[+-]?\d+\s*$"), lex.try_cast("bigint"))
    if dt == XSD + "decimal":
        return lex.try_cast("decimal(38,18)")
    if dt in (XSD + "double", XSD + "float"):
        return F.when(lex == "INF", F.lit(float("inf"))).when(lex == "-INF", F.lit(float("-inf"))).otherwise(lex.try_cast("double"))
    if dt == XSD + "boolean":
        return F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)
    if dt == XSD + "dateTime":
        return lex.try_cast("timestamp_ntz")
    if dt == XSD + "date":
        return lex.try_cast("date")
    return lex


def native_of(dt: str) -> bool:
    return dt in NUMERIC or dt in (STRING, XSD + "boolean", XSD + "date")


def constant(t: Term) -> Value:
    if t.kind == IRI:
        return Value(F.lit(t.lex), IRI_T)
    if t.kind == LITERAL:
        kind = lit(t.dt, t.lang)
        if t.dt in INTEGERS and t.lex.lstrip("+-").isdigit() and abs(int(t.lex)) < 2**63:
            return Value(F.lit(int(t.lex)).cast("bigint"), INT)
        if t.dt == XSD + "dateTime" and not t.lex.endswith("Z") and "+" not in t.lex and t.lex.count("-") == 2:
            return Value(F.lit(t.lex).cast("timestamp_ntz"), kind)
        if t.dt in (STRING, LANG_STRING):
            return Value(F.lit(t.lex), kind)
        if native_of(t.dt):
            return Value(parse_native(F.lit(t.lex), t.dt), kind)
    return Value(F.struct(F.lit(t.kind).cast("tinyint").alias("k"), F.lit(t.lex).alias("v"), F.lit(t.dt).alias("dt"), F.lit(t.lang).alias("lang")), TERM)


def unbound() -> Value:
    return Value(F.lit(None).cast(TERM_TYPE), TERM)
