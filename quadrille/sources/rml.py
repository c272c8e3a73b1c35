"""RML: CSV, JSON and XML sources to triples, as one select for each predicate-object map.

Only what the mapping names is read. An empty or missing value gives no triple; values in templates are
percent-encoded; blank nodes are scoped to a row; a predicate-object map's graphs override the subject's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.shacl import Small
from quadrille.sources.dataset import QUADS, QuadTable
from quadrille.terms import BLANK, IRI, LANG_STRING, LITERAL, RDF, STRING, Term, iri, struct

RR, RML = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#"


@dataclass(frozen=True)
class TermMap:
    kind: str  # constant, reference or template
    value: str
    term: int = IRI
    dt: str = STRING
    lang: str = ""


@dataclass
class TriplesMap:
    source: str
    formulation: str
    iterator: str
    subject: TermMap
    classes: list[str] = field(default_factory=list)
    graphs: list[TermMap] = field(default_factory=list)
    pairs: list[tuple[list[TermMap], list[TermMap], list[TermMap]]] = field(default_factory=list)  # predicates, objects, graphs


def term_map(g: Small, node: Term, default: int) -> TermMap:
    kind = {RR + "IRI": IRI, RR + "Literal": LITERAL, RR + "BlankNode": BLANK}.get((g.one(node, RR + "termType") or iri("")).lex)
    lang, dt = g.one(node, RR + "language"), g.one(node, RR + "datatype")
    if c := g.one(node, RR + "constant"):
        return TermMap("constant", c.lex, c.kind, c.dt or STRING, c.lang)
    reference = g.one(node, RML + "reference") or g.one(node, RR + "column")
    how, value = ("reference", reference.lex) if reference else ("template", (g.one(node, RR + "template") or iri("")).lex)
    literal_like = default == LITERAL and (how == "reference" or lang or dt)
    return TermMap(how, value, kind or (LITERAL if literal_like else IRI), LANG_STRING if lang else dt.lex if dt else STRING, lang.lex.lower() if lang else "")


def read_mapping(text: str) -> list[TriplesMap]:
    g, out = Small(text), []
    maps = lambda s, p, short, default: [term_map(g, x, default) for x in g.all(s, RR + p)] + [TermMap("constant", x.lex, x.kind, x.dt or STRING, x.lang) for x in g.all(s, RR + short)]
    for name in [s for s in list(g.out) if g.all(s, RML + "logicalSource")]:
        source = g.one(name, RML + "logicalSource")
        if not any(g.all(name, RR + x) for x in ("subjectMap", "subject")):
            raise ValueError(f"{name.lex} has no subject map")
        s = g.one(name, RR + "subjectMap")
        t = TriplesMap(
            (g.one(source, RML + "source") or iri("")).lex,
            (g.one(source, RML + "referenceFormulation") or iri("CSV")).lex.rsplit("#", 1)[-1],
            (g.one(source, RML + "iterator") or iri("")).lex,
            maps(name, "subjectMap", "subject", IRI)[0],
            [c.lex for c in g.all(s, RR + "class")] if s else [],
            maps(s, "graphMap", "graph", IRI) if s else [],
        )
        for po in g.all(name, RR + "predicateObjectMap"):
            t.pairs.append((maps(po, "predicateMap", "predicate", IRI), maps(po, "objectMap", "object", LITERAL), maps(po, "graphMap", "graph", IRI)))
        out.append(t)
    return out


def rows(spark: SparkSession, t: TriplesMap, sources: dict[str, str | DataFrame]) -> DataFrame:
    """A source's records as text columns; nested values as JSON text, null as empty."""
    src = sources.get(t.source, t.source)
    if isinstance(src, DataFrame):
        return src
    if t.formulation == "JSONPath":
        steps = [x for x in re.split(r"\.|(\[\*\])", t.iterator.removeprefix("$")) if x]
        df = spark.read.json(src, multiLine=True)
        for x in steps:
            if x == "[*]":
                continue
            df = df.select(F.explode(x).alias("r")) if dict(df.dtypes)[x].startswith("array") else df.select(F.col(x).alias("r"))
            df = df.select("r.*")
        return df.select(*[(F.to_json(c) if dt.startswith(("struct", "array")) else F.col(c).cast("string")).alias(c) for c, dt in df.dtypes])
    if t.formulation == "XPath":
        return spark.read.format("xml").option("rowTag", t.iterator.rstrip("/").rsplit("/", 1)[-1]).option("inferSchema", "false").load(src)
    return spark.read.csv(src, header=True)


def cell(df: DataFrame, name: str) -> Column:
    name = name.replace("@", "_")
    return F.nullif(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def encoded(c: Column) -> Column:
    for a, b in (("\\+", "%20"), ("\\*", "%2A"), ("-", "%2D"), ("\\.", "%2E"), ("_", "%5F")):
        c = F.regexp_replace(F.url_encode(c) if a == "\\+" else c, a, b)
    return c


def value(df: DataFrame, m: TermMap) -> Column:
    if m.kind == "constant":
        v = F.lit(m.value)
    elif m.kind == "reference":
        v = cell(df, m.value)
    else:
        parts = re.split(r"\{([^}]*)\}", m.value)
        v = F.concat(*[F.lit(x) if i % 2 == 0 else encoded(cell(df, x)) for i, x in enumerate(parts)])
    if m.term == BLANK and m.kind != "constant":
        v = F.concat(F.lit("r"), F.substring(F.md5(F.concat_ws("|", F.lit(m.value), v, F.col("__row"))), 1, 16))
    return struct(m.term, v, m.dt if m.term == LITERAL else "", m.lang)


def execute(spark: SparkSession, mapping: str, sources: dict[str, str | DataFrame] | None = None) -> QuadTable:
    """All triples of a mapping; sources gives files or DataFrames for the names that it uses."""
    out = []
    for t in read_mapping(mapping):
        df = rows(spark, t, sources or {}).withColumn("__row", F.monotonically_increasing_id().cast("string"))
        s = value(df, t.subject)
        items = []
        for graphs, ps, os in [(t.graphs, [TermMap("constant", RDF + "type")], [TermMap("constant", c) for c in t.classes])] + [(g or t.graphs, ps, os) for ps, os, g in t.pairs]:
            for g in graphs or [None]:
                for p in ps:
                    for o in os:
                        name = F.lit(None).cast("string") if g is None else value(df, g)["v"]
                        items.append(F.struct(name.alias("g"), s.alias("s"), value(df, p)["v"].alias("p"), value(df, o).alias("o")))
        if items:
            out.append(df.select(F.explode(F.array(*items)).alias("q")).select("q.*").where("s is not null and p is not null and o is not null"))
    return QuadTable(reduce(DataFrame.unionByName, out).distinct()) if out else QuadTable(spark.createDataFrame([], QUADS))
