"""RDF text: N-Triples and N-Quads by lines (splittable), Turtle and TriG by whole files, and writers.

Lines are read with native expressions. Turtle, TriG and RDF/XML files can't be split; each is parsed in one
task (mapInArrow), many files in parallel. Blank labels are kept apart by file (policy 'preserve' keeps them).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.scalar import canonical
from quadrille.plans.algebra import Quoted
from quadrille.plans.parser import Parser
from quadrille.sources.dataset import QUADS, QuadTable
from quadrille.terms import BLANK, IRI, LITERAL, RDF, STRING, TERM, TRIPLE, Term, Value, iri, literal, struct

_TERM = r"""(<[^>]*>|_:[^\s<>"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?|<< .* >>)"""
LINE = rf"^\s*{_TERM}\s*<([^>]*)>\s*{_TERM}\s*(?:(<[^>]*>|_:\S+)\s*)?\.\s*(?:#.*)?$"


def unescaped(c: Column) -> Column:
    """Character escapes of a literal or IRI; \\u escapes go through JSON's reader, which has the same ones."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\'", "'"), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    return F.when(c.contains("\\"), F.get_json_object(F.concat(F.lit('{"x":"'), F.regexp_replace(plain, "\t", r"\\t"), F.lit('"}')), "$.x")).otherwise(c)


def parsed(x: Column) -> Column:
    """A term struct from its N-Triples text."""
    body = unescaped(F.regexp_extract(x, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    tag, dt = F.regexp_extract(x, r'"@([A-Za-z0-9\-]+)$', 1), F.regexp_extract(x, r'"\^\^<([^>]*)>$', 1)
    kind = F.when(tag != "", RDF + "langString").when(dt != "", dt).otherwise(STRING)
    out = F.when(x.startswith("<<"), struct(TRIPLE, x)).when(x.startswith("<"), struct(IRI, unescaped(F.regexp_extract(x, "^<(.*)>$", 1))))
    return out.when(x.startswith("_:"), struct(BLANK, F.substring(x, F.lit(3), F.length(x)))).when(x.startswith('"'), struct(LITERAL, body, kind, F.lower(tag)))


def read_lines(spark: SparkSession, path: str, graph: str | None = None) -> QuadTable:
    """N-Triples or N-Quads. Ill-formed lines raise an error; blank and comment lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    sound = F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an N-Quads line: "), F.col("value"))))
    rows = lines.select(sound.alias("value")).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"))
    g = F.when(F.col("g") != "", F.regexp_replace("g", "^<|>$", "")).otherwise(F.lit(graph))
    return QuadTable(rows.select(g.alias("g"), parsed(F.col("s")).alias("s"), unescaped(F.col("p")).alias("p"), parsed(F.col("o")).alias("o")).distinct())


class Turtle(Parser):
    """Turtle and TriG: SPARQL's terms with data rules."""

    def __init__(self, text: str, base: str = "") -> None:
        super().__init__(text, base)
        self.ground = True

    def document(self) -> Iterator[tuple[str | None, Term, str, Term]]:
        while self.peek()[0] != "end":
            if self.declaration():
                continue
            if self.word("GRAPH") or self.peek()[0] in ("iri", "pname", "blank") and self.peek(1) == ("op", "{"):
                name = self.node()
                yield from self.block(name.lex)
            elif self.is_op("{"):
                yield from self.block(None)
            else:
                yield from self.quads(None)
                self.need(".")

    def block(self, graph: str | None) -> Iterator[tuple[str | None, Term, str, Term]]:
        self.need("{")
        while not self.take("}"):
            if not self.take("."):
                yield from self.quads(graph)

    def quads(self, graph: str | None) -> Iterator[tuple[str | None, Term, str, Term]]:
        for t in self.triples():
            yield graph, ground(t.s), ground(t.p).lex, ground(t.o)


def ground(x: object) -> Term:
    if isinstance(x, Quoted):
        return Term(TRIPLE, "<< " + " ".join(ground(y).nt() for y in (x.s, x.p, x.o)) + " >>")
    if not isinstance(x, Term):
        raise ValueError(f"a variable in data: {x}")
    return x


def rdf_xml(text: str, base: str = "") -> Iterator[tuple[None, Term, str, Term]]:
    """RDF/XML: typed nodes, property attributes, resources, collections, literals and nested nodes."""
    name = lambda tag: tag.replace("{", "").replace("}", "")
    count = iter(range(10**9))
    lang_key = "{http://www.w3.org/XML/1998/namespace}lang"
    resolve = lambda x: x if re.match(r"[A-Za-z][\w+.\-]*:", x) else base + x

    def node(e: ElementTree.Element, lang: str) -> Iterator:
        at = {name(k): v for k, v in e.attrib.items()}
        lang = e.get(lang_key, lang)
        if RDF + "about" in at:
            s = iri(resolve(at[RDF + "about"]))
        elif RDF + "ID" in at:
            s = iri(base + "#" + at[RDF + "ID"])
        else:
            s = Term(BLANK, at.get(RDF + "nodeID", f"x{next(count)}"))
        if name(e.tag) != RDF + "Description":
            yield s, RDF + "type", iri(name(e.tag))
        for k, v in at.items():
            if not k.startswith((RDF, "http://www.w3.org/XML/1998/namespace")) or k == RDF + "type":
                yield s, k, iri(v) if k == RDF + "type" else literal(v, STRING, lang)
        li = 0
        for c in e:
            p = name(c.tag)
            if p == RDF + "li":
                li += 1
                p = f"{RDF}_{li}"
            own = {name(k): v for k, v in c.attrib.items()}
            kind = own.get(RDF + "parseType")
            if RDF + "resource" in own:
                yield s, p, iri(resolve(own[RDF + "resource"]))
            elif RDF + "nodeID" in own:
                yield s, p, Term(BLANK, own[RDF + "nodeID"])
            elif kind == "Resource":
                b = Term(BLANK, f"x{next(count)}")
                yield s, p, b
                inner = ElementTree.Element("{" + RDF + "}Description", {"{" + RDF + "}nodeID": b.lex})
                inner.extend(list(c))
                yield from (t for t in walk(inner, lang))
            elif kind == "Collection":
                heads = [Term(BLANK, f"x{next(count)}") for _ in c]
                yield s, p, heads[0] if heads else iri(RDF + "nil")
                for i, item in enumerate(c):
                    first = list(walk(item, lang))
                    yield heads[i], RDF + "first", first_subject(item, first)
                    yield from first
                    yield heads[i], RDF + "rest", heads[i + 1] if i + 1 < len(heads) else iri(RDF + "nil")
            elif len(c):
                for item in c:
                    inner = list(walk(item, lang))
                    yield s, p, first_subject(item, inner)
                    yield from inner
            else:
                dt = own.get(RDF + "datatype")
                tag = c.get(lang_key, lang)
                yield s, p, literal(c.text or "", dt or STRING, "" if dt else tag)

    def first_subject(e: ElementTree.Element, inner: list) -> Term:
        at = {name(k): v for k, v in e.attrib.items()}
        if RDF + "about" in at:
            return iri(resolve(at[RDF + "about"]))
        return inner[0][0] if inner else Term(BLANK, at.get(RDF + "nodeID", f"x{next(count)}"))

    def walk(e: ElementTree.Element, lang: str) -> Iterator:
        yield from node(e, lang)

    root = ElementTree.fromstring(text)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        for s, p, o in walk(e, root.get(lang_key, "")):
            yield None, s, p, o


def json_ld(text: str, base: str = "") -> Iterator[tuple[str | None, Term, str, Term]]:
    """JSON-LD with inline contexts: prefixes, terms, @type coercion, @id, @graph, @list, @value, @language."""
    count = iter(range(10**9))

    def expand(x: str, ctx: dict, vocab: bool = True) -> str:
        if x in ctx and vocab:
            d = ctx[x]
            return expand(d["@id"] if isinstance(d, dict) else d, {k: v for k, v in ctx.items() if k != x}) if d else x
        prefix, colon, local = x.partition(":")
        if colon and not local.startswith("//") and prefix in ctx:
            d = ctx[prefix]
            return (d["@id"] if isinstance(d, dict) else d) + local
        return x if colon else (ctx.get("@vocab", "") if vocab else ctx.get("@base", base)) + x

    def subject(x: str, ctx: dict) -> Term:
        return Term(BLANK, x[2:]) if x.startswith("_:") else iri(expand(x, ctx, False))

    def value(v: object, ctx: dict, rule: dict, graph: str | None, out: list) -> Term | None:
        if isinstance(v, dict):
            if "@value" in v:
                x = v["@value"]
                kind = v.get("@type")
                return literal(x, expand(kind, ctx) if kind else None, v.get("@language", "")) if not isinstance(x, float) or kind else literal(x)
            if "@list" in v:
                head: Term = iri(RDF + "nil")
                for item in reversed(v["@list"]):
                    b = Term(BLANK, f"j{next(count)}")
                    out += [(graph, b, RDF + "first", value(item, ctx, rule, graph, out)), (graph, b, RDF + "rest", head)]
                    head = b
                return head
            return node(v, ctx, graph, out)
        if isinstance(v, str):
            kind = rule.get("@type")
            if kind in ("@id", "@vocab"):
                return subject(v, ctx)
            return literal(v, expand(kind, ctx) if kind else STRING, "" if kind else rule.get("@language", ctx.get("@language", "") or ""))
        kind = rule.get("@type")
        return None if v is None else literal(v, expand(kind, ctx) if kind else None)

    def node(x: dict, ctx: dict, graph: str | None, out: list) -> Term:
        own = x.get("@context")
        for c in own if isinstance(own, list) else [own] if own else []:
            if isinstance(c, str):
                raise ValueError("remote contexts are not loaded")
            ctx = ctx | c
        s = subject(x["@id"], ctx) if "@id" in x else Term(BLANK, f"j{next(count)}")
        for k, v in x.items():
            rule = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if k in ("@context", "@id"):
                continue
            if k == "@graph":
                for item in v if isinstance(v, list) else [v]:
                    node(item, ctx, s.lex if "@id" in x else graph, out)
                continue
            name = RDF + "type" if k == "@type" else expand(k, ctx)
            if ":" not in name:
                continue
            values = [{"@list": v}] if rule.get("@container") == "@list" and not isinstance(v, dict) else v if isinstance(v, list) else [v]
            for item in values:
                o = iri(expand(item, ctx)) if k == "@type" else value(item, ctx, rule, graph, out)
                if o is not None:
                    out.append((graph, s, name, o))
        return s

    data, out = json.loads(text), []
    for x in data if isinstance(data, list) else [data]:
        node(x, {}, None, out)
    yield from out


PARSERS = {"turtle": lambda t, b: Turtle(t, b).document(), "trig": lambda t, b: Turtle(t, b).document(), "xml": rdf_xml, "json-ld": json_ld}
EXTENSIONS = {"ttl": "turtle", "trig": "trig", "rdf": "xml", "xml": "xml", "owl": "xml", "jsonld": "json-ld", "nt": "lines", "nq": "lines"}


def row(t: Term) -> dict:
    return {"k": t.kind, "v": t.lex, "dt": t.dt, "lang": t.lang}


def parse(text: str, kind: str = "turtle", base: str = "") -> list[tuple[str | None, Term, str, Term]]:
    return list(PARSERS[kind](text, base))


def from_text(spark: SparkSession, text: str, kind: str = "turtle", base: str = "", graph: str | None = None) -> QuadTable:
    """A small document in memory as a quad table."""
    quads = list(dict.fromkeys((g or graph, s, p, o) for g, s, p, o in parse(text, kind, base)))
    return QuadTable(spark.createDataFrame([(g, (s.kind, s.lex, s.dt, s.lang), p, (o.kind, o.lex, o.dt, o.lang)) for g, s, p, o in quads], QUADS))


_ARROW_TERM = pa.struct([("k", pa.int8()), ("v", pa.string()), ("dt", pa.string()), ("lang", pa.string())])


def read_files(spark: SparkSession, path: str, kind: str | None = None, graph: str | None = None, base: str = "") -> QuadTable:
    """RDF files by their extension or the named kind; blank labels stand for one node within a file only."""
    kind = kind or EXTENSIONS[path.rstrip("/").rsplit(".", 1)[-1].lower()]
    if kind == "lines":
        return read_lines(spark, path, graph)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                quads = parse(text, kind, base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g or graph for g, *_ in quads], pa.string()), pa.array([row(q[1]) for q in quads], _ARROW_TERM), pa.array([q[2] for q in quads], pa.string()), pa.array([row(q[3]) for q in quads], _ARROW_TERM), pa.array([name] * len(quads), pa.string())],
                    names=["g", "s", "p", "o", "name"],
                )

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    quads = files.mapInArrow(run, f"{QUADS}, name string")
    apart = lambda c: F.when(c["k"] == BLANK, struct(BLANK, F.concat(c["v"], F.lit("f"), F.substring(F.md5("name"), 1, 8)))).otherwise(c)
    return QuadTable(quads.select("g", apart(F.col("s")).alias("s"), "p", apart(F.col("o")).alias("o")).distinct())


def lines(quads: DataFrame) -> DataFrame:
    """[value]: N-Quads lines of [g, s, p, o], N-Triples where g is null or absent."""
    term = lambda c: canonical(Value(F.col(c), TERM))
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("") if "g" in quads.columns else F.lit("")
    return quads.select(F.concat(term("s"), F.lit(" <"), F.col("p"), F.lit("> "), term("o"), g, F.lit(" .")).alias("value"))


def write_lines(quads: DataFrame, path: str) -> None:
    lines(quads).write.text(path)

