"""Result formats: solutions as JSON, XML, CSV and TSV; quads as Turtle, TriG, RDF/XML and JSON-LD.

Each solution or quad is one line, made by native expressions. write() frames every partition as a whole
document of its own, so large results are written in parallel and each part file can be read alone; text()
gives one document in memory, for a client's reply, and refuses results of more than `most` rows.

Defined results: unbound variables are left out of JSON and XML and are empty in CSV and TSV; a result
without rows is a document without rows; quoted triples stand as their canonical text, and are refused in
RDF/XML and JSON-LD, which have no form for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scalar import canonical
from quadrille.plans.compiler import context, select
from quadrille.plans.parser import parse_query
from quadrille.sources.dataset import MappedTables, QuadTable
from quadrille.terms import BLANK, IRI, LANG_STRING, LITERAL, RDF, STRING, TERM, TRIPLE, Value, as_term

MOST_ROWS = 1_000_000
NC_NAME = r"[\p{L}_][\p{L}\p{N}_.\-]*$"


@dataclass(frozen=True)
class Document:
    """Lines, and what stands around and between them."""

    lines: DataFrame
    head: str
    tail: str = ""
    comma: str = ""
    newline: str = "\n"

    def framed(self, rows: Iterator[str]) -> Iterator[str]:
        if self.head:
            yield self.head
        before = ""
        for row in rows:
            yield before + row
            before = self.comma
        if self.tail:
            yield self.tail

    def text(self, most: int = MOST_ROWS) -> str:
        rows = [r["value"] for r in self.lines.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"a reply of more than {most} rows; write it to files")
        return self.newline.join(self.framed(iter(rows))) + self.newline

    def write(self, path: str) -> None:
        frame = Document(None, self.head, self.tail, self.comma)  # without the DataFrame, for the tasks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some: list[str] = []
            for line in frame.framed(x for batch in batches for x in batch.column("value").to_pylist()):
                some.append(line)
                if len(some) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])

        self.lines.mapInArrow(run, "value string").write.text(path, lineSep=self.newline)


def solutions(data: QuadTable | MappedTables, text: str, prefixes: dict[str, str] | None = None, base: str = "", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The solutions of a SELECT query, every variable as a term struct."""
    q = parse_query(text, base, prefixes)
    if q.form != "SELECT":
        raise ValueError("only SELECT has solutions")
    rel = select(context(data, q.default, q.named, allowed), q.select)
    return rel.df.select(*[as_term(rel.value(n)).alias(n) for n in rel.vars])


def escaped_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def quoted_json(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def datatype(c: Column) -> Column:
    """The datatype where it has to be named, else null."""
    return F.when((c["k"] == LITERAL) & ~c["dt"].isin(STRING, LANG_STRING), c["dt"])


def language(c: Column) -> Column:
    return F.when(c["lang"] != "", c["lang"])


def json_binding(c: Column) -> Column:
    kind = F.when(c["k"] == IRI, "uri").when(c["k"] == BLANK, "bnode").when(c["k"] == TRIPLE, "triple").otherwise("literal")
    return F.when(c.isNotNull(), F.struct(kind.alias("type"), c["v"].alias("value"), datatype(c).alias("datatype"), language(c).alias("xml:lang")))


def xml_binding(name: str, c: Column) -> Column:
    tag = F.when(c["k"] == IRI, "uri").when(c["k"] == BLANK, "bnode").when(c["k"] == TRIPLE, "triple").otherwise("literal")
    own = F.when(language(c).isNotNull(), F.format_string(' xml:lang="%s"', c["lang"])).when(datatype(c).isNotNull(), F.format_string(' datatype="%s"', escaped_xml(c["dt"]))).otherwise("")
    return F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{name}"><'), tag, own, F.lit(">"), escaped_xml(c["v"]), F.lit("</"), tag, F.lit("></binding>"))).otherwise("")


def csv_field(c: Column) -> Column:
    v = F.when(c["k"] == BLANK, F.concat(F.lit("_:"), c["v"])).otherwise(c["v"])
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(v.rlike('[,"\\r\\n]'), quoted).otherwise(v), F.lit(""))


def tsv_field(c: Column) -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.replace(canonical(Value(c, TERM)), F.lit("\t"), F.lit("\\t"))), F.lit(""))


def results(terms: DataFrame, kind: str) -> Document:
    """The document of solutions (columns of term structs) in 'json', 'xml', 'csv' or 'tsv'."""
    names = terms.columns
    c = [F.col(f"`{n}`") for n in names]
    line = lambda x: terms.select(x.alias("value"))
    if kind == "json":
        row = F.to_json(F.struct(*[json_binding(x).alias(n) for n, x in zip(names, c, strict=True)]), {"ignoreNullFields": "true"})
        listed = ",".join(f'"{n}"' for n in names)
        return Document(line(row if names else F.lit("{}")), f'{{"head":{{"vars":[{listed}]}},"results":{{"bindings":[', "]}}", ",")
    if kind == "xml":
        row = F.concat(F.lit("<result>"), *[xml_binding(n, x) for n, x in zip(names, c, strict=True)], F.lit("</result>"))
        listed = "".join(f'<variable name="{n}"/>' for n in names)
        return Document(line(row), f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{listed}</head><results>', "</results></sparql>")
    if kind == "csv":
        return Document(line(F.concat_ws(",", *map(csv_field, c))), ",".join(names), newline="\r\n")
    if kind == "tsv":
        return Document(line(F.concat_ws("\t", *map(tsv_field, c))), "\t".join("?" + n for n in names))
    raise ValueError(f"no such format: {kind}")


def boolean(answer: bool, kind: str) -> str:
    """The document of an ASK query's answer."""
    word = str(answer).lower()
    if kind == "json":
        return f'{{"head":{{}},"boolean":{word}}}\n'
    if kind == "xml":
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>\n'
    return word + "\n"


def unquoted(c: Column) -> Column:
    return F.when(c["k"] == TRIPLE, F.raise_error(F.lit("the format has no quoted triples"))).otherwise(c["v"])


def rdf_xml_line(s: Column, p: Column, o: Column) -> Column:
    local = F.regexp_extract(p, NC_NAME, 0)
    local = F.when(local == "", F.raise_error(F.concat(F.lit("no element name in "), p))).otherwise(local)
    space = F.substring(p, F.lit(1), F.length(p) - F.length(local))
    about = F.concat(F.when(s["k"] == BLANK, "rdf:nodeID").otherwise("rdf:about"), F.lit('="'), escaped_xml(unquoted(s)), F.lit('"'))
    start = F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), escaped_xml(space), F.lit('"'))
    to = F.concat(F.when(o["k"] == IRI, ' rdf:resource="').otherwise(' rdf:nodeID="'), escaped_xml(unquoted(o)), F.lit('"/>'))
    own = F.when(language(o).isNotNull(), F.concat(F.lit(' xml:lang="'), o["lang"], F.lit('"'))).when(datatype(o).isNotNull(), F.concat(F.lit(' rdf:datatype="'), escaped_xml(o["dt"]), F.lit('"'))).otherwise("")
    body = F.concat(own, F.lit(">"), escaped_xml(o["v"]), F.lit("</n:"), local, F.lit(">"))
    return F.concat(F.lit("<rdf:Description "), about, F.lit(">"), start, F.when(o["k"] == LITERAL, body).otherwise(to), F.lit("</rdf:Description>"))


def json_ld_line(g: Column, s: Column, p: Column, o: Column) -> Column:
    name = lambda c: F.when(c["k"] == BLANK, F.concat(F.lit("_:"), c["v"])).otherwise(unquoted(c))
    value = F.struct(F.when(o["k"] != LITERAL, name(o)).alias("@id"), F.when(o["k"] == LITERAL, o["v"]).alias("@value"), datatype(o).alias("@type"), language(o).alias("@language"))
    node = F.concat(F.lit('{"@id":'), quoted_json(name(s)), F.lit(","), F.substring(F.to_json(F.create_map(p, F.array(value)), {"ignoreNullFields": "true"}), 2, 2**31 - 1))
    return F.when(g.isNull(), node).otherwise(F.concat(F.lit('{"@id":'), quoted_json(g), F.lit(',"@graph":['), node, F.lit("]}")))


def short(term: Column, prefixes: dict[str, str]) -> Column:
    """A term's text with its IRI abbreviated, the longest fitting namespace first."""
    out = term
    for name, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        local = F.substring(term, F.lit(len(space) + 2), F.length(term) - len(space) - 2)
        out = F.when(term.startswith("<" + space) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*$"), F.concat(F.lit(name + ":"), local)).otherwise(out)
    return out


def rdf(quads: DataFrame, kind: str, prefixes: dict[str, str] | None = None) -> Document:
    """The document of [g, s, p, o] (g may be missing) in 'turtle', 'trig', 'xml' or 'json-ld'; Turtle and RDF/XML take triples of the default graph only."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    g = F.col("g") if "g" in quads.columns else F.lit(None).cast("string")
    if kind in ("turtle", "xml"):
        quads = quads.where(g.isNull())
    line = lambda x: quads.select(x.alias("value"))
    if kind in ("turtle", "trig"):
        known = prefixes or {}
        term = lambda c: short(canonical(Value(c, TERM)), known)
        triple = F.concat(term(s), F.lit(" "), short(F.concat(F.lit("<"), p, F.lit(">")), known), F.lit(" "), term(o), F.lit(" ."))
        named = F.concat(F.lit("<"), g, F.lit("> { "), triple, F.lit(" }"))
        head = "\n".join(f"@prefix {n}: <{x}> ." for n, x in known.items())
        return Document(line(triple if kind == "turtle" else F.coalesce(named, triple)), head)
    if kind == "xml":
        return Document(line(rdf_xml_line(s, p, o)), f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>")
    if kind == "json-ld":
        return Document(line(json_ld_line(g, s, p, o)), "[", "]", ",")
    raise ValueError(f"no such format: {kind}")
