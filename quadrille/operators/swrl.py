"""SWRL rules in text or XML, run to a fix-point as SPARQL patterns.

Text: `Person(?x) ^ hasAge(?x, ?a) ^ swrlb:greaterThan(?a, 17) -> Adult(?x)`. Arithmetic built-ins are tests
of their first argument against the others' result; stringConcat is a test of equality.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.storage import written
from quadrille.plans.compiler import query
from quadrille.sources.dataset import QuadTable
from quadrille.terms import OWL

SWRL, SWRLB, RULEML = "http://www.w3.org/2003/11/swrl#", "http://www.w3.org/2003/11/swrlb#", "http://www.w3.org/2003/11/ruleml"
COMPARE = {"equal": "=", "notEqual": "!=", "lessThan": "<", "lessThanOrEqual": "<=", "greaterThan": ">", "greaterThanOrEqual": ">="}
ARITHMETIC = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
ATOM = re.compile(r"([\w:<>/#.\-]+)\s*\(([^()]*)\)")


@dataclass(frozen=True)
class Atom:
    name: str  # an IRI
    args: tuple[str, ...]  # SPARQL terms


@dataclass(frozen=True)
class SwrlRule:
    body: tuple[Atom, ...]
    head: tuple[Atom, ...]


def parse_text(text: str, prefixes: dict[str, str]) -> list[SwrlRule]:
    """One rule a line."""
    known = {"swrlb": SWRLB, "owl": OWL} | prefixes

    def iri(x: str) -> str:
        if x.startswith("<"):
            return x[1:-1]
        prefix, colon, local = x.partition(":")
        return known[prefix] + local if colon else known[""] + x

    def arg(x: str) -> str:
        x = x.strip()
        return x if x[0] in '?"' or re.fullmatch(r"[+-]?[\d.]+", x) or x in ("true", "false") else f"<{iri(x)}>"

    def atoms(s: str) -> tuple[Atom, ...]:
        return tuple(Atom("owl:sameAs" if n == "sameAs" else "owl:differentFrom" if n == "differentFrom" else iri(n), tuple(map(arg, re.findall(r'"[^"]*"(?:\^\^\S+)?|[^,]+', a)))) for n, a in ATOM.findall(s))

    return [SwrlRule(*map(atoms, line.split("->"))) for line in text.splitlines() if "->" in line]


def parse_xml(text: str) -> list[SwrlRule]:
    """The XML concrete syntax: class, property and built-in atoms."""
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    at = lambda e, k: next((v for n, v in e.attrib.items() if n.rsplit("}", 1)[-1] == k), "")

    def arg(e: ElementTree.Element) -> str:
        if name(e) == "var":
            return "?" + (e.text or "").strip()
        if name(e) == "DataValue":
            return f'"{(e.text or "").strip()}"^^<{at(e, "datatype")}>'
        return f"<{at(e, 'name')}>"

    def atom(e: ElementTree.Element) -> Atom:
        kind = name(e)
        if kind == "classAtom":
            return Atom(at(next(c for c in e if name(c) == "Class"), "name"), tuple(arg(c) for c in e if name(c) != "Class"))
        if kind == "builtinAtom":
            return Atom(SWRLB + at(e, "builtin").rsplit("#", 1)[-1], tuple(map(arg, e)))
        if kind in ("sameIndividualAtom", "differentIndividualsAtom"):
            return Atom("owl:sameAs" if kind.startswith("same") else "owl:differentFrom", tuple(map(arg, e)))
        return Atom(at(e, "property"), tuple(map(arg, e)))

    out = []
    for imp in ElementTree.fromstring(text).iter():
        if name(imp) == "Imp":
            parts = {name(c): tuple(atom(a) for a in c) for c in imp}
            out.append(SwrlRule(parts["_body"] if "_body" in parts else parts["body"], parts["_head"] if "_head" in parts else parts["head"]))
    return out


def sparql(a: Atom) -> str:
    if a.name.startswith(SWRLB):
        name, args = a.name.removeprefix(SWRLB), a.args
        if name in COMPARE:
            return f"FILTER({args[0]} {COMPARE[name]} {args[1]})"
        if name in ARITHMETIC:
            return f"FILTER({args[0]} = {f' {ARITHMETIC[name]} '.join(args[1:])})"
        if name == "stringConcat":
            return f"FILTER({args[0]} = CONCAT({', '.join(args[1:])}))"
        if name in ("contains", "matches"):
            return f"FILTER {'CONTAINS' if name == 'contains' else 'REGEX'}({args[0]}, {args[1]})"
        raise ValueError(f"built-in {name}")
    if len(a.args) == 1:
        return f"{a.args[0]} a <{a.name}> ."
    p = a.name if a.name.startswith("owl:") else f"<{a.name}>"
    return f"{a.args[0]} {p} {a.args[1]} ."


def construct(r: SwrlRule) -> str:
    patterns = sorted(map(sparql, r.body), key=lambda s: s.startswith("FILTER"))
    return f"CONSTRUCT {{ {' '.join(map(sparql, r.head))} }} WHERE {{ {' '.join(patterns)} }}"


def infer(data: QuadTable, rules: list[SwrlRule], rounds: int = 500) -> QuadTable:
    """Triples that the rules add to the default graph, to a fix-point; an error if the last round still adds some, as built-ins may make new values for ever."""
    given, now = data.quads.where("g is null").select("s", "p", "o"), data
    texts = [construct(r) for r in rules]
    for _ in range(rounds):
        made = reduce(DataFrame.unionByName, [query(now, t) for t in texts]).distinct()
        have = now.quads.where("g is null").select("s", "p", "o")
        new = written(made.join(have, ["s", "p", "o"], "left_anti"), "swrl")
        if new.isEmpty():
            break
        now = QuadTable(written(now.quads.unionByName(new.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")), "swrl"))
    else:
        raise RuntimeError(f"the rules still add triples after {rounds} rounds")
    return QuadTable(now.quads.where("g is null").join(given, ["s", "p", "o"], "left_anti").select("g", "s", "p", "o"))
