"""Browsing triples by filter chips and a small boolean language; saved queries with typed parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.compiler import query
from quadrille.terms import XSD

FIELDS = {"s": "s.v", "p": "p", "o": "o.v", "g": "g"}


def chip(field: str, mode: str, text: str) -> Column:
    c = F.col(FIELDS[field])
    return {"exact": c == text, "contains": F.lower(c).contains(text.lower()), "regex": c.rlike(text)}[mode]


def chips(filters: list[tuple[str, str, str, bool]]) -> Column:
    """(field, mode, text, negated): the same field's chips are alternatives, fields must all hold, negated ones must not."""
    out, fields = F.lit(True), {}
    for field, mode, text, negated in filters:
        c = F.coalesce(chip(field, mode, text), F.lit(False))
        if negated:
            out = out & ~c
        else:
            fields.setdefault(field, []).append(c)
    for cs in fields.values():
        out = out & reduce(lambda a, b: a | b, cs)
    return out


def boolean_query(text: str) -> Column:
    """Words and "phrases" over all fields with AND, OR, XOR, NOT and parentheses; words side by side mean AND."""
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()]+', text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def word() -> Column:
        t = take()
        if t == "(":
            c = either()
            if peek() == ")":
                take()
            return c
        if t.upper() == "NOT":
            return ~word()
        w = t.strip('"').lower()
        return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(f)).contains(w), F.lit(False)) for f in ("s.v", "p", "o.v")]), F.lit(False))

    def both() -> Column:
        c = word()
        while peek() and peek() != ")" and peek().upper() not in ("OR", "XOR"):
            if peek().upper() == "AND":
                take()
            c = c & word()
        return c

    def either() -> Column:
        c = both()
        while peek().upper() in ("OR", "XOR"):
            op = take().upper()
            d = both()
            c = (c | d) if op == "OR" else (c != d)
        return c

    return either() if tokens else F.lit(True)


def browse(quads: DataFrame, filters: list[tuple[str, str, str, bool]] | None = None, q: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of quads, in the order of s, p and o."""
    return quads.where(chips(filters or []) & boolean_query(q)).orderBy("s", "p", "o").offset(offset).limit(limit)


# --- saved queries -----------------------------------------------------------------------------

#: Kind of a parameter: what its text must look like, and how it is written.
PARAMETERS = {
    "Iri": (r"[^<>\"{}|^`\\\s]+", lambda v: f"<{v}>"),
    "String": (r"(?s).*", lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'),
    "Integer": (r"[+-]?\d+", lambda v: v),
    "Decimal": (r"[+-]?\d*\.?\d+", lambda v: f'"{v}"^^<{XSD}decimal>'),
    "Boolean": (r"true|false", lambda v: v),
    "Date": (r"\d{4}-\d\d-\d\d", lambda v: f'"{v}"^^<{XSD}date>'),
    "DateTime": (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", lambda v: f'"{v}"^^<{XSD}dateTime>'),
}


def filled(text: str, kinds: dict[str, str], values: dict[str, str]) -> str:
    """A saved query's text with its {{name}} parameters written in; missing and ill-formed ones are refused."""

    def one(m: re.Match[str]) -> str:
        name = m[1]
        if name not in kinds or name not in values:
            raise ValueError(f"parameter {name} is missing")
        pattern, write = PARAMETERS[kinds[name]]
        if not re.fullmatch(pattern, values[name]):
            raise ValueError(f"parameter {name} is no {kinds[name]}")
        return write(values[name])

    return re.sub(r"\{\{(\w+)\}\}", one, text)


def regression(versions: dict[str, object], text: str, expected: dict[str, str]) -> dict[str, str]:
    """For each dataset version 'ok', 'changed' or 'error', by the fingerprint of a query's result."""
    from quadrille.operators.graphs import fingerprint

    out = {}
    for name, data in versions.items():
        try:
            got = fingerprint(query(data, text)).first()["fingerprint"]  # type: ignore[arg-type]
            out[name] = "ok" if got == expected.get(name, got) else "changed"
        except Exception:  # noqa: BLE001  any failure of a version is its result
            out[name] = "error"
    return out


def geojson(features: DataFrame, box: tuple[float, float, float, float] | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """[feature, number_matched] of features [id, wkt, x0, y0, x1, y1]: GeoJSON texts of a page of those whose box meets another."""
    from quadrille.operators.geo import column, parse_wkt

    hit = features if box is None else features.where((F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1]))

    def shape(w: str) -> str | None:
        import json

        g = parse_wkt(w)
        if g is None:
            return None
        if g.polygons:
            one = len(g.polygons) == 1
            return json.dumps({"type": "Polygon" if one else "MultiPolygon", "coordinates": g.polygons[0] if one else g.polygons})
        if g.lines:
            one = len(g.lines) == 1
            return json.dumps({"type": "LineString" if one else "MultiLineString", "coordinates": g.lines[0] if one else g.lines})
        one = len(g.points) == 1
        return json.dumps({"type": "Point" if one else "MultiPoint", "coordinates": g.points[0] if one else g.points})

    total = hit.agg(F.count("*").alias("number_matched"))
    page = hit.orderBy("id").offset(offset).limit(min(limit, 1000))
    text = F.concat(F.lit('{"type":"Feature","id":"'), F.col("id").cast("string"), F.lit('","geometry":'), F.coalesce(column(shape, F.col("wkt"), kind="string"), F.lit("null")), F.lit("}"))
    return page.select(text.alias("feature")).join(F.broadcast(total))
