"""ShEx validation: a schema in JSON-like dictionaries, compiled to counts by (focus, predicate) and set algebra.

A shape is {"expression": [constraints], "closed": bool, "extra": [predicates]} or a combination {"and": [...]},
{"or": [...]}, {"not": shape}, {"ref": name}, {"any": True}, or a node test (kind, datatype, facets, values). A
constraint is {"predicate", "value" (a shape), "min", "max", "inverse"}; {"oneOf": [[...], [...]]} takes the first
alternative that holds. A value that does not fit is not counted and matters under closed only; a shape that
refers to itself is taken as its greatest fix-point. Patterns are regular expressions, lengths are in characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import scalar as fn
from quadrille.operators.storage import written
from quadrille.sources.dataset import QuadTable
from quadrille.terms import BLANK, IRI, LITERAL, TERM, TERM_TYPE, Value, constant, literal, parse_native

NODE_TESTS = {"kind", "datatype", "pattern", "minLength", "maxLength", "length", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "values"}


def refs(schema: dict[str, dict], x: object, seen: set[str] | None = None) -> set[str]:
    """Names of the shapes that a shape leads to."""
    seen = set() if seen is None else seen
    if isinstance(x, dict):
        if "ref" in x and x["ref"] not in seen:
            seen.add(x["ref"])
            refs(schema, schema[x["ref"]], seen)
        for v in x.values():
            refs(schema, v, seen)
    elif isinstance(x, list):
        for v in x:
            refs(schema, v, seen)
    return seen


class ShEx:
    def __init__(self, data: QuadTable, schema: dict[str, dict]) -> None:
        self.triples = data.quads.where("g is null").select("s", "p", "o")
        self.schema = schema
        self.assumed: dict[str, DataFrame] = {}

    def fitting(self, nodes: DataFrame, shape: dict) -> DataFrame:
        """Of [node], those that fit a shape."""
        if "ref" in shape:
            name = shape["ref"]
            if name in self.assumed:
                return nodes.join(self.assumed[name], "node", "left_semi")
            return self.recursive(nodes, name) if name in refs(self.schema, self.schema[name]) else self.fitting(nodes, self.schema[name])
        if "and" in shape:
            return reduce(self.fitting, shape["and"], nodes)
        if "or" in shape:
            return reduce(DataFrame.unionByName, [self.fitting(nodes, s) for s in shape["or"]]).distinct()
        if "not" in shape:
            return nodes.join(self.fitting(nodes, shape["not"]), "node", "left_anti")
        if tests := NODE_TESTS & set(shape):
            nodes = nodes.where(F.coalesce(reduce(lambda a, b: a & b, [self.test(k, shape[k]) for k in sorted(tests)]), F.lit(False)))
        if "expression" in shape:
            nodes = self.expression(nodes, shape["expression"])
        if shape.get("closed"):
            nodes = self.closed(nodes, shape)
        return nodes

    def recursive(self, nodes: DataFrame, name: str) -> DataFrame:
        """The greatest fix-point: all nodes are taken to fit, and those that do not are taken away until none is."""
        t = self.triples
        fit = written(nodes.unionByName(t.select(F.col("s").alias("node"))).unionByName(t.select(F.col("o").alias("node"))).distinct(), "shex")
        before = -1
        while (now := fit.count()) != before:
            before, self.assumed[name] = now, fit
            fit = written(self.fitting(fit, self.schema[name]), "shex")
        del self.assumed[name]
        return nodes.join(fit, "node", "left_semi")

    @staticmethod
    def test(kind: str, x: object) -> F.Column:
        n = F.col("node")
        if kind == "kind":
            return n["k"].isin(*{"iri": [IRI], "bnode": [BLANK], "literal": [LITERAL], "nonliteral": [IRI, BLANK]}[str(x).lower()])
        if kind == "datatype":
            return (n["dt"] == x) & parse_native(n["v"], str(x)).isNotNull()
        if kind == "pattern":
            return n["v"].rlike(x)
        if kind == "values":
            return reduce(lambda a, b: a | b, [(n["v"] == v) for v in x], F.lit(False))  # type: ignore[attr-defined]
        if kind in ("minLength", "maxLength", "length"):
            size = F.char_length(n["v"])
            return {"minLength": size >= x, "maxLength": size <= x, "length": size == x}[kind]
        op = {"minInclusive": ">=", "maxInclusive": "<=", "minExclusive": ">", "maxExclusive": "<"}[kind]
        return fn.compare(op, Value(n, TERM), constant(literal(x))).col

    def values(self, nodes: DataFrame, c: dict) -> DataFrame:
        """[focus, node] of a constraint's triples whose value fits."""
        a, b = ("o", "s") if c.get("inverse") else ("s", "o")
        t = self.triples.where(F.col("p") == c["predicate"]).select(F.col(a).alias("focus"), F.col(b).alias("node"))
        t = t.join(nodes.select(F.col("node").alias("focus")), "focus", "left_semi").distinct()
        return t.join(self.fitting(t.select("node").distinct(), c["value"]), "node", "left_semi") if "value" in c else t

    def expression(self, nodes: DataFrame, constraints: list) -> DataFrame:
        for c in constraints:
            if "oneOf" in c:
                nodes = reduce(DataFrame.unionByName, [self.expression(nodes, alt) for alt in c["oneOf"]]).distinct()
                continue
            n = self.values(nodes, c).groupBy(F.col("focus").alias("node")).agg(F.count("*").alias("n"))
            least, most = c.get("min", 1), c.get("max", 1)
            count = F.coalesce("n", F.lit(0))
            keep = (count >= least) & (count <= most if most is not None else F.lit(True))
            nodes = nodes.join(n, "node", "left").where(keep).select("node")
        return nodes

    def closed(self, nodes: DataFrame, shape: dict) -> DataFrame:
        flat = [c for x in shape.get("expression", []) for c in (sum(x["oneOf"], []) if "oneOf" in x else [x])]
        extra, parts = shape.get("extra", []), []
        out = self.triples.join(nodes.withColumnRenamed("node", "s"), "s", "left_semi").where(~F.col("p").isin(*extra) if extra else F.lit(True))
        for c in flat:
            if not c.get("inverse"):
                parts.append(self.values(nodes, c).select(F.col("focus").alias("s"), F.lit(c["predicate"]).alias("p"), F.col("node").alias("o")))
        if parts:
            out = out.join(reduce(DataFrame.unionByName, parts), ["s", "p", "o"], "left_anti")
        return nodes.join(out.select(F.col("s").alias("node")), "node", "left_anti")


def validate(data: QuadTable, schema: dict[str, dict], shape: str, focus: list[str] | None = None) -> DataFrame:
    """[node, conforms] for the named focus nodes, else for all subjects of the shape's predicates."""
    engine = ShEx(data, schema)
    if focus is not None:
        nodes = data.spark.createDataFrame([((IRI, x, "", ""),) for x in focus], f"node {TERM_TYPE}")
    else:
        names = [c["predicate"] for c in schema[shape].get("expression", []) if "predicate" in c]
        nodes = engine.triples.where(F.col("p").isin(*names)).select(F.col("s").alias("node")).distinct()
    good = engine.fitting(nodes, {"ref": shape}).withColumn("fits", F.lit(True))
    return nodes.join(good, "node", "left").select("node", F.coalesce("fits", F.lit(False)).alias("conforms"))
