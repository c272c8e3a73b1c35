"""SHACL validation: each constraint of a shape is one set-based plan over all focus nodes.

Shapes are read on the driver from a small graph; data stays distributed. The report has one row for each
result. Shapes used inside others (and, or, not, xone, node, qualified) become sets of conforming nodes.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import scalar as fn
from quadrille.operators.paths import closure
from quadrille.operators.storage import written
from quadrille.plans.algebra import Alternative, Inverse, Repeat, Sequence
from quadrille.plans.compiler import Context, Rel, construct, edges, select
from quadrille.plans.parser import parse_query
from quadrille.sources.dataset import QuadTable
from quadrille.sources.rdf import parse
from quadrille.terms import BLANK, IRI, LANG_STRING, LITERAL, RDF, RDFS, SH, STRING, TERM, TERM_TYPE, XSD, Term, Value, as_term, constant, iri, parse_native

REPORT = f"focus {TERM_TYPE}, path string, value {TERM_TYPE}, component string, shape string, severity string, message string"
DEEPEST = 50


class Small:
    """A small graph on the driver."""

    def __init__(self, text: str, kind: str = "turtle") -> None:
        self.out: dict[Term, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
        self.back: dict[tuple[str, Term], list[Term]] = defaultdict(list)
        for _, s, p, o in parse(text, kind):
            self.out[s][p].append(o)
            self.back[p, o].append(s)

    def all(self, s: Term, p: str) -> list[Term]:
        return self.out[s][p] if s in self.out else []

    def one(self, s: Term, p: str) -> Term | None:
        return next(iter(self.all(s, p)), None)

    def items(self, head: Term) -> list[Term]:
        out = []
        while head != iri(RDF + "nil") and len(out) < 100_000:
            out += self.all(head, RDF + "first")
            head = self.one(head, RDF + "rest") or iri(RDF + "nil")
        return out

    def number(self, s: Term, p: str) -> int | None:
        x = self.one(s, p)
        return None if x is None else int(x.lex)

    def true(self, s: Term, p: str) -> bool:
        return any(x.lex in ("true", "1") for x in self.all(s, p))


@dataclass
class Shapes:
    graph: Small
    names: list[Term] = field(default_factory=list)

    @staticmethod
    def read(text: str) -> Shapes:
        g = Small(text)
        names = {s for s, ps in g.out.items() if any(t.lex in (SH + "NodeShape", SH + "PropertyShape") for t in ps.get(RDF + "type", [])) or any(p in ps for p in (SH + "targetClass", SH + "targetNode", SH + "targetSubjectsOf", SH + "targetObjectsOf", SH + "target"))}
        return Shapes(g, sorted(names, key=lambda t: (t.kind, t.lex)))

    def path(self, node: Term) -> object:
        g = self.graph
        if node.kind == IRI:
            return node
        for p, make in ((SH + "inversePath", lambda x: Inverse(x)), (SH + "zeroOrMorePath", lambda x: Repeat(x, True, True)), (SH + "oneOrMorePath", lambda x: Repeat(x, False, True)), (SH + "zeroOrOnePath", lambda x: Repeat(x, True, False))):
            if x := g.one(node, p):
                return make(self.path(x))
        if x := g.one(node, SH + "alternativePath"):
            return Alternative(tuple(map(self.path, g.items(x))))
        return Sequence(tuple(map(self.path, g.items(node))))


def path_text(p: object) -> str:
    if isinstance(p, Term):
        return p.lex
    if isinstance(p, Inverse):
        return "^" + path_text(p.path)
    if isinstance(p, Repeat):
        return f"({path_text(p.path)})" + ("*" if p.zero and p.many else "+" if p.many else "?")
    return (" / " if isinstance(p, Sequence) else " | ").join(map(path_text, p.parts))


def kind_of(c: Column, *kinds: int) -> Column:
    return c["k"].isin(*kinds)


class Validator:
    def __init__(self, data: QuadTable, shapes: Shapes, graph: str | None = None) -> None:
        self.ctx = Context(data, graph=graph)
        self.shapes, self.g, self.deep = shapes, shapes.graph, 0
        self.spark = data.spark
        self._types: DataFrame | None = None

    # --- nodes ---------------------------------------------------------------------------------

    @property
    def types(self) -> DataFrame:
        """[node, cls]: types up to superclasses."""
        if self._types is None:
            t = self.ctx.data.triples(self.ctx.scope, self.ctx.graph)
            direct = t.where(F.col("p") == RDF + "type").select(F.col("s").alias("node"), F.col("o").alias("cls"))
            sub = t.where(F.col("p") == RDFS + "subClassOf").select("s", "o")
            up = closure(sub).select(F.col("s").alias("cls"), F.col("o").alias("up"))
            self._types = written(direct.unionByName(direct.join(up, "cls").select("node", F.col("up").alias("cls"))).distinct(), "types")
        return self._types

    def of_class(self, cls: Term) -> DataFrame:
        return self.types.where(F.col("cls") == as_term(constant(cls))).select(F.col("node").alias("focus"))

    def terms(self, ts: list[Term], name: str = "focus") -> DataFrame:
        return self.spark.createDataFrame([((t.kind, t.lex, t.dt, t.lang),) for t in ts], f"{name} {TERM_TYPE}")

    def targets(self, s: Term) -> DataFrame:
        g, t = self.g, self.ctx.data.triples(self.ctx.scope, self.ctx.graph)
        parts = [self.of_class(c) for c in g.all(s, SH + "targetClass")]
        if any(x.lex == RDFS + "Class" for x in g.all(s, RDF + "type")):
            parts.append(self.of_class(s))
        if nodes := g.all(s, SH + "targetNode"):
            parts.append(self.terms(nodes))
        parts += [t.where(F.col("p") == p.lex).select(F.col("s").alias("focus")) for p in g.all(s, SH + "targetSubjectsOf")]
        parts += [t.where(F.col("p") == p.lex).select(F.col("o").alias("focus")) for p in g.all(s, SH + "targetObjectsOf")]
        for target in g.all(s, SH + "target"):
            if q := g.one(target, SH + "select"):
                rel = select(self.ctx, parse_query(q.lex, prefixes=self.prefixes(target)).select)
                parts.append(rel.df.select(as_term(rel.value("this")).alias("focus")))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.terms([])

    def prefixes(self, s: Term) -> dict[str, str]:
        out = {}
        for p in self.g.all(s, SH + "prefixes"):
            for d in self.g.all(p, SH + "declare"):
                a, b = self.g.one(d, SH + "prefix"), self.g.one(d, SH + "namespace")
                if a and b:
                    out[a.lex] = b.lex
        return out

    def pairs(self, path: object, focus: DataFrame) -> DataFrame:
        """Distinct [focus, value] along a path."""
        p = edges(self.ctx, path).generic()
        return focus.join(p.df.select(F.col("s").alias("focus"), F.col("o").alias("value")), "focus").distinct()

    # --- validation ----------------------------------------------------------------------------

    def report(self) -> DataFrame:
        """All results; no row means that the data conforms."""
        parts = [self.violations(s, self.targets(s)) for s in self.shapes.names if not self.g.true(s, SH + "deactivated")]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], REPORT)

    def conforms(self, shape: Term, nodes: DataFrame) -> DataFrame:
        """Of [focus], those that conform to a shape."""
        if self.deep > DEEPEST:
            raise RecursionError("shapes are nested too deeply")
        self.deep += 1
        bad = self.violations(shape, nodes).select("focus")
        self.deep -= 1
        return nodes.join(bad, "focus", "left_anti")

    def violations(self, s: Term, focus: DataFrame) -> DataFrame:
        g = self.g
        if g.true(s, SH + "deactivated"):
            return self.spark.createDataFrame([], REPORT)
        focus = focus.select("focus").distinct()
        p = g.one(s, SH + "path")
        path = self.shapes.path(p) if p else None
        values = self.pairs(path, focus) if path is not None else focus.select("focus", F.col("focus").alias("value"))
        severity, message = g.one(s, SH + "severity"), g.one(s, SH + "message")
        out: list[DataFrame] = []

        def add(component: str, rows: DataFrame, value: bool = True) -> None:
            v = F.col("value") if value else F.lit(None).cast(TERM_TYPE)
            cols = [F.col("focus"), F.lit(path_text(path) if path is not None else None).cast("string").alias("path"), v.alias("value"), F.lit(component + "ConstraintComponent").alias("component"), F.lit(s.lex).alias("shape")]
            out.append(rows.select(*cols, F.lit(severity.lex.removeprefix(SH) if severity else "Violation").alias("severity"), F.lit(message.lex if message else "").alias("message")))

        v = F.col("value")
        own = Value(v, TERM)
        fails = lambda c: values.where(~F.coalesce(c, F.lit(False)))
        count = focus.join(values.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        for c in g.all(s, SH + "class"):
            good = self.of_class(c).select(F.col("focus").alias("value"))
            add("Class", values.join(good, "value", "left_anti"))
        for d in g.all(s, SH + "datatype"):
            form = parse_native(v["v"], d.lex).isNotNull()
            if d.lex == XSD + "dateTime":
                form = F.regexp_replace(v["v"], fn.ZONE, "").try_cast("timestamp_ntz").isNotNull() & v["v"].contains("T")
            add("Datatype", fails((v["k"] == LITERAL) & (v["dt"] == d.lex) & form))
        for k in g.all(s, SH + "nodeKind"):
            name = k.lex.removeprefix(SH)
            kinds = [n for n, w in ((IRI, "IRI"), (BLANK, "BlankNode"), (LITERAL, "Literal")) if w in name]
            add("NodeKind", fails(kind_of(v, *kinds)))
        if (n := g.number(s, SH + "minCount")) is not None:
            add("MinCount", count.where(F.col("n") < n), False)
        if (n := g.number(s, SH + "maxCount")) is not None:
            add("MaxCount", count.where(F.col("n") > n), False)
        text = F.when(v["k"] != BLANK, v["v"])
        if (n := g.number(s, SH + "minLength")) is not None:
            add("MinLength", fails(F.char_length(text) >= n))
        if (n := g.number(s, SH + "maxLength")) is not None:
            add("MaxLength", fails(F.char_length(text) <= n))
        for x in g.all(s, SH + "pattern"):
            flags = g.one(s, SH + "flags")
            add("Pattern", fails(text.rlike((f"(?{flags.lex})" if flags else "") + x.lex)))
        if x := g.one(s, SH + "languageIn"):
            tags = [t.lex for t in g.items(x)]
            add("LanguageIn", fails(reduce(lambda a, b: a | b, [fn.lang_matches(fn.lang(own), constant(Term(LITERAL, t, STRING))).col for t in tags], F.lit(False))))
        if g.true(s, SH + "uniqueLang"):
            twice = values.where(v["dt"] == LANG_STRING).groupBy("focus", F.col("value.lang").alias("tag")).count().where("count > 1")
            add("UniqueLang", twice, False)
        for x in g.all(s, SH + "hasValue"):
            there = values.where(v == as_term(constant(x))).select("focus")
            add("HasValue", focus.join(there, "focus", "left_anti"), False)
        if x := g.one(s, SH + "in"):
            add("In", values.join(self.terms(g.items(x), "value"), "value", "left_anti"))
        for op, name in (("minInclusive", ">="), ("maxInclusive", "<="), ("minExclusive", ">"), ("maxExclusive", "<")):
            for x in g.all(s, SH + op):
                add(op[0].upper() + op[1:], fails(fn.compare(name, own, constant(x)).col))
        if g.true(s, SH + "closed"):
            allowed = [t.lex for q in g.all(s, SH + "property") if (t := g.one(q, SH + "path")) and t.kind == IRI]
            if x := g.one(s, SH + "ignoredProperties"):
                allowed += [t.lex for t in g.items(x)]
            t = self.ctx.data.triples(self.ctx.scope, self.ctx.graph).where(~F.col("p").isin(*allowed) if allowed else F.lit(True))
            extra = values.select("focus", F.col("value").alias("s")).join(t, "s").select("focus", F.col("o").alias("value"))
            add("Closed", extra)
        for name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            for x in g.all(s, SH + name):
                other = self.pairs(x, focus)
                component = name[0].upper() + name[1:]
                if name == "equals":
                    add(component, values.join(other, ["focus", "value"], "left_anti").unionByName(other.join(values, ["focus", "value"], "left_anti")))
                elif name == "disjoint":
                    add(component, values.join(other, ["focus", "value"], "left_semi"))
                else:
                    both = values.join(other.withColumnRenamed("value", "other"), "focus")
                    ok = fn.compare("<" if name == "lessThan" else "<=", own, Value(F.col("other"), TERM)).col
                    add(component, both.where(~F.coalesce(ok, F.lit(False))))
        nodes = values.select(F.col("value").alias("focus")).distinct()
        good = lambda shape: self.conforms(shape, nodes).select(F.col("focus").alias("value"))
        for x in g.all(s, SH + "node"):
            add("Node", values.join(good(x), "value", "left_anti"))
        for x in g.all(s, SH + "not"):
            add("Not", values.join(good(x), "value", "left_semi"))
        for x in g.all(s, SH + "and"):
            every = reduce(lambda a, b: a.join(b, "value", "left_semi"), [good(i) for i in g.items(x)])
            add("And", values.join(every, "value", "left_anti"))
        for x in g.all(s, SH + "or"):
            any_ = reduce(DataFrame.unionByName, [good(i) for i in g.items(x)])
            add("Or", values.join(any_, "value", "left_anti"))
        for x in g.all(s, SH + "xone"):
            once = reduce(DataFrame.unionByName, [good(i) for i in g.items(x)]).groupBy("value").count().where("count = 1")
            add("Xone", values.join(once, "value", "left_anti"))
        for q in g.all(s, SH + "qualifiedValueShape"):
            fit = good(q)
            if g.true(s, SH + "qualifiedValueShapesDisjoint"):
                for parent in g.back[SH + "property", s]:
                    for sibling in g.all(parent, SH + "property"):
                        for other in g.all(sibling, SH + "qualifiedValueShape"):
                            if other != q:
                                fit = fit.join(good(other), "value", "left_anti")
            n = focus.join(values.join(fit, "value", "left_semi").groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            if (least := g.number(s, SH + "qualifiedMinCount")) is not None:
                add("QualifiedMinCount", n.where(F.col("n") < least), False)
            if (most := g.number(s, SH + "qualifiedMaxCount")) is not None:
                add("QualifiedMaxCount", n.where(F.col("n") > most), False)
        for x in g.all(s, SH + "sparql"):
            if q := g.one(x, SH + "select"):
                text_ = q.lex.replace("$PATH", f"<{p.lex}>" if p and p.kind == IRI else "$PATH").replace("$this", "?this")
                query = parse_query(text_, prefixes=self.prefixes(x))
                this = Rel(focus.where(F.col("focus.k") != BLANK).select(F.col("focus").alias("this__focus")), {})
                rel = self.with_this(query.select, this)
                add("SPARQL", rel.df.select(as_term(rel.value("this")).alias("focus"), (as_term(rel.value("value")) if "value" in rel.vars else as_term(rel.value("this"))).alias("value")))
        for x in g.all(s, SH + "property"):
            out.append(self.violations(x, nodes))  # its focus nodes are this shape's values
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], REPORT)

    def with_this(self, s: object, this: Rel) -> Rel:
        """A query's solutions with ?this among the focus nodes."""
        rel = select(self.ctx, s)  # type: ignore[arg-type]
        if "this" not in rel.vars:
            return rel
        keep = rel.df.withColumn("this__term", as_term(rel.value("this")))
        return Rel(keep.join(this.df, F.col("this__term") == F.col("this__focus"), "left_semi"), rel.vars)

    # --- rules ---------------------------------------------------------------------------------

    def infer(self, rounds: int = 100) -> QuadTable:
        """Triples that the shapes' rules (sh:TripleRule, sh:SPARQLRule) add, to a fix-point; an error if the last round still adds some."""
        g = self.g
        data, own = self.ctx.data, self
        given = data.quads
        for _ in range(rounds):
            made = []
            for s in self.shapes.names:
                for r in g.all(s, SH + "rule"):
                    if g.true(r, SH + "deactivated"):
                        continue
                    focus = own.targets(s)
                    for c in g.all(r, SH + "condition"):
                        focus = own.conforms(c, focus)
                    if q := g.one(r, SH + "construct"):
                        query = parse_query(q.lex.replace("$this", "?this"), prefixes=own.prefixes(r))
                        rel = own.with_this(query.select, Rel(focus.select(F.col("focus").alias("this__focus")), {}))
                        made.append(construct(own.ctx, rel, query.template))
                    elif pr := g.one(r, SH + "predicate"):
                        rows = own.expression(focus, g.one(r, SH + "subject"), "s")
                        rows = own.expression(rows, g.one(r, SH + "object"), "o")
                        made.append(rows.select("s", F.lit(pr.lex).alias("p"), "o"))
            if not made:
                break
            all_ = reduce(DataFrame.unionByName, made).distinct().select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
            new = written(all_.join(data.quads.where("g is null").select("s", "p", "o"), ["s", "p", "o"], "left_anti"), "rules")
            if new.isEmpty():
                break
            data = QuadTable(written(data.quads.unionByName(new.select("g", "s", "p", "o")), "rules"))
            own = Validator(data, self.shapes, self.ctx.graph)
        else:
            raise RuntimeError(f"the rules still add triples after {rounds} rounds")
        a = data.quads.where("g is null")
        return QuadTable(a.join(given.where("g is null").select("s", "p", "o"), ["s", "p", "o"], "left_anti").select("g", "s", "p", "o"))

    def expression(self, rows: DataFrame, node: Term | None, name: str) -> DataFrame:
        """sh:this, a constant, or a path's values."""
        if node is None or node == iri(SH + "this"):
            return rows.withColumn(name, F.col("focus"))
        if x := self.g.one(node, SH + "path"):
            p = edges(self.ctx, self.shapes.path(x)).generic().df
            return rows.join(p.select(F.col("s").alias("focus"), F.col("o").alias(name)), "focus")
        return rows.withColumn(name, as_term(constant(node)))


def validate(data: QuadTable, shapes: str, graph: str | None = None) -> DataFrame:
    """[focus, path, value, component, shape, severity, message] of every result."""
    return Validator(data, Shapes.read(shapes), graph).report()


def infer(data: QuadTable, shapes: str) -> QuadTable:
    return Validator(data, Shapes.read(shapes)).infer()

