"""Algebra to DataFrames.

A Rel is a DataFrame with a column for each variable, of known type where that is possible. Triples about
one subject that one mapped table answers fold into one scan of it (also under OPTIONAL, where the property is
just a nullable column). Joins on variables that are surely bound are equi-joins; a variable that may be
unbound adds its null-aware condition beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quadrille.functions.geosparql  # noqa: F401  registers its functions
from quadrille.functions import scalar as fn
from quadrille.operators.joins import even_join
from quadrille.operators.paths import closure
from quadrille.plans.algebra import (
    Alternative, Bgp, Call, Exists, Extend, Filter, Graph, Inverse, Join, LeftJoin, Minus, Negated, Query, Quoted, Repeat, Select, Sequence, Service, Triple, Union, Values, Var, variables,
)
from quadrille.plans.parser import AGGREGATES, parse_query
from quadrille.sources.dataset import RDF_TYPE, ClassMap, MappedTables, QuadTable, Scope, key_of
from quadrille.terms import BLANK, BOOL, DBL, DEC, INT, INTEGERS, IRI, IRI_T, LITERAL, STR, TERM, TERM_TYPE, XSD, Term, Type, Value, as_term, constant, lexical, native, struct, unbound

_names = count()


def fresh(hint: str = "c") -> str:
    return f"{hint.strip('.')}__{next(_names)}"


class Unsupported(ValueError):
    """The query asks for what this engine refuses (remote services, loading by IRI)."""


@dataclass(frozen=True)
class Binding:
    col: str
    type: Type
    maybe: bool = False  # may be unbound
    text: str | None = None  # a column that has the IRI of a key

    @property
    def value(self) -> Value:
        return Value(F.col(self.col), self.type)


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    vars: dict[str, Binding]
    #: Subject variables whose whole row is at hand: table map and the prefix of its columns.
    rows: dict[str, tuple[ClassMap, str]] = field(default_factory=dict)

    def value(self, name: str) -> Value:
        return self.vars[name].value if name in self.vars else unbound()


@dataclass(frozen=True)
class Context:
    data: QuadTable | MappedTables
    scope: Scope = Scope()
    graph: str | None = None
    graph_var: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.data.spark


def unit(ctx: Context) -> Rel:
    return Rel(ctx.spark.range(1).select(F.lit(1).alias(fresh("unit"))), {})


# --- matching values ---------------------------------------------------------------------------


def equal(a: Value, b: Value) -> Column:
    """Term identity; columns of one type are compared as they are."""
    if a.type == b.type:
        return a.col == b.col
    if a.type.kind == b.type.kind == "iri":
        return lexical(a) == lexical(b)
    if a.type.kind == b.type.kind == "lit" and a.type.dt != b.type.dt or {a.type.kind, b.type.kind} == {"iri", "lit"}:
        return F.lit(False)
    return as_term(a) == as_term(b)


def matches(v: Value, t: Term, kind: str) -> Column:
    """v is the constant t; kind: the column's SQL type."""
    if v.type.kind == "iri":
        if t.kind != IRI:
            return F.lit(False)
        if v.type.prefix is None:
            return v.col == t.lex
        key = key_of(v.type.prefix, t.lex, kind)
        return F.lit(False) if key is None else v.col == key
    if v.type.kind == "lit":
        c = constant(t)
        return v.col == c.col if c.type == v.type else as_term(v) == as_term(c) if t.kind == LITERAL and t.dt == v.type.dt else F.lit(False)
    return v.col == as_term(constant(t)) if t.kind != LITERAL or t.dt not in INTEGERS else v.col == struct(LITERAL, F.lit(t.lex), t.dt)


def place(rel: Rel, node: object, v: Value) -> Rel:
    """Holds a pattern's node against a value of the rows: filters by a constant or a variable met before, binds a new one."""
    if isinstance(node, Term):
        kind = rel.df.select(v.col.alias("x")).schema[0].dataType.simpleString()
        return replace(rel, df=rel.df.where(matches(v, node, kind)))
    if isinstance(node, Var):
        if node.name in rel.vars:
            return replace(rel, df=rel.df.where(equal(rel.value(node.name), v)))
        name = fresh(node.name)
        return Rel(rel.df.withColumn(name, v.col), rel.vars | {node.name: Binding(name, v.type)}, rel.rows)
    t = as_term(v)
    rel = replace(rel, df=rel.df.where(t["k"] == 4))
    for i, inner in enumerate((node.s, node.p, node.o), 1):  # type: ignore[attr-defined]
        rel = place(rel, inner, fn.part(Value(t, TERM), i))
    return rel


# --- triples -----------------------------------------------------------------------------------


def scan(ctx: Context, t: Triple) -> Rel:
    """One pattern over the quads."""
    predicate = t.p.lex if isinstance(t.p, Term) else None
    df = ctx.data.triples(ctx.scope, ctx.graph, ctx.graph_var is not None, predicate)
    names = {c: fresh(c) for c in df.columns}
    rel = Rel(df.select(*[F.col(c).alias(n) for c, n in names.items()]), {})
    if ctx.graph_var:
        rel = place(rel, Var(ctx.graph_var), Value(F.col(names["g"]), IRI_T))
    for node, c in ((t.s, "s"), (t.o, "o")):
        rel = place(rel, node, Value(F.col(names[c]), TERM))
    if predicate is None:
        rel = place(rel, t.p, Value(F.col(names["p"]), IRI_T))
    return narrowed(rel)


def narrowed(rel: Rel) -> Rel:
    """Only the columns that variables and kept rows need."""
    keep = list(dict.fromkeys(b.col for b in rel.vars.values()))
    if rel.rows or not keep:
        return rel
    return replace(rel, df=rel.df.select(*keep))


def possible(ctx: Context, stars: dict[object, list[Triple]]) -> dict[str, set[str]]:
    """For variables that are subjects and objects of mapped patterns: the prefixes that both sides can have."""
    out: dict[str, set[str]] = {}
    if not isinstance(ctx.data, MappedTables) or ctx.graph_var or ctx.scope.default is not None:
        return out
    for _ in range(len(stars)):
        for s, ts in stars.items():
            plain = [t for t in ts if isinstance(t.p, Term)]
            prefixes = {c.prefix for c in ctx.data.classes if c.graph == ctx.graph and (not isinstance(s, Var) or c.prefix in out.get(s.name, {c.prefix}))}
            prefixes = {x for x in prefixes if all(any(answers(c, t) for c in ctx.data.classes if c.prefix == x) for t in plain)}
            if isinstance(s, Var):
                out[s.name] = prefixes
            for t in plain:
                if isinstance(t.o, Var) and t.p.lex != RDF_TYPE:
                    kinds = [c.properties[t.p.lex].type for c in ctx.data.classes if c.prefix in prefixes and t.p.lex in c.properties]
                    if all(k.kind == "iri" and k.prefix for k in kinds):
                        own = {k.prefix for k in kinds}
                        out[t.o.name] = own & out.get(t.o.name, own)
    return out


def star(ctx: Context, subject: object, triples: list[Triple], prefixes: set[str] | None = None) -> Rel | None:
    """Patterns of one subject, folded into one scan of each table that answers all of them; None if they can't be."""
    if not isinstance(ctx.data, MappedTables) or ctx.graph_var or ctx.scope.default is not None or any(not isinstance(t.p, Term) or isinstance(t.o, Quoted) for t in triples):
        return None
    by_prefix: dict[str, list[ClassMap]] = {}
    for c in ctx.data.classes:
        if c.graph == ctx.graph and (prefixes is None or c.prefix in prefixes) and not (isinstance(subject, Term) and not subject.lex.startswith(c.prefix)):
            by_prefix.setdefault(c.prefix, []).append(c)
    rels = []
    for classes in by_prefix.values():
        groups: dict[tuple[str, ...], list[Triple]] = {}
        for t in triples:
            own = tuple(c.name for c in classes if answers(c, t))
            groups.setdefault(own, []).append(t)
        if () not in groups:
            named = {c.name: c for c in classes}
            rels.append(reduce(join, [reduce(union, [fold(named[n], subject, ts) for n in own]) for own, ts in groups.items()]))
    if not rels:
        names = set().union(*map(variables, triples))
        cols = {n: fresh(n) for n in names}
        schema = ", ".join(f"{c} {TERM_TYPE}" for c in cols.values()) or "x int"
        return Rel(ctx.spark.createDataFrame([], schema), {n: Binding(c, TERM) for n, c in cols.items()})
    return reduce(union, rels)


def answers(c: ClassMap, t: Triple) -> bool:
    """Whether a table's rows can have a pattern's triple."""
    if t.p.lex == RDF_TYPE:
        return not isinstance(t.o, Term) or t.o.lex == c.cls
    return t.p.lex in c.properties


def fold(c: ClassMap, subject: object, triples: list[Triple]) -> Rel:
    types, others = [t for t in triples if t.p.lex == RDF_TYPE], [t for t in triples if t.p.lex != RDF_TYPE]
    table = c.table()
    prefix = fresh("row") + "_"
    df = table.select(*[F.col(x).alias(prefix + x) for x in table.columns], F.expr(c.key).alias(prefix + "@key"))
    rel = Rel(df, {}, {subject.name: (c, prefix)} if isinstance(subject, Var) else {})
    rel = replace(rel, df=rel.df.where(F.col(f"`{prefix}@key`").isNotNull()))
    rel = place(rel, subject, Value(F.col(f"`{prefix}@key`"), c.subject))
    for t in types:
        if not isinstance(t.o, Term):
            rel = place(rel, t.o, Value(F.lit(c.cls), IRI_T))
    return folded(rel, c, prefix, others)


def property_value(rel: Rel, c: ClassMap, prefix: str, p: str) -> tuple[Rel, Value]:
    """A property of a row at hand as a column."""
    x = c.properties[p]
    own = c.table()
    name = fresh("p")
    if x.column in own.columns:
        return rel, Value(F.col(prefix + x.column), x.type)
    inner = F.expr(x.column)
    df = rel.df.withColumns({col: F.col(prefix + col) for col in own.columns if col not in rel.df.columns}).withColumn(name, inner)
    return replace(rel, df=df.drop(*[col for col in own.columns if col not in rel.df.columns])), Value(F.col(name), x.type)


def folded(rel: Rel, c: ClassMap, prefix: str, triples: list[Triple]) -> Rel:
    for t in triples:
        rel, v = property_value(rel, c, prefix, t.p.lex)
        rel = replace(rel, df=rel.df.where(v.col.isNotNull()))
        rel = place(rel, t.o, v)
    return rel


def bgp(ctx: Context, triples: tuple) -> Rel:
    """Stars by subject, then paths and open patterns, joined along shared variables, the first named first."""
    stars: dict[object, list[Triple]] = {}
    rest: list[object] = []
    for t in triples:
        p = t.p
        if isinstance(p, Inverse) and isinstance(p.path, Term):
            t = Triple(t.o, p.path, t.s)
        if isinstance(t.p, Sequence):  # a/b is a join over a hidden variable
            nodes = [t.s, *[Var("." + fresh("mid")) for _ in t.p.parts[1:]], t.o]
            for a, part, b in zip(nodes, t.p.parts, nodes[1:], strict=False):
                one = Triple(b, part.path, a) if isinstance(part, Inverse) and isinstance(part.path, Term) else Triple(a, part, b)
                (stars.setdefault(one.s, []) if isinstance(one.p, Term) and isinstance(one.s, (Var, Term)) else rest).append(one)
        elif isinstance(t.p, Term) and isinstance(t.s, (Var, Term)):
            stars.setdefault(t.s, []).append(t)
        else:
            rest.append(t)
    parts: list[tuple[set[str], Rel]] = []
    known = possible(ctx, stars)
    for s, ts in stars.items():
        whole = star(ctx, s, ts, known.get(s.name) if isinstance(s, Var) else None)
        for rel in [whole] if whole else [scan(ctx, t) for t in sorted(ts, key=boundness)]:
            parts.append((set(rel.vars), rel))
    for t in rest:
        rel = scan(ctx, t) if isinstance(t.p, (Var, Term)) else path_rel(ctx, t)
        parts.append((set(rel.vars), rel))
    if not parts:
        return unit(ctx)
    out = parts.pop(0)[1]
    while parts:
        at = next((i for i, (names, _) in enumerate(parts) if names & set(out.vars)), 0)
        out = join(out, parts.pop(at)[1])
    return out


def boundness(t: Triple) -> int:
    return -sum(isinstance(x, Term) for x in (t.s, t.o))


# --- property paths ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Pairs:
    df: DataFrame  # [s, o]
    s: Type
    o: Type

    def flipped(self) -> Pairs:
        return Pairs(self.df.select(F.col("o").alias("s"), F.col("s").alias("o")), self.o, self.s)

    def strings(self) -> Pairs:
        return Pairs(self.df.select(lexical(Value(F.col("s"), self.s)).alias("s"), lexical(Value(F.col("o"), self.o)).alias("o")), IRI_T, IRI_T)

    def generic(self) -> Pairs:
        return Pairs(self.df.select(as_term(Value(F.col("s"), self.s)).alias("s"), as_term(Value(F.col("o"), self.o)).alias("o")), TERM, TERM)


def alike(*ps: Pairs) -> list[Pairs]:
    if len({(p.s, p.o) for p in ps}) == 1:
        return list(ps)
    return [p.strings() if all(x.s.kind == x.o.kind == "iri" for x in ps) else p.generic() for p in ps]


def edges(ctx: Context, path: object) -> Pairs:
    """Pairs of nodes that a path links: bags for sequence and alternative, sets where something repeats."""
    if isinstance(path, Term):
        rel = bgp(ctx, (Triple(Var("s"), path, Var("o")),))
        s, o = rel.vars["s"], rel.vars["o"]
        return Pairs(rel.df.select(F.col(s.col).alias("s"), F.col(o.col).alias("o")), s.type, o.type)
    if isinstance(path, Inverse):
        return edges(ctx, path.path).flipped()
    if isinstance(path, Alternative):
        ps = alike(*[edges(ctx, p) for p in path.parts])
        return Pairs(reduce(DataFrame.unionByName, [p.df for p in ps]), ps[0].s, ps[0].o)
    if isinstance(path, Sequence):
        out = edges(ctx, path.parts[0])
        for p in path.parts[1:]:
            nxt = edges(ctx, p)
            if out.o != nxt.s:
                out, nxt = out.generic(), nxt.generic()
            right = nxt.df.select(F.col("s").alias("m"), F.col("o").alias("n"))
            out = Pairs(out.df.join(right, F.col("o") == F.col("m")).select("s", F.col("n").alias("o")), out.s, nxt.o)
        return out
    if isinstance(path, Negated):
        t = ctx.data.triples(ctx.scope, ctx.graph, False)
        parts = []
        if path.forward or not path.backward:
            parts.append(t.where(~F.col("p").isin(*path.forward)).select("s", "o"))
        if path.backward:
            parts.append(t.where(~F.col("p").isin(*path.backward)).select(F.col("o").alias("s"), F.col("s").alias("o")))
        return Pairs(reduce(DataFrame.unionByName, parts), TERM, TERM)
    if isinstance(path, Repeat):
        return repeated(ctx, path, None)
    raise Unsupported(f"path {path}")


def nodes(ctx: Context) -> Pairs:
    """Every subject and object of the graph with itself."""
    t = ctx.data.triples(ctx.scope, ctx.graph, False)
    n = t.select(F.col("s").alias("s")).unionByName(t.select(F.col("o").alias("s"))).distinct()
    return Pairs(n.select("s", F.col("s").alias("o")), TERM, TERM)


def node(ctx: Context, t: Term) -> DataFrame:
    """[s, o]: a constant with itself if it is a subject or object of the graph; of mapped tables only columns that can have it are read."""
    if not isinstance(ctx.data, MappedTables) or ctx.scope != Scope():
        return nodes(ctx).df.where(matches(Value(F.col("s"), TERM), t, ""))
    own = struct(LITERAL, F.lit(t.lex), t.dt) if t.kind == LITERAL and t.dt in INTEGERS else as_term(constant(t))
    found = [ctx.spark.createDataFrame([], "x int")]
    for c in ctx.data.classes:
        if c.graph != ctx.graph:
            continue
        rows = c.table().where(F.expr(c.key).isNotNull())
        values = [Value(F.expr(c.key), c.subject), *[Value(F.expr(x.column), x.type) for x in c.properties.values()]]
        if t.kind == IRI and t.lex == c.cls:
            values.append(Value(F.lit(c.cls), IRI_T))
        for v in values:
            if v.type.kind == "term":
                test = matches(v, t, "")
            elif v.type.kind == "iri" and t.kind == IRI and (v.type.prefix is None or t.lex.startswith(v.type.prefix)):
                test = matches(v, t, rows.select(v.col.alias("x")).schema[0].dataType.simpleString())
            elif v.type.kind == "lit" and t.kind == LITERAL and t.dt == v.type.dt and t.lang == v.type.lang:
                test = lexical(v) == own["v"]
            else:
                continue
            found.append(rows.where(test).select(F.lit(1).alias("x")).limit(1))
    return reduce(DataFrame.unionByName, found).limit(1).select(own.alias("s"), own.alias("o"))


def repeated(ctx: Context, path: Repeat, start: Term | None) -> Pairs:
    inner = edges(ctx, path.path)
    if inner.s != inner.o:
        inner = inner.generic()
    seeds = None
    first = inner.df
    if start is not None:
        kind = inner.df.schema["s"].dataType.simpleString()
        first = inner.df.where(matches(Value(F.col("s"), inner.s), start, kind))
        seeds = first.select("s")
    pairs = Pairs(closure(inner.df, seeds), inner.s, inner.o) if path.many else Pairs(first.distinct(), inner.s, inner.o)
    if not path.zero:
        return pairs
    own = nodes(ctx).df if start is None else node(ctx, start)
    return Pairs(pairs.generic().df.unionByName(own).distinct(), TERM, TERM)


def path_rel(ctx: Context, t: Triple) -> Rel:
    if ctx.graph_var:
        raise Unsupported("a property path below GRAPH with a variable")
    path, s, o = t.p, t.s, t.o
    if isinstance(path, Repeat) and isinstance(o, Term) and not isinstance(s, Term):
        path, s, o = Repeat(Inverse(path.path), path.zero, path.many), o, s
    pairs = repeated(ctx, path, s) if isinstance(path, Repeat) and isinstance(s, Term) else edges(ctx, path)
    a, b = fresh("s"), fresh("o")
    rel = Rel(pairs.df.select(F.col("s").alias(a), F.col("o").alias(b)), {})
    return narrowed(place(place(rel, s, Value(F.col(a), pairs.s)), o, Value(F.col(b), pairs.o)))


# --- joins -------------------------------------------------------------------------------------


def aligned(l: Rel, r: Rel) -> tuple[Rel, Rel, list[str]]:
    """Both sides with the shared variables in one type."""
    shared = [n for n in l.vars if n in r.vars]
    for n in shared:
        a, b = l.vars[n], r.vars[n]
        if a.type != b.type:
            both_iri = a.type.kind == b.type.kind == "iri"
            to, f = (IRI_T, lexical) if both_iri else (TERM, as_term)
            sides = []
            for rel, x in ((l, a), (r, b)):
                c = fresh(n)
                sides.append(rel if x.type == to else Rel(rel.df.withColumn(c, f(x.value)), rel.vars | {n: replace(x, col=c, type=to)}, rel.rows))
            l, r = sides
    return l, r, shared


def condition(l: Rel, r: Rel, shared: list[str]) -> Column | None:
    cs = []
    for n in shared:
        a, b = l.vars[n], r.vars[n]
        c = F.col(a.col) == F.col(b.col)
        if a.maybe:
            c = c | F.col(a.col).isNull()
        if b.maybe:
            c = c | F.col(b.col).isNull()
        cs.append(c)
    return reduce(lambda x, y: x & y, cs) if cs else None


def merged(df: DataFrame, l: Rel, r: Rel, shared: list[str], outer: bool = False) -> Rel:
    """The variables of both sides; a shared one that may be unbound on the left is taken from the right then."""
    out = dict(l.vars)
    for n, b in r.vars.items():
        if n not in l.vars:
            out[n] = replace(b, maybe=b.maybe or outer)
        elif l.vars[n].maybe:
            c = fresh(n)
            df = df.withColumn(c, F.coalesce(l.vars[n].col, b.col))
            out[n] = Binding(c, b.type, outer or b.maybe)
    return Rel(df, out, l.rows | ({} if outer else r.rows))


#: Estimated bytes up to which a side of a product is simply sent to the rows of the other.
TINY = 8192


def join(l: Rel, r: Rel) -> Rel:
    l, r, shared = aligned(l, r)
    if many_to_many(l, r, shared):
        l, r = spelled(l), spelled(r)
    return merged(compatible(l, r, shared), l, r, shared)


def many_to_many(l: Rel, r: Rel, shared: list[str]) -> bool:
    """Whether a row may meet many on both sides: a product, or shared values that are native and no row's key."""
    return not any(n in l.rows or n in r.rows or l.vars[n].type == TERM for n in shared)


def spelled(rel: Rel) -> Rel:
    """IRIs of keys as texts before rows are multiplied."""
    for n, b in rel.vars.items():
        if b.type.kind == "iri" and b.type.prefix is not None and b.text is None:
            c = fresh(n)
            rel = replace(rel, df=rel.df.withColumn(c, lexical(b.value)), vars=rel.vars | {n: replace(b, text=c)})
    return rel


def tiny(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= TINY


def pairs(l: Rel, r: Rel, shared: list[str]) -> DataFrame:
    """Pairs of rows with the same shared values, all bound; groups with many on both sides are dealt over tasks."""
    if not many_to_many(l, r, shared):
        return l.df.join(r.df, condition(l, r, shared))
    if not shared and (tiny(l.df) or tiny(r.df)):
        return l.df.crossJoin(r.df)
    by = tuple([*dict.fromkeys([b.col for b in x.vars.values()] + [p + "@key" for _, p in x.rows.values()])] for x in (l, r))
    return even_join(l.df, r.df, [(l.vars[n].col, r.vars[n].col) for n in shared], by=by)


def compatible(l: Rel, r: Rel, shared: list[str]) -> DataFrame:
    """Pairs of compatible rows: an equi-join of those that are bound on both sides, and apart from it those that lack a variable, joined by the others."""
    open_ = [n for n in shared if l.vars[n].maybe or r.vars[n].maybe]
    if not open_:
        return pairs(l, r, shared)
    if len(open_) > 2:
        return l.df.join(r.df, condition(l, r, shared))
    n, rest = open_[0], [x for x in shared if x != open_[0]]
    a, b = F.col(l.vars[n].col), F.col(r.vars[n].col)

    def bound(rel: Rel) -> Rel:
        return replace(rel, vars=rel.vars | {n: replace(rel.vars[n], maybe=False)})

    out = compatible(bound(l), bound(r), shared)
    if l.vars[n].maybe:
        out = out.union(compatible(replace(l, df=l.df.where(a.isNull())), r, rest))
    if r.vars[n].maybe:
        out = out.union(compatible(replace(l, df=l.df.where(a.isNotNull())), replace(r, df=r.df.where(b.isNull())), rest))
    return out


def left_join(ctx: Context, l: Rel, right: object, on: object) -> Rel:
    if on is None and isinstance(right, Bgp) and right.triples and isinstance(ctx.data, MappedTables):
        s = right.triples[0].s
        own = l.rows.get(s.name) if isinstance(s, Var) else None
        plain = all(t.s == s and isinstance(t.p, Term) and t.p.lex != RDF_TYPE and isinstance(t.o, Var) and t.o.name not in l.vars for t in right.triples)
        if own and plain and all(t.p.lex in own[0].properties for t in right.triples) and len({t.o for t in right.triples}) == len(right.triples):
            values = []
            for t in right.triples:
                l, v = property_value(l, *own, t.p.lex)
                values.append((t.o.name, v))
            all_there = reduce(lambda a, b: a & b, [v.col.isNotNull() for _, v in values])
            for name, v in values:
                c = fresh(name)
                l = Rel(l.df.withColumn(c, F.when(all_there, v.col)), l.vars | {name: Binding(c, v.type, True)}, l.rows)
            return l
    r = compile_pattern(ctx, right)
    l, r, shared = aligned(l, r)
    c = condition(l, r, shared)
    if on is not None:
        both = Rel(l.df, r.vars | l.vars)
        extra = F.coalesce(fn.ebv(expression(ctx, both, on)), F.lit(False))
        c = extra if c is None else c & extra
    marker = fresh("there")
    return merged(l.df.join(r.df.withColumn(marker, F.lit(True)), F.lit(True) if c is None else c, "left"), l, r, shared, outer=True)


def union(l: Rel, r: Rel) -> Rel:
    cols_l, cols_r, out = [], [], {}
    for n in dict.fromkeys([*l.vars, *r.vars]):
        a, b = l.vars.get(n), r.vars.get(n)
        c = fresh(n)
        if a and b:
            if a.type == b.type:
                x, y, t = F.col(a.col), F.col(b.col), a.type
            elif a.type.kind == b.type.kind == "iri":
                x, y, t = lexical(a.value), lexical(b.value), IRI_T
            else:
                x, y, t = as_term(a.value), as_term(b.value), TERM
            out[n] = Binding(c, t, a.maybe or b.maybe)
        else:
            own, rel = (a, l) if a else (b, r)
            kind = rel.df.schema[own.col].dataType
            x, y = (F.col(own.col), F.lit(None).cast(kind)) if a else (F.lit(None).cast(kind), F.col(own.col))
            out[n] = Binding(c, own.type, True)
        cols_l.append(x.alias(c))
        cols_r.append(y.alias(c))
    if not out:
        one = fresh("unit")
        return Rel(l.df.select(F.lit(1).alias(one)).unionByName(r.df.select(F.lit(1).alias(one))), {})
    return Rel(l.df.select(*cols_l).unionByName(r.df.select(*cols_r)), out)


def minus(l: Rel, r: Rel) -> Rel:
    l, r, shared = aligned(l, r)
    if not shared:
        return l
    c = condition(l, r, shared)
    if any(l.vars[n].maybe or r.vars[n].maybe for n in shared):
        meet = reduce(lambda a, b: a | b, [F.col(l.vars[n].col).isNotNull() & F.col(r.vars[n].col).isNotNull() for n in shared])
        c = c & meet
    return replace(l, df=l.df.join(r.df.select(*{r.vars[n].col for n in shared}), c, "left_anti"))


def exists(ctx: Context, l: Rel, e: Exists) -> Rel:
    """A semi- or anti-join on the variables that both sides have; a filter inside may look at the left side's."""
    pattern, inner = e.pattern, None
    if isinstance(pattern, Filter) and set(l.vars) & (expression_variables(pattern.condition) - variables(pattern.pattern)):
        pattern, inner = pattern.pattern, pattern.condition
    r = compile_pattern(ctx, pattern)
    l, r, shared = aligned(l, r)
    c = condition(l, r, shared)
    if inner is not None:
        test = F.coalesce(fn.ebv(expression(ctx, Rel(l.df, r.vars | l.vars), inner)), F.lit(False))
        c = test if c is None else c & test
    if c is None:
        c = F.lit(True)
        r = replace(r, df=r.df.limit(1))
    return replace(l, df=l.df.join(r.df, c, "left_anti" if e.negated else "left_semi"))


def expression_variables(e: object) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(set(), *map(expression_variables, e.args))
    if isinstance(e, Exists):
        return variables(e.pattern)
    return variables(e) if isinstance(e, Quoted) else set()


def conjuncts(e: object) -> list:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if isinstance(e, Call) and e.name == "&&" else [e]


def has_exists(e: object) -> bool:
    return isinstance(e, Exists) or isinstance(e, Call) and any(map(has_exists, e.args))


def filtered(ctx: Context, rel: Rel, e: object) -> Rel:
    for part in conjuncts(e):
        if isinstance(part, Call) and part.name == "!" and isinstance(part.args[0], Exists):
            part = replace(part.args[0], negated=not part.args[0].negated)
        if isinstance(part, Exists):
            rel = exists(ctx, rel, part)
        elif has_exists(part):
            rel, part = marked(ctx, rel, part)
            rel = replace(rel, df=rel.df.where(fn.ebv(expression(ctx, rel, part))))
        elif (bound := iri_equality(rel, part)) is not None:
            rel = replace(rel, df=rel.df.where(bound))
        else:
            rel = replace(rel, df=rel.df.where(fn.ebv(expression(ctx, rel, part))))
    return rel


def iri_equality(rel: Rel, e: object) -> Column | None:
    """?x = <iri> as a comparison of keys, so that it reaches the scan."""
    if isinstance(e, Call) and e.name == "=" and isinstance(e.args[0], Var) and isinstance(e.args[1], Term) and e.args[1].kind == IRI and e.args[0].name in rel.vars:
        b = rel.vars[e.args[0].name]
        if b.type.kind == "iri":
            return matches(b.value, e.args[1], rel.df.schema[b.col].dataType.simpleString())
    return None


def marked(ctx: Context, rel: Rel, e: object) -> tuple[Rel, object]:
    """EXISTS inside a larger expression: a column that says whether the pattern has a match."""
    if isinstance(e, Exists):
        row, name = fresh("id"), fresh("exists")
        base = replace(rel, df=rel.df.withColumn(row, F.xxhash64(*[F.col(b.col) for b in rel.vars.values()]) if rel.vars else F.lit(0)))
        hit = exists(ctx, base, Exists(e.pattern)).df.select(F.col(row).alias(row + "_r")).distinct()
        df = base.df.join(hit, F.col(row) == F.col(row + "_r"), "left").withColumn(name, F.col(row + "_r").isNotNull() != F.lit(e.negated)).drop(row, row + "_r")
        return Rel(df, rel.vars | {"." + name: Binding(name, BOOL)}, rel.rows), Var("." + name)
    if isinstance(e, Call):
        args = []
        for a in e.args:
            rel, x = marked(ctx, rel, a) if has_exists(a) else (rel, a)
            args.append(x)
        return rel, replace(e, args=tuple(args))
    return rel, e


# --- expressions -------------------------------------------------------------------------------


def expression(ctx: Context, rel: Rel, e: object) -> Value:
    if isinstance(e, Var):
        return rel.value(e.name)
    if isinstance(e, Term):
        return constant(e)
    if isinstance(e, Quoted):
        return fn.triple(*[expression(ctx, rel, x) for x in (e.s, e.p, e.o)])
    if not isinstance(e, Call):
        raise Unsupported(f"expression {e}")
    if e.name == "BOUND":
        return fn.boolean(rel.value(e.args[0].name).col.isNotNull())
    args = [expression(ctx, rel, a) for a in e.args]
    if e.name in ("+", "-", "*", "/"):
        return fn.arithmetic(e.name, *args)
    if e.name in fn.COMPARE:
        return fn.compare(e.name, *args)
    if e.name == "&&":
        return fn.boolean(fn.ebv(args[0]) & fn.ebv(args[1]))
    if e.name == "||":
        return fn.boolean(fn.ebv(args[0]) | fn.ebv(args[1]))
    if e.name == "!":
        return fn.boolean(~fn.ebv(args[0]))
    if e.name not in fn.REGISTRY:
        raise Unsupported(f"function {e.name}")
    return fn.REGISTRY[e.name](*args)


# --- patterns ----------------------------------------------------------------------------------


def compile_pattern(ctx: Context, p: object) -> Rel:
    if isinstance(p, Bgp):
        return bgp(ctx, p.triples)
    if isinstance(p, Join):
        if isinstance(p.left, Bgp) and not p.left.triples:
            return compile_pattern(ctx, p.right)
        return join(compile_pattern(ctx, p.left), compile_pattern(ctx, p.right))
    if isinstance(p, LeftJoin):
        return left_join(ctx, compile_pattern(ctx, p.left), p.right, p.condition)
    if isinstance(p, Union):
        return union(compile_pattern(ctx, p.left), compile_pattern(ctx, p.right))
    if isinstance(p, Minus):
        return minus(compile_pattern(ctx, p.left), compile_pattern(ctx, p.right))
    if isinstance(p, Filter):
        return filtered(ctx, compile_pattern(ctx, p.pattern), p.condition)
    if isinstance(p, Extend):
        rel = compile_pattern(ctx, p.pattern)
        return extend(ctx, rel, p.var, p.expr)
    if isinstance(p, Values):
        return values(ctx, p)
    if isinstance(p, Graph):
        if isinstance(p.name, Term):
            return compile_pattern(replace(ctx, graph=p.name.lex, graph_var=None), p.pattern)
        return compile_pattern(replace(ctx, graph=None, graph_var=p.name.name), p.pattern)
    if isinstance(p, Service):
        if p.silent:
            return unit(ctx)
        raise Unsupported("SERVICE is disabled")
    if isinstance(p, Select):
        return select(ctx, p)
    raise Unsupported(f"pattern {type(p).__name__}")


def extend(ctx: Context, rel: Rel, name: str, e: object) -> Rel:
    if has_exists(e):
        rel, e = marked(ctx, rel, e)
    v, c = expression(ctx, rel, e), fresh(name)
    maybe = rel.vars[e.name].maybe if isinstance(e, Var) and e.name in rel.vars else not isinstance(e, Term)
    return Rel(rel.df.withColumn(c, v.col), rel.vars | {name: Binding(c, v.type, maybe)}, rel.rows)


def values(ctx: Context, p: Values) -> Rel:
    cols = {n: fresh(n) for n in p.names}
    out, data, schema = {}, [], []
    plain = {}
    for i, n in enumerate(p.names):
        cells = [r[i] for r in p.rows]
        kinds = {(t.kind, t.dt, t.lang) for t in cells if t is not None}
        maybe = any(t is None for t in cells)
        one = next(iter(kinds)) if len(kinds) == 1 else None
        if one == (LITERAL, XSD + "integer", ""):
            plain[n] = (lambda t: int(t.lex), "bigint", INT)
        elif one == (LITERAL, XSD + "string", ""):
            plain[n] = (lambda t: t.lex, "string", STR)
        elif one and one[0] == IRI:
            plain[n] = (lambda t: t.lex, "string", IRI_T)
        else:
            plain[n] = (lambda t: (t.kind, t.lex, t.dt, t.lang), TERM_TYPE, TERM)
        out[n] = Binding(cols[n], plain[n][2], maybe)
        schema.append(f"{cols[n]} {plain[n][1]}")
    for r in p.rows:
        data.append(tuple(None if t is None else plain[n][0](t) for n, t in zip(p.names, r, strict=True)))
    if not p.names:
        return Rel(ctx.spark.range(len(p.rows)).select(F.lit(1).alias(fresh("unit"))), {})
    return Rel(ctx.spark.createDataFrame(data, ", ".join(schema)), out)


# --- solution modifiers ------------------------------------------------------------------------


def aggregates(e: object) -> list[Call]:
    if isinstance(e, Call):
        return [e] if e.name in AGGREGATES else [a for x in e.args for a in aggregates(x)]
    return []


def aggregate(v: Value | None, call: Call) -> tuple[Column, Type]:
    """The aggregate's column over a group and its type. A value that is no number, or a result too large, makes SUM and AVG unbound."""
    name = call.name
    if name == "COUNT":
        if v is None:
            return F.count(F.lit(1)), INT
        return (F.countDistinct(v.col) if call.distinct else F.count(v.col)), INT
    d = F.sum_distinct if call.distinct else F.try_sum
    if name in ("SUM", "AVG"):
        if v.numeric:
            if name == "SUM":
                zero = F.lit(0).cast("bigint") if v.type.dt in INTEGERS else F.lit(0) if v.type == DEC else F.lit(0.0)
                return F.when(F.count(v.col) > 0, d(v.col)).otherwise(zero), INT if v.type.dt in INTEGERS else v.type
            n = F.countDistinct(v.col) if call.distinct else F.count(v.col)
            if v.type.dt in (XSD + "double", XSD + "float"):
                return F.coalesce(F.try_divide(d(v.col), n), F.lit(0.0)), DBL
            return F.coalesce(F.try_divide(d(v.col).try_cast(fn.EXACT), n.cast("decimal(19,0)")).try_cast(fn.EXACT), F.lit(0).cast(fn.EXACT)), DEC
        t = as_term(v)
        r = F.max(fn.rank(t))
        bad = F.count_if(t.isNotNull() & (fn.rank(t).isNull() | ((fn.rank(t) <= 2) & fn.as_exact(v).isNull()))) > 0
        exact, double, n = d(fn.as_exact(v)), d(fn.as_double(v)), F.count(t)
        if name == "AVG":
            exact, double, r = F.try_divide(exact.try_cast(fn.EXACT), n.cast("decimal(19,0)")).try_cast(fn.EXACT), F.try_divide(double, n), F.greatest(r, F.lit(2))
        none = struct(LITERAL, F.lit("0"), XSD + "integer")
        return F.when(bad, F.lit(None)).when(n == 0, none).otherwise(fn.number_term(r, exact, double).col), TERM
    if name in ("MIN", "MAX"):
        if v.type.kind != "term":
            return (F.min if name == "MIN" else F.max)(v.col), v.type
        key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(fn.order_key(v))])
        return (F.min_by if name == "MIN" else F.max_by)(v.col, F.when(v.col.isNotNull(), key)), TERM
    if name == "SAMPLE":
        return F.first(v.col, ignorenulls=True), v.type
    text = lexical(v)
    items = F.array_sort(F.collect_set(text) if call.distinct else F.collect_list(text))
    return F.array_join(items, call.separator), STR


def replaced(e: object, names: dict[Call, str]) -> object:
    if isinstance(e, Call):
        return Var(names[e]) if e in names else replace(e, args=tuple(replaced(a, names) for a in e.args))
    return e


def grouped(ctx: Context, rel: Rel, s: Select) -> tuple[Rel, Select]:
    keys, out = [], {}
    for name, e in s.group:
        rel = extend(ctx, rel, n := name or "." + fresh("key"), e) if not (isinstance(e, Var) and e.name == name) else rel
        n = name or n
        v = rel.value(n)
        c = fresh(n)
        keys.append(v.col.alias(c))
        out[n] = Binding(c, v.type, n not in rel.vars or rel.vars[n].maybe)
    calls = list(dict.fromkeys(a for e in [*[e for _, e in s.items or ()], *s.having, *[e for e, _ in s.order]] for a in aggregates(e)))
    names, columns = {}, []
    for call in calls:
        v = expression(ctx, rel, call.args[0]) if call.args else None
        if v is None and call.distinct:
            v = Value(F.struct(*[F.col(b.col) for n, b in rel.vars.items() if not n.startswith(".")]), TERM)
        col, t = aggregate(v, call)
        c = fresh("agg")
        names[call] = "." + c
        columns.append(col.alias(c))
        out["." + c] = Binding(c, t, call.name != "COUNT")
    df = rel.df.groupBy(*keys).agg(*columns) if columns else rel.df.select(*keys).distinct()
    s = replace(s, items=s.items and tuple((n, e if e is None else replaced(e, names)) for n, e in s.items), having=tuple(replaced(e, names) for e in s.having), order=tuple((replaced(e, names), d) for e, d in s.order))
    return Rel(df, out), s


def select(ctx: Context, s: Select) -> Rel:
    rel = compile_pattern(ctx, s.pattern)
    if s.values:
        rel = join(rel, values(ctx, s.values))
    if s.grouped or any(aggregates(e) for _, e in s.items or () if e is not None):
        rel, s = grouped(ctx, rel, s)
        for e in s.having:
            rel = replace(rel, df=rel.df.where(fn.ebv(expression(ctx, rel, e))))
    names = [n for n in rel.vars if not n.startswith(".")] if s.items is None else [n for n, _ in s.items]
    for n, e in s.items or ():
        if e is not None:
            rel = extend(ctx, rel, n, e)
        elif n not in rel.vars:
            rel = Rel(rel.df.withColumn(c := fresh(n), F.lit(None).cast(TERM_TYPE)), rel.vars | {n: Binding(c, TERM, True)})
    order = []
    for e, down in s.order:
        if has_exists(e):
            rel, e = marked(ctx, rel, e)
        order += [k.desc_nulls_last() if down else k.asc_nulls_first() for k in fn.order_key(expression(ctx, rel, e))]
    df = rel.df
    if s.distinct:
        rel = replace(rel, vars={n: replace(b, text=None) for n, b in rel.vars.items()})
    keep = [c for n in names for c in (rel.vars[n].col, rel.vars[n].text) if c]
    if s.distinct:
        df = df.select(*keep).distinct() if not order else df.dropDuplicates(list(dict.fromkeys(keep)))
    if order:
        df = df.orderBy(*order)
    if s.offset:
        df = df.offset(s.offset)
    if s.limit is not None:
        df = df.limit(s.limit)
    return Rel(df.select(*dict.fromkeys(keep)) if keep else df, {n: rel.vars[n] for n in names})


# --- whole queries -----------------------------------------------------------------------------


def context(data: QuadTable | MappedTables, default: tuple, named: tuple, allowed: tuple[str, ...] | None = None) -> Context:
    scope = Scope()
    if default or named:
        scope = Scope(tuple(default), tuple(named) if named != ("*",) else None)
    return Context(data, scope if allowed is None else scope.allowed(allowed))


def output(rel: Rel, names: list[str]) -> DataFrame:
    """Result columns: native values, IRIs as strings, mixed terms as structs."""
    texts = {n: b.text for n, b in rel.vars.items() if b.text and b.type.kind == "iri"}
    return rel.df.select(*[(F.col(texts[n]) if n in texts else native(rel.value(n))).alias(n) for n in names])


def query(data: QuadTable | MappedTables, text: str, prefixes: dict[str, str] | None = None, base: str = "", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Runs a SPARQL query. SELECT: a column for each variable; ASK: one row [answer]; CONSTRUCT and DESCRIBE: [s, p, o]."""
    q = parse_query(text, base, prefixes)
    ctx = context(data, q.default, q.named, allowed)
    return run(ctx, q)


def run(ctx: Context, q: Query) -> DataFrame:
    if q.form == "SELECT":
        rel = select(ctx, q.select)
        return output(rel, list(rel.vars))
    if q.form == "ASK":
        rel = select(ctx, q.select)
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    rel = select(ctx, q.select)
    if q.form == "CONSTRUCT":
        return construct(ctx, rel, q.template)
    return describe(ctx, rel, q.targets)


def template_value(ctx: Context, rel: Rel, node: object, row: Column) -> Column:
    if isinstance(node, Term) and node.kind == BLANK:
        return struct(BLANK, F.concat(F.lit(node.lex + "x"), row))
    if isinstance(node, Var) and node.name.startswith(".") and node.name not in rel.vars:
        return struct(BLANK, F.concat(F.lit(node.name.strip(".") + "x"), row))
    return as_term(expression(ctx, rel, node))


def instances(ctx: Context, rel: Rel, template: tuple) -> DataFrame:
    """[g, s, p, o] of a template, blank nodes fresh for each solution; ill-formed triples are left out."""
    row = fresh("solution")
    df = rel.df.withColumn(row, F.monotonically_increasing_id().cast("string"))
    own, items = F.col(row), []
    for g, t in template:
        graph = F.lit(None).cast("string") if g is None else lexical(expression(ctx, rel, g))
        p = as_term(expression(ctx, rel, t.p))
        items.append(F.struct(graph.alias("g"), template_value(ctx, rel, t.s, own).alias("s"), F.when(p["k"] == IRI, p["v"]).alias("p"), template_value(ctx, rel, t.o, own).alias("o"), F.lit(g is not None).alias("named")))
    if not items:
        return ctx.spark.createDataFrame([], "g string, s " + TERM_TYPE + ", p string, o " + TERM_TYPE)
    out = df.select(F.explode(F.array(*items)).alias("q")).select("q.*")
    sound = F.col("s").isNotNull() & (F.col("s.k") != LITERAL) & F.col("p").isNotNull() & F.col("o").isNotNull() & (~F.col("named") | F.col("g").isNotNull())
    return out.where(sound).select("g", "s", "p", "o").distinct()


def construct(ctx: Context, rel: Rel, template: tuple) -> DataFrame:
    return instances(ctx, rel, template).select("s", "p", "o")


def describe(ctx: Context, rel: Rel, targets: tuple | None) -> DataFrame:
    """All triples of the targets, and on from blank nodes that they lead to."""
    t = ctx.data.triples(ctx.scope, ctx.graph)
    wanted = None
    for node in [Var(n) for n in rel.vars if not n.startswith(".")] if targets is None else targets:
        one = rel.df.select(as_term(expression(ctx, rel, node)).alias("s")).distinct()
        wanted = one if wanted is None else wanted.unionByName(one)
    if wanted is None:
        return t.limit(0)
    blank = t.where("o.k = 1").select("s", "o")
    onward = closure(blank, wanted)
    return t.join(wanted.unionByName(onward.select(F.col("o").alias("s"))).distinct(), "s", "left_semi").select("s", "p", "o").distinct()
