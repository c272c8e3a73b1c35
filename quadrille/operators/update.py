"""SPARQL updates as copy-on-write: each operation reads one state and writes the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.storage import written
from quadrille.plans.algebra import Load, Manage, Modify, Select
from quadrille.plans.compiler import Context, Rel, Unsupported, compile_pattern, instances, select
from quadrille.plans.parser import parse_update
from quadrille.sources.dataset import QuadTable, Scope

KEY = ["g", "s", "p", "o"]


def same(a: DataFrame, b: DataFrame) -> object:
    cs = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    return cs[0] & cs[1] & cs[2] & cs[3]


def without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    a, b = quads.alias("a"), gone.alias("b")
    return a.join(b, same(a, b), "left_anti")


def in_graph(quads: DataFrame, ref: str) -> object:
    if ref == "DEFAULT":
        return F.col("g").isNull()
    if ref == "NAMED":
        return F.col("g").isNotNull()
    return F.lit(True) if ref == "ALL" else F.coalesce(F.col("g") == ref, F.lit(False))


def target(ref: str) -> object:
    return F.lit(None if ref == "DEFAULT" else ref).cast("string").alias("g")


def modify(data: QuadTable, m: Modify) -> DataFrame:
    """WHERE is evaluated once, on the state before; then the deletions, then the insertions."""
    scope = Scope(m.default, None if m.named == ("*",) else m.named) if m.using else Scope()
    ctx = Context(data, scope)
    if m.pattern is None:
        rel = Rel(data.spark.range(1).select(F.lit(1).alias("unit_row")), {})
    else:
        rel = compile_pattern(ctx, m.pattern) if not isinstance(m.pattern, Select) else select(ctx, m.pattern)
        rel = Rel(written(rel.df.select(*dict.fromkeys(b.col for b in rel.vars.values())) if rel.vars else rel.df, "solutions"), rel.vars)
    out = data.quads
    if m.delete:
        out = without(out, instances(ctx, rel, m.delete))
    if m.insert:
        out = out.unionByName(instances(ctx, rel, m.insert)).distinct()
    return out


def manage(data: QuadTable, m: Manage) -> DataFrame:
    q = data.quads
    if m.op in ("CLEAR", "DROP"):
        return q.where(~in_graph(q, m.source))
    if m.op == "CREATE" or m.source == m.target:
        return q
    moved = q.where(in_graph(q, m.source)).select(target(m.target), "s", "p", "o")
    if m.op in ("COPY", "MOVE"):
        q = q.where(~in_graph(q, m.target))
    if m.op == "MOVE":
        q = q.where(~in_graph(q, m.source))
    return q.unionByName(moved).distinct()


def update(data: QuadTable, text: str, prefixes: dict[str, str] | None = None) -> QuadTable:
    """The dataset after all operations of an update request."""
    for op in parse_update(text, prefixes=prefixes):
        if isinstance(op, Load):
            if not op.silent:
                raise Unsupported("LOAD is disabled")
            continue
        df = modify(data, op) if isinstance(op, Modify) else manage(data, op)
        data = QuadTable(written(df, "quads"))
    return data


def batch(data: QuadTable, statements: list[str]) -> tuple[QuadTable, list[dict]]:
    """All statements are parsed first; each then runs in order and reports the number of quads it leaves."""
    for s in statements:
        parse_update(s)
    report = []
    for s in statements:
        data = update(data, s)
        report.append({"statement": s, "quads": data.quads.count()})
    return data, report


def load(data: QuadTable, more: QuadTable, graph: str | None = None, replace: bool = False) -> QuadTable:
    """Adds quads, all to one graph if that is named; replace clears the graphs that they go to first."""
    new = more.quads if graph is None else more.quads.select(F.lit(graph).alias("g"), "s", "p", "o")
    old = data.quads
    if replace:
        graphs = new.select(F.col("g").alias("to")).distinct()
        old = old.join(graphs, F.col("g").eqNullSafe(F.col("to")), "left_anti")
    return QuadTable(written(old.unionByName(new).distinct(), "quads"))


__all__ = ["batch", "load", "update"]
