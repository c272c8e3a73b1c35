"""What patterns are matched against.

QuadTable: a DataFrame [g, s, p, o] (s and o as term structs, p an IRI, g null in the default graph); Parquet
written by predicate prunes partitions for constant predicates. MappedTables: ordinary tables read as RDF by
a mapping; a subject's patterns fold into one scan of its table, with native columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.terms import IRI, RDF, TERM, TERM_TYPE, Type, Value, as_term, struct

QUADS = f"g string, s {TERM_TYPE}, p string, o {TERM_TYPE}"
RDF_TYPE = RDF + "type"


@dataclass(frozen=True)
class Scope:
    """Which graphs a pattern reads: the default graph (FROM: the merge of some named graphs), and the named ones (None: all)."""

    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None

    def allowed(self, graphs: tuple[str, ...]) -> Scope:
        """Only what a caller may read; nothing left reads as empty."""
        cut = lambda x: tuple(g for g in (graphs if x is None else x) if g in graphs)
        return Scope(None if self.default is None else cut(self.default), cut(self.named))


class QuadTable:
    """A set of quads."""

    def __init__(self, quads: DataFrame) -> None:
        self.quads = quads.select("g", "s", "p", "o")

    @property
    def spark(self) -> SparkSession:
        return self.quads.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> QuadTable:
        return QuadTable(spark.createDataFrame([], QUADS))

    @staticmethod
    def read(spark: SparkSession, path: str) -> QuadTable:
        return QuadTable(spark.read.parquet(path))

    def write(self, path: str, mode: str = "error") -> None:
        self.quads.distinct().write.mode(mode).partitionBy("p").parquet(path)

    def triples(self, scope: Scope, graph: str | None = None, all_named: bool = False, predicate: str | None = None) -> DataFrame:
        """[s, p, o] of the default graph or of one named graph, or [g, s, p, o] of all named graphs in scope."""
        q = self.quads if predicate is None else self.quads.where(F.col("p") == predicate)
        if all_named:
            q = q.where(F.col("g").isNotNull())
            return q if scope.named is None else q.where(F.col("g").isin(*scope.named))
        if graph is not None:
            seen = scope.named is None or graph in scope.named
            return q.where((F.col("g") == graph) & F.lit(seen)).drop("g")
        if scope.default is None:
            return q.where("g is null").drop("g")
        merged = q.where(F.col("g").isin(*scope.default) if scope.default else F.lit(False)).drop("g")
        return merged if len(scope.default) == 1 else merged.distinct()

    def graphs(self) -> DataFrame:
        """[g, triples] of the named graphs."""
        return self.quads.where("g is not null").groupBy("g").agg(F.count("*").alias("triples"))


@dataclass(frozen=True)
class Property:
    column: str  # a SQL expression over the table
    type: Type


@dataclass(frozen=True)
class ClassMap:
    """Rows of one table as subjects: prefix + key."""

    name: str
    table: Callable[[], DataFrame]
    cls: str
    prefix: str
    key: str  # a SQL expression
    properties: dict[str, Property] = field(default_factory=dict)
    graph: str | None = None

    @property
    def subject(self) -> Type:
        return Type("iri", prefix=self.prefix)


class MappedTables:
    """Virtual RDF over tables; one property of a row is at most one triple."""

    def __init__(self, spark: SparkSession, classes: list[ClassMap]) -> None:
        self.spark, self.classes = spark, classes
        self._quads: QuadTable | None = None

    @property
    def quads(self) -> DataFrame:
        return self.as_quads().quads

    def as_quads(self) -> QuadTable:
        """All triples of the mapping as a quad table: what patterns with open predicates read."""
        if self._quads is None:
            parts = []
            for c in self.classes:
                t = c.table()
                s = as_term(Value(F.expr(c.key), c.subject))
                pairs = [F.struct(F.lit(RDF_TYPE).alias("p"), struct(IRI, F.lit(c.cls)).alias("o"))]
                pairs += [F.struct(F.lit(p).alias("p"), as_term(Value(F.expr(x.column), x.type)).alias("o")) for p, x in c.properties.items()]
                rows = t.select(s.alias("s"), F.explode(F.array(*pairs)).alias("po")).select(F.lit(c.graph).cast("string").alias("g"), "s", "po.p", "po.o")
                parts.append(rows.where("s is not null and o is not null"))
            self._quads = QuadTable(reduce(DataFrame.unionByName, parts)) if parts else QuadTable.empty(self.spark)
        return self._quads

    def triples(self, scope: Scope, graph: str | None = None, all_named: bool = False, predicate: str | None = None) -> DataFrame:
        own = [c for c in self.classes if predicate in (None, RDF_TYPE) or predicate in c.properties]
        if predicate not in (None, RDF_TYPE):
            own = [replace(c, properties={predicate: c.properties[predicate]}) for c in own]
        return MappedTables(self.spark, own).as_quads().triples(scope, graph, all_named, predicate)

    def graphs(self) -> DataFrame:
        return self.as_quads().graphs()


def term_column(name: str) -> Value:
    return Value(F.col(name), TERM)


def key_of(prefix: str, iri: str, kind: str) -> Column | None:
    """The key of an IRI under a prefix, or None if it has another form."""
    if not iri.startswith(prefix):
        return None
    rest = iri[len(prefix) :]
    if kind in ("bigint", "int", "smallint"):
        return F.lit(int(rest)).cast(kind) if rest.lstrip("-").isdigit() and str(int(rest)) == rest else None
    return F.lit(rest)
