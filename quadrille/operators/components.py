"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to the least node it knows; after about log(nodes) rounds only
stars are left. Everything is grouping (with map-side minima) and joins by node, so a hot node is one that
Spark can split; nothing comes to the driver but a count for each round. As soon as no more than FEW edges
are left, one task on an executor finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.storage import written


#: Edges that one task takes, at most.
FEW = 500_000


def finished(e: DataFrame) -> DataFrame:
    """[u, v]: each node but the least of a component beside that least one, of FEW edges at most, by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x: object) -> object:
            top = x
            while (up := above.setdefault(top, top)) != top:
                top = up
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        kind = None
        for batch in batches:
            kind = batch.column("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                above[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(above)]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, r in found if x != r], kind), pa.array([r for x, r in found if x != r], kind)], names=["u", "v"])

    return e.coalesce(1).mapInArrow(run, e.schema)


def stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    both = e.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    per = both.groupBy("x").agg(F.sum("as_u").alias("us"), F.max("as_v").alias("vs"))
    return per.where("us > 1 or (us > 0 and vs > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """[node, component]: each node that has an edge to another one, and the least node of its component.

    Edges that are null on a side, or from a node to itself, are left out; repeated edges count once.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = written(e.distinct(), "edges")
    while True:
        if e.limit(FEW + 1).count() <= FEW:
            e = written(finished(e), "edges")
            break
        if stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(first.withColumnRenamed("m", "v")).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
