"""Transitive closure of edges with set semantics: semi-naive rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.storage import written


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Distinct [s, o] with a path of one edge or more from s to o; edges: [s, o]; seeds: [s], to start from these only.

    From seeds each round takes one more edge. Without them each round joins the newest pairs with all
    pairs so far, which doubles the length of the paths, so chains take log2(length) rounds.
    """
    edges = edges.where("s is not null and o is not null").select("s", "o")
    edges = written(edges if seeds is not None else edges.distinct(), "edges")  # few are met from seeds: those are made distinct
    if seeds is not None:
        seeds = seeds.distinct()
        edges_out, start = edges.select(F.col("s").alias("m"), F.col("o").alias("n")), edges.join(seeds, "s", "left_semi").distinct()
    else:
        start = edges
    parts = [written(start, "closure")]
    while True:
        delta = parts[-1]
        if delta.isEmpty():
            break
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        if seeds is not None:
            new = delta.join(edges_out, F.col("o") == F.col("m")).select("s", F.col("n").alias("o"))
        else:
            right, more = seen.select(F.col("s").alias("m"), F.col("o").alias("n")), delta.select(F.col("s").alias("m"), F.col("o").alias("n"))
            new = delta.join(right, F.col("o") == F.col("m")).select("s", F.col("n").alias("o")).unionByName(seen.join(more, F.col("o") == F.col("m")).select("s", F.col("n").alias("o")))
        fresh = new.distinct().join(seen, ["s", "o"], "left_anti")
        parts.append(written(fresh, "closure"))
        if len(parts) > 6:
            parts = [written(seen, "closure"), parts[-1]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
