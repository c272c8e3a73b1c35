"""Joins with large groups: every group's pairs are dealt over tasks in blocks, so that no task has more than its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each side in a block; a group of fewer pairs than this squared is one block.
ROWS = 4096


def tasks(df: DataFrame) -> int:
    """A number of partitions that keeps all cores busy though some have more pairs than others."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def even_join(l: DataFrame, r: DataFrame, keys: list[tuple[str, str]], on: Column | None = None, by: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """All columns of l and r (of different names) where the keys (pairs of columns) are equal and on holds; without keys every pair of rows.

    A group with n and m rows that has more than ROWS * ROWS pairs is cut into n / ROWS by m / ROWS blocks. A row's part is
    a hash of it (of the columns by of l and of r, if given), so equal rows stay together and a repeated task deals as
    before; rows are copied once for each part of the other side, 2 / ROWS of the pairs in all.
    """
    by, rows, both = by or (l.columns, r.columns), ROWS, []
    for df, side, at in ((l, "l", 0), (r, "r", 1)):
        names = [k[at] for k in keys]
        df = df.where(" and ".join(f"`{n}` is not null" for n in names)) if names else df
        both.append((df, df.groupBy(*[F.col(n).alias(f"even__k{i}") for i, n in enumerate(names)]).agg(F.count("*").alias(f"even__n{side}"))))
    (l, nl), (r, nr) = both
    own = [f"even__k{i}" for i in range(len(keys))]
    counts = nl.join(nr, own) if own else nl.crossJoin(nr)
    large = counts.where(F.col("even__nl").cast("double") * F.col("even__nr") > float(rows) * rows)
    parts = large.select(*own, *[F.ceil(F.col(f"even__n{x}") / rows).cast("int").alias(f"even__p{x}") for x in "lr"])

    def dealt(df: DataFrame, at: int, own_side: str, other: str) -> DataFrame:
        names = [k[at] for k in keys]
        digest = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by[at]]), F.coalesce(f"even__p{own_side}", F.lit(1))).cast("int")
        same = [F.col(n) == F.col(k) for n, k in zip(names, own, strict=True)]
        known = df.join(F.broadcast(parts), same or F.lit(True), "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"even__p{other}", F.lit(1)) - 1))
        out = known.select(*[F.col(f"`{c}`") for c in df.columns], digest.alias(f"even__{own_side}{at}"), copies.alias(f"even__{other}{at}"))
        return out.repartition(tasks(df), *[F.col(f"`{n}`") for n in names], f"even__l{at}", f"even__r{at}")

    x, y = dealt(l, 0, "l", "r"), dealt(r, 1, "r", "l")
    c = (F.col("even__l0") == F.col("even__l1")) & (F.col("even__r0") == F.col("even__r1"))
    for a, b in keys:
        c = c & (F.col(a) == F.col(b))
    out = x.join(y.hint("merge"), c if on is None else c & on)
    return out.drop("even__l0", "even__r0", "even__l1", "even__r1")
