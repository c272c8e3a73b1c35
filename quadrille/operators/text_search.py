"""Full-text search: BM25 over literals, exact text filters, autocomplete, spelling, vocabulary recommendations.

The predicate filter comes before the limit, and text filters are evaluated exactly: no row is lost to an index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(c: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def is_word(w: str):  # noqa: ANN201
    return lambda x: x == w


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """([term, id, tf], [id, len])."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    index = t.select("id", F.explode("ts").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return index, t.select("id", F.size("ts").alias("len")).where("len > 0")


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", limit: int | None = 10) -> DataFrame:
    """[id, score] of the documents that have a term of the query, best first; ties by id. Only the query's terms are counted, as rows are scanned."""
    words = sorted({w for w in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split()})
    if not words:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    ts = tokens(F.col(text_col))
    tf = [F.size(F.filter("ts", is_word(w))).alias(f"tf{i}") for i, w in enumerate(words)]
    rows = docs.select(F.col(id_col).alias("id"), ts.alias("ts")).where(F.size("ts") > 0).select("id", F.size("ts").alias("len"), *tf)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    part = [F.when(F.col(f"tf{i}") > 0, F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0) for i in range(len(words))]
    score = part[0]
    for p in part[1:]:
        score = score + p
    out = rows.join(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else out


def search(literals: DataFrame, query: str, predicate: str | None = None, limit: int = 10) -> DataFrame:
    """[id, score] over literal triples [s, p, o]: subjects by their best literal."""
    rows = literals.where(F.col("o.k") == 3)
    if predicate is not None:
        rows = rows.where(F.col("p") == predicate)
    found = bm25(rows.select(F.struct("s", "p", "o").alias("id"), F.col("o.v").alias("text")), query, limit=None)
    return found.groupBy(F.col("id.s").alias("id")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def did_you_mean(words: DataFrame, word: str, column: str = "word") -> DataFrame:
    """Words within a distance of 1 (up to 4 letters) or 2, nearest first."""
    most = 1 if len(word) <= 4 else 2
    return words.withColumn("distance", F.levenshtein(F.lower(column), F.lit(word.lower()))).where(F.col("distance") <= most).orderBy("distance", column)


def autocomplete(words: DataFrame, prefix: str, column: str = "word", most: int = 10) -> DataFrame:
    return words.where(F.lower(column).startswith(prefix.lower())).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def blended(scores: DataFrame, weights: tuple[float, float, float, float] = (1.0, 0.3, 0.5, 0.4)) -> DataFrame:
    """[..., blend]: bm25 and the square roots of occurrences, reuse and local use, each over its maximum, weighted."""
    every = Window.partitionBy()
    norm = lambda c: F.coalesce(c / F.nullif(F.max(c).over(every), F.lit(0.0)), F.lit(0.0))
    parts = [norm(F.col("bm25").cast("double")), norm(F.sqrt("occurrences")), norm(F.sqrt("reuse")), norm(F.sqrt("local"))]
    total = sum(weights)
    score = F.lit(0.0)
    for w, p in zip(weights, parts, strict=True):
        score = score + F.lit(w / total) * p
    return scores.withColumn("blend", score)


def recommend(candidates: DataFrame, most: int = 20) -> list[tuple[str, list[str]]]:
    """A small set of vocabularies that covers all wanted terms: greedily the one of most uncovered terms, then of the best mean score.

    candidates: [term, vocabulary, score]; one row for each wanted term and vocabulary, as many as a person asks for.
    """
    scaled = candidates.withColumn("lo", F.min("score").over(Window.partitionBy("term"))).withColumn("hi", F.max("score").over(Window.partitionBy("term")))
    scaled = scaled.withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0))
    sets = {r["vocabulary"]: (set(r["terms"]), r["mean"]) for r in scaled.groupBy("vocabulary").agg(F.collect_set("term").alias("terms"), F.avg("score").alias("mean")).collect()}
    open_, out = set().union(*(t for t, _ in sets.values())) if sets else set(), []
    while open_ and len(out) < most:
        best = max(sorted(sets), key=lambda v: (len(sets[v][0] & open_), sets[v][1]))
        out.append((best, sorted(sets[best][0] & open_)))
        open_ -= sets[best][0]
    return out
