"""Mixing sources to target weights.

Rows get a random key by hash, and each source's rows stand in the order of (key, id). A source's budget
is its target rounded down: as many whole epochs as fit, and then the rows from the front until the rest
is used up. The row at which it ends is found by prefix sums in two steps: sums over BUCKETS equal ranges
of the key in each source (rows are range-sorted by it, and partial sums combine before the shuffle),
then running sums within the one range in which the budget ends.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share the wanted total by weight; no
target exceeds EPOCHS times its source, the excess is shared again by weight.

Defined results: null text has size 0; rows of size 0 and sources without words take 0; rows that repeat
an id are cut alike, in proportion to their sizes, rounded down; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import written

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose cuts are sent to all executors; with more they are joined by a shuffle.
FEW = 50_000


def n_words(text: Column) -> Column:
    """Number of words, counted as changes from blank to other characters: blanks to spaces, then starts of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """[source, source_size, target] from [source, source_size]; one row a source, so windows over all of them are small."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(EPOCHS))
    # Filled level by level: sources in the order of cap / weight are full as long as the rest can't reach their cap.
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto, every = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({"full": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "used": F.coalesce(F.sum("w").over(upto), F.lit(0.0)), "all_w": F.sum("w").over(every), "all": F.sum("source_size").over(every) * share})
    rows = rows.withColumn("rate", (F.col("all") - F.col("full")) / (F.col("all_w") - F.col("used")))
    rows = rows.withColumn("open", F.col("rate") * F.col("w") < F.col("cap"))
    rate = F.min(F.when(F.col("open"), F.struct(F.col("used"), F.col("rate")))).over(every)["rate"]
    return rows.withColumn("target", F.when(rate.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), rate * F.col("w")))).select("source", "source_size", "target")


def cuts(rows: DataFrame, share: float = 1.0) -> DataFrame:
    """[source, source_size, target, epochs, cut_key, cut_id, cut_size, rest] from [id, source, size, key]: where each source's budget ends.

    Rows before (cut_key, cut_id) are taken epochs + 1 times, rows after it epochs times; the rows at it, cut_size words, share the rest.
    """
    bucket = F.shiftright("key", 48)
    sums = written(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-ranges")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share)
    budget = F.floor("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumn("left", budget - F.col("epochs") * F.col("source_size")), "mix-goals")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    same = F.col("source").eqNullSafe(F.col("g_source"))
    named = goal.select(F.col("source").alias("g_source"), "left")
    ends = sums.withColumn("before", before).join(named, same).where("before <= left and left < before + words").select("g_source", "bucket", "before", "left")
    inside = rows.withColumn("b", bucket).join(F.broadcast(ends) if goal.limit(FEW + 1).count() <= FEW else ends, same & (F.col("b") == F.col("bucket")))
    at = inside.groupBy("g_source", "key", "id", "before", "left").agg(F.sum("size").alias("words"))
    so_far = F.col("before") + F.sum("words").over(Window.partitionBy("g_source").orderBy("key", "id")) - F.col("words")
    cut = at.withColumn("so_far", so_far).where("so_far <= left and left < so_far + words")
    cut = cut.select("g_source", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("words").alias("cut_size"), (F.col("left") - F.col("so_far")).alias("rest"))
    return written(goal.join(cut, same, "left").drop("g_source", "left"), "mix-cuts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, seed: int = 7) -> DataFrame:
    """docs with the struct column `mix`: size, source_size, target, taken. Rows stay where they are: only ids, sources and sizes are shuffled."""
    size = n_words(F.col(text_col))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")  # 60 bits
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "mix-sizes")
    found = cuts(rows, share)
    few = found.limit(FEW + 1).count() <= FEW
    found = found.select(F.col("source").alias("__mix_source"), *[F.col(c).alias(f"__mix_{c}") for c in found.columns if c != "source"])
    c = lambda name: F.col(f"__mix_{name}")
    out = docs.withColumns({"__mix_size": size, "__mix_key": key}).join(F.broadcast(found) if few else found, F.col(source_col).eqNullSafe(c("source")))
    first = F.struct(c("key"), F.col(id_col)) < F.struct(c("cut_key"), c("cut_id"))
    is_cut = (c("key") == c("cut_key")) & F.col(id_col).eqNullSafe(c("cut_id"))
    part = F.when(c("cut_key").isNull(), 0).when(is_cut, F.floor(c("rest") * c("size") / c("cut_size"))).when(first, c("size")).otherwise(0).cast("long")
    taken = c("epochs") * c("size") + part
    made = F.struct(c("size").alias("size"), c("source_size").alias("source_size"), c("target").alias("target"), taken.alias("taken"))
    return out.withColumn("mix", made).drop(*[x for x in out.columns if x.startswith("__mix_")])


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: every row once for each whole epoch it is in, and what is left of it (its first words) at its source's cut."""
    rows = mix(docs, id_col, text_col, source_col)
    size, taken = F.greatest(F.col("mix.size"), F.lit(1)), F.col("mix.taken")  # empty texts are never taken
    whole, rest = F.floor(taken / size).cast("int"), taken % size
    rows = rows.where(taken > 0).withColumn("__times", F.array_repeat(size, whole)).withColumn("__times", F.when(rest > 0, F.concat("__times", F.array(rest))).otherwise(F.col("__times")))
    rows = rows.withColumn("__words", F.explode("__times"))
    # Cut after each word, so that the first n parts are the text up to the end of its n-th word.
    first = F.array_join(F.slice(F.split(text_col, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") < size, first).otherwise(F.col(text_col))
    rows = rows.withColumn("__text", text).drop("mix", "__times", "__words")
    out = rows.withColumn(text_col, F.col("__text")).drop("__text")
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
