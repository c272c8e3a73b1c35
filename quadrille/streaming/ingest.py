"""A stream of N-Quads files into a quad table, each quad once; the reference system has no streams, this serves loads that go on.

State (the quads' digests) is kept on disk without expiry, and Parquet's streaming sink makes each batch
appear exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.sources.dataset import QuadTable
from quadrille.sources.rdf import LINE, parsed, unescaped


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """[g, s, p, o] of the lines that arrive in a folder; ill-formed ones are left out."""
    lines = spark.readStream.text(path).where(F.col("value").rlike(LINE))
    part = lambda i: F.regexp_extract("value", LINE, i)
    g = F.when(part(4) != "", F.regexp_replace(part(4), "^<|>$", ""))
    return lines.select(g.alias("g"), parsed(part(1)).alias("s"), unescaped(part(2)).alias("p"), parsed(part(3)).alias("o"))


def ingest(quads: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived into the target folder, without repeats, and stops."""
    digest = F.sha2(F.to_json(F.struct("g", "s", "p", "o")), 256)
    once = quads.withColumn("digest", digest).dropDuplicates(["digest"]).drop("digest")
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def table(spark: SparkSession, target: str) -> QuadTable:
    return QuadTable(spark.read.parquet(target))
