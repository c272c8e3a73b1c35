"""The training-data pipeline: five stages, each written and read again as the next one's documents.

Toxic documents go, exact copies go (of each the greatest id stays), near copies go (of each component the
document with the least id stays), sources are mixed to their weights (a document stands once for each
time that the mix takes it; the one at a source's cut is cut to the words it still has room for), and
what is left is encoded and decoded.

Defined results: other columns of documents are kept as they are; n_chars follows a text that is cut. Rows
whose id is null are judged like others and never meet as copies by their id; one stays only where no row
with an id has its text or a near copy. Where an id stands on several texts, each is judged by itself; of a
component exactly one row stays, also where several share the least id. Texts without a word all stay there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from quadrille.llm.common import table, written
from quadrille.llm.queries import BYTES, toxicity_index, vocabulary


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score does not reject."""
    return toxicity.keep_clean(docs, toxicity_index(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the greatest id; rows without an id only where no row with an id has their text."""
    return exact_dedup.keep_one(docs, null_ids=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row: the document with the least id."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.dealt(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, as counts and digests."""
    return bpe.encode_decode(docs, vocabulary(BYTES), full=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Toxicity and BPE can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
