"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to N_MAX) in order of frequency, ties by the n-gram.
A document is compared with each language by the out-of-place distance: the sum, over its own profile,
of how far each n-gram's rank is from its rank in the language's profile; a missing one counts PROFILE.

Defined results: null text, and text without any letter, get `und` and score 0; so does every text when
no language was learned. Of equally distant languages the first by name is taken. Case is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, texts_of

N_MAX = 3
#: N-grams of a profile.
PROFILE = 400
#: Documents of each language that are learned from, at most (chosen by hash): the bound of the fitting sample.
SAMPLE_PER_LANGUAGE = 4000

_LETTER = np.zeros(0x110000, bool)


def letters_table() -> np.ndarray:
    """For each code point, whether it is a letter; made once per process."""
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's words (padded by one blank on either side), three code points to an integer, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = letters_table()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.concatenate([[0], np.where(letter, points, 0), [0]])
    grams = [x[1:-1][letter]]
    for n in range(2, N_MAX + 1):
        parts = [x[i : len(x) - n + 1 + i] for i in range(n)]
        inner = np.ones(len(parts[0]), bool)  # blanks may stand at the ends only, and not alone
        for p in parts[1:-1]:
            inner &= p > 0
        if n == 2:
            inner &= (parts[0] > 0) | (parts[1] > 0)
        key = np.zeros(len(parts[0]), np.int64)
        for p in parts:
            key = (key << 21) | p
        grams.append(key[inner])
    return np.unique(np.concatenate(grams), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams, best first; ties by n-gram."""
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def learn(examples: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, list[int]]:
    """Profiles of the languages in examples, from SAMPLE_PER_LANGUAGE documents of each at most. What is brought to the driver is PROFILE n-grams a language."""
    rows = examples.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, SAMPLE_PER_LANGUAGE / n))])
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                own = found.setdefault(lang, [])
                own.append(ngram_counts(text))
                if len(own) >= 64:
                    found[lang] = [summed(own)]
        for lang, parts in found.items():
            grams, counts = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    from pyspark.sql import Window

    totals = map_batches(sample, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    out: dict[str, list[int]] = {lang: [] for lang in sizes}
    for row in sorted(best.select("lang", "r", "gram").collect()):
        out[row["lang"]].append(row["gram"])
    return {lang: grams for lang, grams in out.items() if grams}


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.langs = sorted(profiles)
        every = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.grams = every
        self.rank = np.full((len(every) + 1, len(self.langs)), -1, np.int64)  # the last row: not in any profile
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(every, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def distances(self, text: str) -> np.ndarray | None:
        """Share of the largest possible out-of-place distance, for each language; None without letters."""
        grams = ranked(*ngram_counts(text))
        if not len(grams) or not self.langs:
            return None
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        there = self.rank[at]
        out = np.abs(there - np.arange(len(grams))[:, None])
        out[there < 0] = PROFILE
        return out.sum(0) / (len(grams) * PROFILE)

    def predict(self, text: str | None) -> tuple[str, float]:
        d = self.distances(text) if text else None
        if d is None:
            return "und", 0.0
        best = int(np.argmin(d))
        near = np.exp(-(d - d[best]) * 40)  # a share of closeness, 1 for a language far ahead of the others
        return self.langs[best], float(1 / near.sum())


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id, lang_pred, score] of every row's whole text."""
    kept: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Profiles(profiles))
        for batch in batches:
            got = [kept[0].predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
