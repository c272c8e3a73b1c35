"""Toxicity by nearest labelled examples under exact TF-IDF cosine over all terms of the examples: whole words, and stems of the longer ones.

Up to EXAMPLES labelled texts are kept as an inverted index: for each term its postings in the order of the
examples, which stand in blocks of BLOCK, and for each term and block the greatest weight (the block
maximum). Postings of frequent terms, which nearly every block has, are dense columns, and a batch of texts
multiplies them at once. Postings of terms that are in few examples are short: they are added in full
before anything is bounded. A text's other terms and the block maxima bound its cosine with every example of a
block; the blocks of the greatest bounds are scored exactly, and then those that can still hold one of the
k nearest. Terms are known by 64-bit hashes. The k nearest vote, weighted by 1 / distance; the share of toxic votes is turned into a probability by an isotonic fit on the
examples themselves, each left out of its own vote. k is that of NEIGHBOURS whose probabilities explain the examples' labels best (least log
loss): where texts of a kind are many, the nearest are alike by kind, and only more of them tell by what is toxic. The neighbours are the evidence.

Defined results: null and empty texts, and texts without a known term, get the examples' rate of label 1;
with no examples at all the score is 0. Rows of the labels without a label are not learned from; if an id
has several, the greatest holds. Ties between neighbours go to the earlier place in the index, which rows alone decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quadrille.llm.common import give_back, map_batches, texts_of, written

#: Labelled examples that are kept, at most: the bound of the fitting sample (chosen by hash).
EXAMPLES = 8192
#: Examples in a block of the index.
BLOCK = 64
#: Neighbours that vote before an index is fitted; and the numbers of them that fitting chooses from.
K = 31
NEIGHBOURS = (K, 63, 127, 255, 511)
#: Terms of more than this share of the examples have dense postings.
DENSE_SHARE = 1 / 16
#: Texts that are scored at once.
BATCH = 128
#: Terms of less than this share of the examples have no block maxima: their postings are short and added in full.
RARE_SHARE = 1 / 128
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: Letters of a stem.
STEM = 4


def terms(text: str) -> Counter[str]:
    """Words, and the stems of longer words with a mark: inflected forms of a word meet in its stem."""
    out = Counter(WORD.findall(text.lower()))
    stems: dict[str, int] = {}
    for word, n in out.items():
        if len(word) > STEM:
            stem = word[:STEM] + "*"
            stems[stem] = stems.get(stem, 0) + n
    dict.update(out, stems)
    return out


def hashed(tf: dict[str, int]) -> np.ndarray:
    return np.fromiter((xxh3_64_intdigest(t) for t in tf), np.uint64, len(tf))


class BlockMaxIndex:
    """Examples in the order of their ids, as flat arrays: terms (numbers in the vocabulary, which are sorted hashes) and counts, `sizes` of them an example. order[i]: which of them stands at place i."""

    def __init__(self, vocabulary: np.ndarray, df: np.ndarray, labels: np.ndarray, sizes: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        n = len(labels)
        # Examples stand by their weightiest frequent term, so that a block's are alike and its maxima tell; then as they came.
        frequent = df > DENSE_SHARE * n
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        first = np.full(n, -1, np.int64)
        some = np.flatnonzero(frequent[at])
        some = some[np.lexsort(((1 + np.log(count[some])) * np.log((n + 1) / df[at[some]]), doc[some]))]
        first[doc[some]] = at[some]
        self.order = np.lexsort((np.arange(n), first))
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        labels, doc = labels[self.order], place[doc]
        self.vocabulary = vocabulary
        self.idf = np.log((n + 1) / df).astype(np.float32)
        self.labels = labels.astype(np.float64)
        self.n_blocks = -(-n // BLOCK)
        w = (1 + np.log(count)).astype(np.float32) * self.idf[at]
        norm = np.sqrt(np.bincount(doc, w * w, n)).astype(np.float32)
        w = w / np.maximum(norm, np.float32(1e-9))[doc]
        often = np.flatnonzero(frequent)
        self.column = np.full(len(vocabulary), -1, np.int64)
        self.column[often] = np.arange(len(often))
        dense = self.column[at] >= 0
        self.dense = np.zeros((self.n_blocks * BLOCK, len(often)), np.float32)
        self.dense[doc[dense], self.column[at[dense]]] = w[dense]
        seldom = df < RARE_SHARE * n
        few = seldom[at]
        order = np.flatnonzero(few)[np.argsort(at[few], kind="stable")]
        self.rare_doc, self.rare_weight = doc[order].astype(np.int32), w[order]
        self.rare_start = np.searchsorted(at[order], np.arange(len(vocabulary) + 1)).astype(np.int32)
        between = np.flatnonzero(~frequent & ~seldom)
        self.middle = np.full(len(vocabulary), -1, np.int32)  # numbers of the terms that have block maxima
        self.middle[between] = np.arange(len(between))
        rest = ~dense & ~few
        doc, at, w = doc[rest], self.middle[at[rest]], w[rest]
        order = np.lexsort((doc, at))
        self.doc, self.weight = doc[order].astype(np.int32), w[order]
        block = at[order].astype(np.int64) * self.n_blocks + self.doc // BLOCK
        self.start = np.searchsorted(block, np.arange(len(between) * self.n_blocks + 1)).astype(np.int32)
        maxima = np.zeros(len(between) * self.n_blocks, np.float32)
        np.maximum.at(maxima, block, self.weight)
        self.maxima = maxima.reshape(len(between), self.n_blocks)
        self.rate = float(self.labels.mean()) if n else 0.0
        self.curve: tuple[list[float], list[float]] = ([0.0, 1.0], [0.0, 1.0])
        self.k = K

    @staticmethod
    def of(examples: list[tuple[dict[str, int], int]]) -> BlockMaxIndex:
        """From (terms with counts, label) in memory."""
        every = np.concatenate([np.empty(0, np.uint64), *(hashed(tf) for tf, _ in examples)])
        known, df = np.unique(every, return_counts=True)
        counts = np.array([c for tf, _ in examples for c in tf.values()], np.int64)
        return BlockMaxIndex(known, df.astype(np.float64), np.array([y for _, y in examples], np.float64), np.array([len(tf) for tf, _ in examples], np.int64), np.searchsorted(known, every), counts)

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of length 1: (1 + log tf) * idf."""
        if not tf or not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.float32)
        own = hashed(tf)
        order = np.argsort(own)  # sorted ones are found faster
        own = own[order]
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == own
        at = at[known]
        return at, self.weighed(at, np.fromiter(tf.values(), np.int64, len(tf))[order[known]])

    def weighed(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.float32)
        w = (1 + np.log(count)).astype(np.float32) * self.idf[at]
        return w / np.float32(max(float(np.sqrt(w @ w)), 1e-9))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (terms, weights) the k examples of greatest cosine (> 0), and their cosines, exactly."""
        out, n = [], len(self.labels)
        for lo in range(0, len(vectors), BATCH):
            some = vectors[lo : lo + BATCH]
            q = np.zeros((len(some), self.dense.shape[1]), np.float32)
            for i, (at, w) in enumerate(some):
                c = self.column[at]
                q[i, c[c >= 0]] = w[c >= 0]
            scores = q @ self.dense.T
            for i, (at, w) in enumerate(some):
                begin = self.rare_start[at]
                size = self.rare_start[at + 1] - begin
                where = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
                np.add.at(scores[i], self.rare_doc[where], self.rare_weight[where] * np.repeat(w, size))
            tops = scores.reshape(len(some), self.n_blocks, BLOCK).max(2)
            for i, (at, w) in enumerate(some):
                number = self.middle[at]
                score = self.finished(scores[i], tops[i], number[number >= 0].astype(np.int64), w[number >= 0], k, without[lo + i] if without else -1)
                best = self.first(score[:n], min(k, n)) if n else np.empty(0, np.int64)
                best = best[score[best] > 0]
                out.append((best, np.minimum(score[best], 1.0)))
        return out

    def finished(self, score: np.ndarray, top: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, without: int) -> np.ndarray:
        """Adds the other terms' postings, for the blocks that can matter; examples of the other blocks get -inf."""
        bound = top + w @ self.maxima[at] if len(at) else top
        if without >= 0:
            score[without] = -np.inf
        out = np.full(len(score), -np.inf, np.float32)
        order = self.left(np.arange(self.n_blocks), bound, score, k)  # weights are not negative: what is added so far is a bound from below
        if 4 * len(order) > self.n_blocks:  # whole postings are cheaper than many pieces of them
            self.add_whole(out, score, order, at, w)
            return out
        order = order[np.argsort(-bound[order], kind="stable")]
        some = max(-(-4 * k // BLOCK), self.n_blocks // 16)
        self.add(out, score, order[:some], at, w)
        self.add(out, score, self.left(order[some:], bound, out[self.rows(order[:some])], k), at, w)
        return out

    @staticmethod
    def left(blocks: np.ndarray, bound: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
        """Blocks that can hold one of the k nearest, as k examples have at least the k-th of `least`."""
        kth = np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else -np.inf
        return blocks[bound[blocks] * (1 + 1e-5) + 1e-6 >= kth]

    @staticmethod
    def rows(blocks: np.ndarray) -> np.ndarray:
        return (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()

    def add_whole(self, out: np.ndarray, score: np.ndarray, blocks: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        """Exact scores of the blocks from the terms' whole postings."""
        rows = self.rows(blocks)
        out[rows] = score[rows]
        if not len(at):
            return
        cut = self.__dict__.setdefault("_cut", {})
        lists = []
        for t in at.tolist():
            if t not in cut:
                lo, hi = self.start[t * self.n_blocks], self.start[(t + 1) * self.n_blocks]
                cut[t] = self.doc[lo:hi].astype(np.int64), self.weight[lo:hi]
            lists.append(cut[t])
        weights = np.concatenate([x[1] for x in lists]) * np.repeat(w, [len(x[0]) for x in lists])
        out += np.bincount(np.concatenate([x[0] for x in lists]), weights, len(out)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cut"}

    def add(self, out: np.ndarray, score: np.ndarray, blocks: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        """Exact scores of a few blocks, from the pieces of the postings that lie in them."""
        if not len(blocks):
            return
        rows = self.rows(blocks)
        out[rows] = score[rows]
        if not len(at):
            return
        cell = (at * self.n_blocks)[:, None] + blocks
        lo = self.start[cell]
        size = (self.start[cell + 1] - lo).ravel()
        there = np.flatnonzero(size)
        lo, size, owner = lo.ravel()[there], size[there], w[there // len(blocks)]
        where = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        out += np.bincount(self.doc[where], self.weight[where] * np.repeat(owner, size), len(out)).astype(np.float32)

    @staticmethod
    def first(score: np.ndarray, k: int) -> np.ndarray:
        """The k greatest, ties to the earlier."""
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.argsort(-score[some], kind="stable")[:k]]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], ks: tuple[int, ...] = (K,), without: list[int] | None = None) -> list[list[float] | None]:
        """Each vector's share of toxic votes among its k nearest, for each k; None without a neighbour."""
        out: list[list[float] | None] = []
        for near, cosine in self.nearest(vectors, max(ks), without):
            w = 1 / np.maximum(1 - cosine.astype(np.float64), 1e-3)
            last = np.minimum(ks, len(near)) - 1
            out.append((np.cumsum(w * self.labels[near])[last] / np.cumsum(w)[last]).tolist() if len(near) else None)
        return out

    def isotonic(self, votes: np.ndarray, labels: np.ndarray) -> tuple[list[float], list[float]]:
        """Isotonic regression of the labels on the votes (pooled adjacent violators); equal votes are in one pool."""
        pools: list[list[float]] = []  # sum of labels, number, sum of votes
        for i in np.lexsort((-labels, votes)):
            pools.append([labels[i], 1, votes[i]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        return [p[2] / p[1] for p in pools], [(p[0] + 0.5 * self.rate) / (p[1] + 0.5) for p in pools]

    def calibrate(self, votes: list[list[float]], labels: list[float], ks: tuple[int, ...] = NEIGHBOURS) -> None:
        """Takes the k, and its curve, of the least log loss over the votes (one for each k), ties to the lesser k."""
        y, best = np.array(labels, np.float64), np.inf
        for k, v in zip(ks, np.array(votes, np.float64).T, strict=True) if votes else ():
            curve = self.isotonic(v, y)
            p = np.clip(np.interp(v, *curve), 1e-9, 1 - 1e-9)
            loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
            if loss < best:
                best, self.k, self.curve = loss, k, curve

    def scores(self, texts: list[str]) -> list[float]:
        if not len(self.labels):
            return [self.rate] * len(texts)
        shares = self.votes([self.vector(terms(x)) for x in texts], (self.k,))
        return [self.rate if s is None else float(np.interp(s[0], *self.curve)) for s in shares]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = EXAMPLES) -> BlockMaxIndex:
    """An index of about `most` of the labelled ids, chosen by their hash, so the same on every run; 3 / 2 of it at the very most."""
    given = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    n = given.count()
    share = min(1.0, most / n) if n else 1.0
    chosen = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    if chosen.limit(most * 3 // 2 + 1).count() > most * 3 // 2:
        raise ValueError(f"more than {most * 3 // 2} examples")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf = [terms(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([hashed(c).view(np.int64) for c in tf], pa.list_(pa.int64())), pa.array([list(c.values()) for c in tf], pa.list_(pa.int32()))],
                names=["id", "label", "terms", "counts"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    counted = written(map_batches(rows, count, f"id {kind}, label int, terms array<bigint>, counts array<int>"), "toxicity-terms")
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # 16 bytes for each term of the examples
    vocabulary, met = df["term"].to_numpy().view(np.uint64), df["n"].to_numpy().astype(np.float64)
    order = np.argsort(vocabulary)
    vocabulary, met = vocabulary[order], met[order]
    sc = docs.sparkSession.sparkContext
    sent_terms = sc.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.searchsorted(sent_terms.value, np.array(ts, np.int64).view(np.uint64)).astype(np.int32) for ts in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(numbers, pa.list_(pa.int32())), batch.column("counts")], names=["id", "label", "terms", "counts"])

    got = map_batches(counted, number, f"id {kind}, label int, terms array<int>, counts array<int>").toArrow().sort_by("id").combine_chunks()
    lists = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy() if got.num_rows else np.empty(0, np.int32)
    index = BlockMaxIndex(vocabulary, met, got["label"].to_numpy(), np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64), flat("terms"), flat("counts"))
    del df, lists
    give_back()
    if not len(index.labels):
        return index
    sent = sc.broadcast(index)
    places = pa.table({"place": pa.array(range(got.num_rows), pa.int32()), "terms": got["terms"], "counts": got["counts"]})

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        place_of = np.argsort(own.order)
        for batch in batches:
            own_place = place_of[batch.column("place").to_numpy()]
            ats = [t.values.to_numpy().astype(np.int64) for t in batch.column("terms")]
            vectors = [(at, own.weighed(at, c.values.to_numpy())) for at, c in zip(ats, batch.column("counts"), strict=True)]
            votes = own.votes(vectors, NEIGHBOURS, own_place.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(votes, pa.list_(pa.float64()))], names=["place", "votes"])

    spread = docs.sparkSession.createDataFrame(places).repartition(sc.defaultParallelism * 4)
    votes = {r["place"]: r["votes"] for r in map_batches(spread, left_out, "place int, votes array<double>").collect()}
    given = [i for i in sorted(votes) if votes[i] is not None]
    label = got["label"].to_numpy()
    index.calibrate([votes[i] for i in given], [float(label[i]) for i in given])
    sent.destroy()
    sent_terms.destroy()
    return index


def classify(docs: DataFrame, index: Broadcast, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """[id, score, predicted] of every row's whole text; index: a BlockMaxIndex that was broadcast (bounded by EXAMPLES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = index.value.scores(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64())], names=["id", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_batches(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, index: Broadcast, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold; columns and rows are as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in index.value.scores(texts_of(batch, text_col))], pa.bool_()))

    return map_batches(docs, run, docs.schema)
