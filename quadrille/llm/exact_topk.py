"""Exact top-k inner product search by vector-approximation files.

Each component x becomes the integer floor(1024 x). The approximation of a vector is its cells: CELL_BITS
bits a component, cut from its dimension's range in the batch at hand. From the cells alone each (query,
vector) gets a lower and an upper bound of the score; the k-th best lower bound is what a vector must reach.
Exact vectors are read in the order of their upper bounds until the k-th result is certain.

Queries go in blocks of a bounded size, each against all rows where these lie. Every batch hands on at most
k rows a query, and a ranking by query merges them.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of equal length are compared; a query meets every row but those of its own id; ties go to the
smaller id; rows that repeat an id are each ranked, as candidates and as queries (each query row has its own
ranks from 1); with fewer candidates than k all are returned. Vectors too large for bounds in doubles (greatest
component times the root of the length at least 2**26, as integers) are scored one by one in whole numbers
without bound, which is slow but exact. Integers that 64 bits can't hold raise an error: of a component, and of
a score among the k best of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, written

SCALE = 1024
CELL_BITS = 6
#: Bytes of query vectors in a block, which is sent to all executors.
BLOCK_BYTES = 16_000_000


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """[id, v array<bigint>] of the vectors that take part."""
    v = F.col(vec_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def wide(x: np.ndarray) -> np.ndarray:
    """Whether each vector is too large for bounds in doubles; the product of any two that are not stays below 2**52."""
    return np.abs(x.astype(np.float64)).max(1) * np.sqrt(x.shape[1]) >= 2**26


def search_wide(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search_batch, by whole numbers without bound: for the few vectors whose scores doubles can't bound."""
    ends = np.iinfo(np.int64)
    if any(((v == ends.max) | (v == ends.min)).any() for v in (x, q)):
        raise ValueError("a component does not fit 64 bits")
    out: list[tuple[int, int, int]] = []
    rows = [list(map(int, r)) for r in x]
    for j, one in enumerate(q):
        own = list(map(int, one))
        scored = sorted((-sum(a * b for a, b in zip(own, r, strict=True)), int(ids[i]), i) for i, r in enumerate(rows) if ids[i] != q_ids[j])[:k]
        if any(not -(2**63) <= -s < 2**63 for s, _, _ in scored):
            raise ValueError("a score among the results does not fit 64 bits")
        out += [(j, i, -s) for s, _, i in scored]
    table = np.array(out, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def search_batch(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, row index, score) of each query's k best rows of one batch, all of one length; and how many exact vectors were read."""
    low, high = x.min(0), x.max(0)
    width = np.maximum((high - low) >> CELL_BITS, 0) + 1
    cells = ((x - low) // width).astype(np.uint8)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    floor = (cells * width + low).astype(np.float64) @ q.T.astype(np.float64)  # whole numbers below 2**53, so exact
    upper, lower = floor + (plus @ (width - 1)), floor + (minus @ (width - 1))
    own = ids[:, None] == q_ids[None, :]
    upper[own], lower[own] = -np.inf, -np.inf
    out_q, out_r, out_s, read = [], [], [], 0
    for j in range(len(q)):
        there = len(x) - int(own[:, j].sum())
        n = min(k, there)
        if not n:
            continue
        need = np.partition(lower[:, j], len(x) - n)[len(x) - n]
        maybe = np.flatnonzero(upper[:, j] >= need)
        maybe = maybe[upper[maybe, j] > -np.inf]
        maybe = maybe[np.argsort(-upper[maybe, j], kind="stable")]
        best_s, best_r, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(maybe):  # a few vectors at a time, as long as one of them can still reach the k-th
            if len(best_s) >= n and upper[maybe[at], j] < best_s[n - 1]:
                break
            some = maybe[at : at + max(n, 32)]
            at += len(some)
            s, r = np.concatenate([best_s, x[some] @ q[j]]), np.concatenate([best_r, some])
            order = np.lexsort((ids[r], -s))[:n]
            best_s, best_r = s[order], r[order]
        read += at
        out_q.append(np.full(len(best_r), j))
        out_r.append(best_r)
        out_s.append(best_s)
    empty = np.empty(0, np.int64)
    cat = lambda parts: np.concatenate(parts) if parts else empty
    return cat(out_q), cat(out_r), cat(out_s), read


def ways(x: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, Callable]]:
    """(rows, queries, search) that together meet every row with every query once."""
    big, big_q = wide(x), wide(q)
    every, rows, rest = np.arange(len(q)), np.flatnonzero(~big), np.flatnonzero(big)
    found = [(rows, np.flatnonzero(~big_q), search_batch), (rows, np.flatnonzero(big_q), search_wide), (rest, every, search_wide)]
    return [w for w in found if len(w[0]) and len(w[1])]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """[query_id, rank, id, score]: the k rows of vectors with the greatest inner product with each row of queries."""
    spark = vectors.sparkSession
    rows, asked = integers(vectors, id_col, vec_col), written(integers(queries, id_col, vec_col), "topk-queries")
    shape = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    n_blocks = max(1, -(-shape["n"] * shape["d"] * 8 // BLOCK_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    found = None
    for b in range(n_blocks):
        sent = asked.where(F.col("block") == b).select("id", "v").collect()  # BLOCK_BYTES of vectors, as the block is bounded
        by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in {len(r["v"]) for r in sent}:
            same = [r for r in sent if len(r["v"]) == d]
            keys = np.array([b << 32 | i for i, r in enumerate(sent) if len(r["v"]) == d], np.int64)  # a query row's own key: ids may repeat
            by_length[d] = keys, np.array([r["id"] for r in same], np.int64), np.array([r["v"] for r in same], np.int64)
        block = spark.sparkContext.broadcast(by_length)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
                lengths = np.diff(lists.offsets.to_numpy())
                flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
                for d in np.unique(lengths):
                    if int(d) not in block.value:
                        continue
                    keys, q_ids, q = block.value[int(d)]
                    at = np.flatnonzero(lengths == d)
                    x, own = flat[starts[at][:, None] + np.arange(d)], ids[at]
                    for rs, qs, search in ways(x, q):
                        for lo in range(0, len(qs), 512):
                            js = qs[lo : lo + 512]
                            qi, ri, s, *_ = search(own[rs], x[rs], q_ids[js], q[js], k)
                            yield pa.RecordBatch.from_arrays([pa.array(keys[js][qi]), pa.array(q_ids[js][qi]), pa.array(own[rs][ri]), pa.array(s)], names=["key", "query_id", "id", "score"])

        part = map_batches(rows, run, "key bigint, query_id bigint, id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
