"""Byte-level BPE encoding by speculation, and decoding.

A batch's new words are cut greedily into longest pieces (the speculation). A cut is what merging gives
exactly if every piece stays as it is beside its neighbour, so all adjacent pairs of the batch are checked
at once against a table of pairs that stay apart; pairs not met before are put to the merge rules first.
Only words with a pair that fails are merged for themselves.

Defined results: null is empty and has no ids; a special token's string inside a text becomes its id, as
the library's default has it, and is decoded to its string; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, texts_of

#: Fixed value: the pattern by which byte-level BPE cuts texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a Python worker keeps between texts; at this number they are dropped and gathered anew.
KEPT = 500_000


def byte_letters() -> dict[str, int]:
    """The letter by which such vocabularies write each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda piece: bytes(letters[c] for c in piece)
        self.ids = {raw(piece): i for piece, i in spec["model"]["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.rank = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for piece, i in self.ids.items():
            self.bytes[i] = piece
        for piece, i in self.special.items():
            self.bytes[i] = piece.encode()
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words: dict[str, np.ndarray] = {}
        self.known_made: dict[int, bool] = {}
        #: Pairs that were put to the merge rules, as left * 2**32 + right, sorted; and whether they stay apart.
        self.pairs, self.apart = np.empty(0, np.int64), np.empty(0, bool)
        self.counts = {"words": 0, "failed": 0}

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first. A heap over a linked list, so long words take n log n."""
        ids, rank = [self.single[b] for b in piece], self.rank
        n = len(ids)
        if n < 24:
            while n > 1:
                best, at = None, 0
                for i in range(n - 1):
                    r = rank.get((ids[i], ids[i + 1]))
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
                n -= 1
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, to, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = to, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if r := rank.get((to, ids[after[i]])):
                    heapq.heappush(heap, (*r, i, to, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], to))):
                heapq.heappush(heap, (*r, h, ids[h], to))
        return [x for x in ids if x >= 0]

    def greedy(self, piece: bytes) -> list[int]:
        out, at, ids, n = [], 0, self.ids, len(piece)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := ids.get(piece[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def stay(self, keys: np.ndarray) -> np.ndarray:
        """For pairs of ids (left * 2**32 + right): whether merging leaves them as they are."""
        new = np.setdiff1d(keys, self.pairs)
        if len(new):
            ok = np.fromiter((self.merged(self.bytes[k >> 32] + self.bytes[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()), bool, len(new))
            pairs, apart = np.concatenate([self.pairs, new]), np.concatenate([self.apart, ok])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.apart = pairs[order], apart[order]
        return self.apart[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> None:
        """Speculates on new words, checks all their adjacent pairs at once, and merges those that fail."""
        raw = [w.encode() for w in words]
        cuts = [self.greedy(r) for r in raw]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inner = owner[:-1] == owner[1:]
        bad = np.zeros(len(cuts), bool)
        if len(flat) > 1 and inner.any():
            bad[owner[:-1][inner][~self.stay(((flat[:-1] << 32) | flat[1:])[inner])]] = True
        for i in np.flatnonzero(sizes == 1):  # a piece that the merges themselves never make
            bad[i] |= len(raw[i]) > 1 and not self.made(cuts[i][0])
        for i in np.flatnonzero(bad):
            cuts[i] = self.merged(raw[i])
        self.counts["words"] += len(words)
        self.counts["failed"] += int(bad.sum())
        for w, c in zip(words, cuts, strict=True):
            self.words[w] = np.array(c, "<u4").tobytes()

    def made(self, i: int) -> bool:
        if i not in self.known_made:
            self.known_made[i] = self.merged(self.bytes[i]) == [i]
        return self.known_made[i]

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text, and the ids of special tokens between them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str | int] = []
        for part in self.cut(text):
            out += [self.special[part]] if part in self.special else self.find(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > KEPT:
            self.words.clear()
        if len(self.pairs) > 4 * KEPT:
            self.pairs, self.apart = np.empty(0, np.int64), np.empty(0, bool)
        cut = list(map(self.pieces, texts))
        new = [w for w in set(chain.from_iterable(cut)).difference(self.words) if isinstance(w, str)]
        if new:
            self.learn(new)
        known = self.words
        for i in self.special.values():
            known[i] = np.array([i], "<u4").tobytes()
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def chunks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Spans of a batch with about so many characters each, one text at least."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if texts:
        yield start, len(texts)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """[id, ids binary, decoded string] of every row; with full=False their digests instead: [id, n_tokens, ids_sha256, decoded_sha256]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SpeculativeBPE(path)  # for this task only: a worker that goes on to other stages keeps nothing of it
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in chunks(texts):
                ids = own.encode_batch(texts[a:b])
                back = map(own.decode, ids)
                key = batch.column("id").slice(a, b - a)
                if full:
                    yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary()), pa.array(list(back), pa.string())], names=["id", "ids", "decoded"])
                else:
                    yield pa.RecordBatch.from_arrays([key, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(list(map(sha, ids))), pa.array([sha(x.encode()) for x in back])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = map_batches(slim, run, f"id {kind}, ids binary, decoded string" if full else f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
