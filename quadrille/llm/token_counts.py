"""Token counts by prefix dynamic programming.

For a BPE vocabulary whose merges are ordered by one score per piece, the encoding of a prefix is the
encoding of a shorter prefix plus one piece: the one piece that ends there and stays apart from, and is
not re-cut by, the piece before it. So one table per text holds, for every prefix, its last piece and
its exact number of tokens. Pieces never run on over the start of a new word (a space mark after a
letter), so the table is kept word by word, and words are shared between texts.

Defined results: null and empty text have 0 tokens; repeated rows give repeated rows; special strings
inside a text are ordinary text, as the library takes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, texts_of

MARK = "▁"
#: A word of the escaped text: its space marks, then all up to the next mark.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words and prefixes that a Python worker keeps between texts; at this number they are dropped and gathered anew.
KEPT = 400_000
#: Words of more characters get a table of their own.
LONG = 64


class PrefixCounter:
    """Exact token counts of all prefixes under a sentencepiece BPE model with the identity normaliser."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.prefixes: dict[str, tuple[int, str]] = {"": (0, "")}

    def merged(self, word: str) -> list[str]:
        """The pieces of a short string by merging itself; used on pairs of pieces only."""
        parts, score = list(word), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        """Whether merging left+right gives just these two pieces."""
        got = self.apart.get((left, right))
        if got is None:
            got = self.apart[left, right] = self.merged(left + right) == [left, right]
        return got

    def prefix(self, text: str) -> tuple[int, str]:
        """(tokens, last piece) of a prefix of a word; shorter prefixes are looked up or worked out on the way."""
        found = self.prefixes.get(text)
        if found is not None:
            return found
        score, n = self.score, len(text)
        for size in range(min(n, self.longest), 0, -1):
            piece = text[n - size :]
            if size > 1 and piece not in score:
                continue
            if size == n:
                if size > 1 and self.merged(piece) != [piece]:
                    continue
                found = (self.weight(piece), piece)
                break
            tokens, last = self.prefix(text[: n - size])
            if self.stays(last, piece):
                found = (tokens + self.weight(piece), piece)
                break
        self.prefixes[text] = found
        return found

    def forward(self, word: str) -> list[int]:
        """Tokens of word[:i] for every i, first to last; for long words, whose prefixes are not worth keeping."""
        score, n = self.score, len(word)
        tokens, last = [0] * (n + 1), [""] * (n + 1)
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                piece = word[end - size : end]
                if size > 1 and piece not in score:
                    continue
                if (size == 1 or self.merged(piece) == [piece]) if size == end else self.stays(last[end - size], piece):
                    tokens[end], last[end] = tokens[end - size] + self.weight(piece), piece
                    break
        return tokens

    def weight(self, piece: str) -> int:
        """A character without a piece of its own falls back to its bytes."""
        return 1 if piece in self.score else len(piece.encode())

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > KEPT:
                self.words.clear()
            if len(self.prefixes) > KEPT:
                self.prefixes = {"": (0, "")}
            if len(self.apart) > 4 * KEPT:
                self.apart.clear()
            if len(word) > LONG:
                return self.forward(word)[-1]
            got = self.words[word] = self.prefix(word)[0]
        return got

    @staticmethod
    def escaped(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def count(self, text: str) -> int:
        """Tokens of a whole text: its last prefix."""
        return sum(map(self.word, WORD.findall(self.escaped(text))))

    def table(self, text: str) -> list[int]:
        """The stored table: tokens of text[:i] for every i from 0 to its length."""
        out, before, marks = [0] * (len(text) + 1), 0, self.escaped(text)
        for m in WORD.finditer(marks):
            word = m[0]
            tokens = self.forward(word)
            for i in range(1, len(word) + 1):
                at = m.start() + i - 1  # characters of the text so far, without the mark put before it
                if at >= 1:
                    out[at] = before + tokens[i]
            before += tokens[-1]
        return out

    def fits(self, text: str, budget: int) -> int:
        """Length of the longest prefix that has at most so many tokens; no re-encoding."""
        counts = self.table(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """[id, n_bytes, n_tokens, over_limit] of every row's whole text; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            n = [count(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = map_batches(slim, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def prefix_tables(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id, prefix_tokens array<int>]: element i (from 0) is the number of tokens of the first i characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            for i, text in enumerate(texts_of(batch)):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.array([own.table(text)], pa.list_(pa.int32()))], names=["id", "prefix_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, prefix_tokens array<int>").withColumnRenamed("id", id_col)
