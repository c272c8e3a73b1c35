"""URL filters: pattern rules behind an index of their rarest literal token.

A rule has a host and the start of a path. Every rule is filed under the one of its tokens (labels of the
host, parts of the path that are closed by a separator) that the fewest rules have; the tokens of a URL
fetch the rules filed under them, and only those run their regular expression. The longest rule that fits
decides; of equally long ones the first by text.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule; without a
fitting rule the verdict is the method's default, allow. An empty list of rules fits nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches

DEFAULT = "allow"
#: Rules that are sent with the tasks, at most (about 100 MB of them).
MOST_RULES = 1_000_000
SPLIT = re.compile(r"[^0-9A-Za-z]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host + ? + path; neither can hold a question mark."""
        return rf"(?:[^?]*\.)?{re.escape(self.host)}\?{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL which fits must have: whole labels of the host, and parts of the path before its last separator."""
        host = [("h", x) for x in self.host.split(".") if x]
        path = [("p", x) for x in SPLIT.split(self.path)[:-1] if x]
        return [f"{k}:{x}" for k, x in host + path]


class RuleIndex:
    def __init__(self, rules: list[Rule]) -> None:
        if len(rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules; split the list")
        often = Counter(t for r in rules for t in set(r.tokens))
        self.filed: dict[str, list[tuple[re.Pattern[str], Rule]]] = {}
        self.everywhere: list[tuple[re.Pattern[str], Rule]] = []  # rules without a literal token
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict)):
            rarest = min(r.tokens, key=lambda t: (often[t], t), default=None)
            (self.everywhere if rarest is None else self.filed.setdefault(rarest, [])).append((re.compile(r.pattern, re.DOTALL), r))

    def judge(self, host: str, path: str) -> Rule | None:
        if not host and not path:
            return None
        tokens = {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in SPLIT.split(path)}
        line = f"{host}?{path}"
        best = None
        for pattern, rule in [c for t in tokens for c in self.filed.get(t, ())] + self.everywhere:
            if (best is None or (-len(rule.text), rule.text, rule.verdict) < (-len(best.text), best.text, best.verdict)) and pattern.match(line):
                best = rule
        return best


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) columns: the host with A-Z lowered, and the path; both empty for null or without `://`."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("''")
    rest = F.when(there, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(rest)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """[id, host, path, rule, verdict] of every row. Only the id and the URL are read."""
    host, path = url_parts(F.col("url"))
    kept: list[RuleIndex] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(RuleIndex(rules))
        for batch in batches:
            got = [kept[0].judge(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array([r and r.text for r in got], pa.string()), pa.array([r.verdict if r else default for r in got], pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    return map_batches(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
