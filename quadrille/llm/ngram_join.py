"""N-gram Jaccard join with multiple global orders.

A text's set is its distinct 5-word shingles as 64-bit hashes. Two sets of similarity t share, under every
global order of the shingles, one of the first n - ceil(t n) + 1 of each. All orders have rarer shingles
first, by the number of sets that have them, and differ in the hash that decides among equals; a pair must
share prefix shingles under all of them, which the small prefixes decide before texts are read.

Most sets leave early: a shared sample of shingles, as large as the threshold needs, goes to their ranges and
back, and a set with more shingles of its own than a link allows links nothing. Only the rest is indexed.
Frequencies and filters bear on speed alone: they leave out nothing that links, at any size of the input.

Groups of copies never become pairs: equal sets are one class, known by the set's digest. Near copies are
first gathered: sets stand in small groups by their hub, the set that each shares most postings with, and
links within a group make components. Members of one component need no comparison among themselves, so
the second step compares exactly the candidates whose components still differ. Hot postings are compared in
blocks, each a key of its own, and a pair is met under its first common shingle. A block first names the
likeliest pairs of a set and of two components; where that leaves pairs out, it is done anew with the components
that these links make, until nothing is left out: all links between components are found, the components are exact.

Defined results: A-Z are lower-cased; with fewer than SHINGLE words the whole sequence is the one shingle;
null, empty and blank texts have no shingle, link with nothing and are a component of their own id. Rows
that repeat an id each have their own set; the component is the least id that is reached. Rows without an
id link like others; the component is the least id that is not null, and null where no row has one. Sets
are told apart by 128 bits of their digest: where the first 64 agree, the others count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, small, texts_of, written
from quadrille.operators.components import connected_components

SHINGLE = 5
PERCENT = 80
#: Sets of a posting's chunk, leaves of a hub's group, and sets that a partition of the index stands for.
CHUNK, LEAVES, SHARE = 2048, 256, 1024
#: Sets of a block and shingles that it asks for, at most; the owner of shingles that are sent for the sake of others.
BLOCK_SETS, BLOCK_TOKENS, NOBODY = 60_000, 2_000_000, 65_535
#: Rows of ids and digests that are sent to all tasks, at most; more are joined by a shuffle.
FEW = 500_000
#: Sets that one is held against to gather components, sets of a component that go on to the next turn, and turns, at most. All bear on speed only.
TRIES, PICKED, MOST_TURNS = 48, 16, 6
#: Pairs of a set, and of two components, that a block names as long as that finds links; first shingles that an entry has with it. Both bear on speed only.
LIKELIEST, BEFORE = 256, 32
#: Cells of a set by hash and by level, and the count from which a cell counts as without bound.
CELLS, LEVELS, FULL = 32, 16, 65_535
#: An odd factor for each place in a shingle.
PLACES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: The hashes of the global orders.
ORDERS = (0, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of a word's first places; later places are worked out where a word has them.
_PLACED = mixed(np.arange(64 * 256, dtype=np.uint64), 0x5851F42D4C957F2D)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text: the sum of random numbers for its bytes at their places gives each word's hash, five of these a shingle's."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(_LOWER), np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    longest = int((end - start).max())
    begun = np.zeros(len(raw), np.int64)
    begun[start[1:]] = np.diff(start)
    place = np.arange(len(raw)) - np.cumsum(begun) - start[0]  # of each byte in its word; blanks are summed by no word
    if longest <= 64:
        each = _PLACED[(np.clip(place, 0, 63) << 8) | raw]
    else:
        each = mixed((np.maximum(place, 0).astype(np.uint64) << np.uint64(8)) | raw, 0x5851F42D4C957F2D)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    word = mixed(total[end] - total[start] + (end - start).astype(np.uint64))
    n = min(SHINGLE, len(word))
    out = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        out += word[i : len(word) - n + 1 + i] * np.uint64(PLACES[i])
    return np.unique(mixed(out))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def set_id(s: np.ndarray, moved: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(sid, check) of a set: 64 bits each; sets whose sid is known to stand for several (moved) have one that both make."""
    whole = digest(s.tobytes())
    sid, check = (int.from_bytes(whole[i : i + 8], "little", signed=True) for i in (0, 8))
    return (sid ^ check if sid in moved else sid), check


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def asked_share(n: float) -> float:
    """Share of its shingles, the same ones in every set, that a set of n asks for; it never grows with n."""
    return min(1.0, 0.25 + n**-0.5)


def room(h_a: np.ndarray, h_b: np.ndarray) -> np.ndarray:
    """The most that sets can share: the lesser number of each cell, over the hash cells and over the levels."""
    least = np.minimum(h_a, h_b).astype(np.int64)
    least[least == FULL] = 1 << 40
    return np.minimum(least[:, :CELLS].sum(1), least[:, CELLS:].sum(1))


def firsts(key: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """Which places have one of the `most` largest shares of their key."""
    order = np.lexsort((-share, key))
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), np.diff(key[order]) != 0]))
    out = np.empty(len(key), bool)
    out[order] = np.arange(len(key)) - np.repeat(cut, np.diff(np.append(cut, len(key)))) < most
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the overlap makes a link."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def packed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct keys, and for each column the bytes of its values under each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    ends = np.append(cut, len(key))[1:]
    return key[cut], [[x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)] for x in (c[order] for c in columns)]


def unpacked(table: pa.Table, **kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x is not None), kind) for c, kind in kinds.items()]


def document_sets(slim: DataFrame, ranges: int) -> DataFrame:
    """One row of kind 0 for each row of slim: its columns but text, n, sid and check (null without shingles).

    And what asks how common shingles are, by blocks of up to BLOCK_SETS sets of a task: of kind 1, for each
    range of shingles, those that the block's sets ask for (x), each with its owner in the block (y, or NOBODY);
    of kind 2 the block's sets (x) and for each how many of its shingles have to be common (y): fewer prove that
    the set has more shingles of its own than any link allows.
    """
    keys = [c for c in slim.columns if c != "text"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [*keys, "kind", "n", "sid", "check", "block", "range", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.DataType] = []
        block, sets, asked, held = TaskContext.get().partitionId() << 32, [], [], 0

        def rows(kind: int, size: int, **found: list) -> pa.RecordBatch:
            known = {"kind": [kind] * size, **found}
            return pa.RecordBatch.from_arrays([*(pa.nulls(size, t) for t in own), *(pa.array(known.get(c, [None] * size), t) for c, t in zip(names[len(keys) :], kinds, strict=True))], names=names)

        def block_rows() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(asked)), np.array([len(s) for s, _ in asked]))
            token, tested = np.concatenate([s for s, _ in asked]), np.concatenate([t for _, t in asked])
            m = mixed(token, 1)
            part = ((m >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            found, (x, y) = packed(part, m.astype("<u4"), np.where(tested, owner, NOBODY).astype("<u2"))
            yield rows(1, len(found), block=[block] * len(found), range=found.tolist(), x=x, y=y)
            need = [int(t.sum()) - prefix_size(n) for (_, t), (_, n) in zip(asked, sets, strict=True)]
            yield rows(2, 1, block=[block], x=[np.array([s for s, _ in sets], "<i8").tobytes()], y=[np.array(need, "<i8").tobytes()])

        seen: set[int] = set()
        for batch in batches:
            own = [batch.column(k).type for k in keys]
            sizes, sids, checks = [], [], []
            for text in texts_of(batch):
                s = shingles(text)
                sid, check = set_id(s) if len(s) else (None, None)
                sizes.append(len(s))
                sids.append(sid)
                checks.append(check)
                if sid is None or (sid, check) in seen:
                    continue
                seen.add((sid, check))
                draw = (s >> np.uint64(40)).astype(np.float64) / (1 << 24)
                own_share, partners = asked_share(len(s)), asked_share(len(s) * 100 / PERCENT)
                sets.append((sid, len(s)))
                asked.append((s[draw < own_share], draw[draw < own_share] < partners))
                held += len(asked[-1][0])
                if held > BLOCK_TOKENS or len(sets) >= BLOCK_SETS:
                    yield from block_rows()
                    block, sets, asked, held = block + 1, [], [], 0
                    seen.clear()
            plain = rows(0, len(sizes), n=sizes, sid=sids, check=checks)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), *plain.columns[len(keys) :]], names=names)
        if sets:
            yield from block_rows()

    return map_batches(slim, run, ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys) + ", kind int, n bigint, sid bigint, check bigint, block bigint, range bigint, x binary, y binary")


def undecided(both: DataFrame) -> DataFrame:
    """[sid] of the sets that may have a link, from the blocks of document_sets: those with enough shingles that some other set asks for as well."""

    def common(t: pa.Table) -> pa.Table:
        size = [len(b) // 4 for b in t.column("x").to_pylist()]
        token, owner = unpacked(t, x="<u4", y="<u2")
        block = np.repeat(np.array(t.column("block").to_pylist(), np.int64), size)
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        shared = np.zeros(len(token), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        shared &= owner != NOBODY
        found, (owners,) = packed(block[shared], owner[shared])
        return pa.table({"block": pa.array(found, pa.int64()), "x": pa.nulls(len(found), pa.binary()), "y": pa.array(owners, pa.binary())})

    def judged(t: pa.Table) -> pa.Table:
        sets = t.filter(pc.is_valid(t.column("x")))
        sid, need = unpacked(sets, x="<i8", y="<i8")
        (owner,) = unpacked(t.filter(pc.is_null(t.column("x"))), y="<u2")
        return pa.table({"sid": pa.array(sid[np.bincount(owner, minlength=len(sid)) > need], pa.int64())})

    answers = both.where("kind = 1").select("range", "block", "x", "y").groupBy("range").applyInArrow(common, "block bigint, x binary, y binary")
    return answers.unionByName(both.where("kind = 2").select("block", "x", "y")).groupBy("block").applyInArrow(judged, "sid bigint")


def prefixes(texts: DataFrame, n_sets: int) -> DataFrame:
    """[sid, n, cells, p0, p1, ...] of the sets that have a common shingle in their prefix: cells count the common shingles by hash and by level, p0, p1, ... are the common shingles of the prefix under each global order.

    A shingle's level is the logarithm of the number of sets that have it, worked out by ranges of the shingles
    and sent back to the sets; every order has rarer levels first, and then goes by a hash of its own. A shingle
    of one set only stands before all others and links nothing, so it takes a place in the prefix and no more.
    """
    parts = -(-n_sets // SHARE) + 15

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(map(shingles, texts_of(batch)))
            sid = np.repeat(np.array(batch.column("sid").to_pylist(), "<i8"), np.array(list(map(len, sets)), np.int64))
            m = mixed(np.concatenate([*sets, np.empty(0, np.uint64)]), 1)
            part = ((m >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            found, (x, y) = packed(part.astype(np.int64), m.astype("<u4"), sid)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["part", "x", "y"])

    def levels(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        token, sid = unpacked(t, x="<u4", y="<i8")
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])])  # a set whose id is repeated
        token, sid = token[new], sid[new]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        level = np.repeat(np.ceil(np.log2(size)), size).astype("u1")
        many = level > 0
        found, (x, y, z) = packed(sid[many] % parts, sid[many], (np.int64(part) << 32) | token[many], level[many])
        return pa.table({"part": pa.array(found, pa.int64()), "x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary()), "z": pa.array(z, pa.binary()), "sid": pa.nulls(len(found), pa.int64()), "n": pa.nulls(len(found), pa.int64())})

    names = [f"p{k}" for k in range(len(ORDERS))]

    def prefix(t: pa.Table) -> pa.Table:
        sizes = dict(zip(t.column("sid").to_pylist(), t.column("n").to_pylist(), strict=True))
        sid, token, level = unpacked(t, x="<i8", y="<i8", z="u1")
        order = np.argsort(sid, kind="stable")
        sid, token, level = sid[order], token[order], level[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(sid)), bool), sid[1:] != sid[:-1]]))
        out: list[tuple] = []
        for a, b in zip(start.tolist(), np.append(start, len(sid))[1:].tolist(), strict=True):
            n, own, at = sizes[int(sid[a])], token[a:b], level[a:b]
            p = prefix_size(n) - (n - len(own))
            if p > 0:
                cells = np.concatenate([np.bincount(mixed(own.astype(np.uint64)).astype(np.int64) % CELLS, minlength=CELLS), np.bincount(np.minimum(at, LEVELS - 1), minlength=LEVELS)])
                firsts = [own[np.lexsort((mixed(own.astype(np.uint64), salt), at))[:p]] for salt in ORDERS]
                out.append((int(sid[a]), n, np.minimum(cells, FULL).astype("<u2").tobytes(), *firsts))
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * len(ORDERS)]
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(["sid", "n", "cells", *names], kinds, strict=True))})

    common = map_batches(texts.select("sid", "text"), spread, "part bigint, x binary, y binary").groupBy("part").applyInArrow(levels, "part bigint, x binary, y binary, z binary, sid bigint, n bigint")
    sets = texts.select(F.pmod("sid", F.lit(parts)).alias("part"), *[F.lit(None).cast("binary").alias(c) for c in "xyz"], "sid", "n")
    return common.unionByName(sets).groupBy("part").applyInArrow(prefix, "sid bigint, n bigint, cells binary, " + ", ".join(f"{p} array<bigint>" for p in names))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """[a, b]: the pairs (hub a, leaf b) that link. A hub's leaves are salted into groups of about LEAVES, each with a copy of the hub."""
    pairs = written(pairs, "pairs")
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).cast("long").alias("s"))
    leaf = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), "s").alias("g"), F.col("b").alias("sid"), F.lit(1).alias("leaf"))
    hub = spread.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("g"), F.col("a").alias("sid"), F.lit(0).alias("leaf"))
    n = pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    wanted = written(leaf.unionByName(hub), "wanted")
    rows = texts.select("sid", "text").join(small(wanted, FEW), "sid").repartition(int(n), "a", "g").sortWithinPartitions("a", "g", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, g, sid, leaf, text in zip(*(batch.column(c).to_pylist() for c in ("a", "g", "sid", "leaf", "text")), strict=True):
                s = shingles(text)
                if not leaf:
                    at, own = (a, g), s
                elif at == (a, g) and alike(own, s):
                    out.append((a, sid))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return map_batches(rows.select("a", "g", "sid", "leaf", "text"), run, "a bigint, b bigint")


def hubs(entries: DataFrame) -> DataFrame:
    """[hub, sid]: each set beside the hub (the least set of a posting) that it shares most postings with, and each hub beside itself."""
    least = entries.groupBy("token").agg(F.min("sid").alias("hub"))
    each = entries.join(least, "token").where("hub <> sid")
    often = each.groupBy("sid", "hub").agg(F.count("*").alias("n"))
    best = often.groupBy("sid").agg(F.max(F.struct("n", "hub")).alias("m")).select(F.col("m.hub").alias("hub"), "sid")
    return best.unionByName(best.select("hub", F.col("hub").alias("sid")).distinct())


def near_links(members: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """[a, b]: connected sets of a hub, as (least, other), found in groups of about LEAVES: each set is held against up to TRIES sets of the components so far."""
    spread = members.groupBy("hub").agg(F.ceil(F.count("*") / LEAVES).cast("long").alias("s"))
    placed = written(members.join(spread, "hub").select("hub", F.pmod(F.xxhash64("sid", F.lit(turn)), "s").alias("g"), "sid"), "members")
    rows = texts.select("sid", "text").join(small(placed, FEW), "sid")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "hub", "g").sortWithinPartitions("hub", "g", "sid").select("hub", "g", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(parts: list) -> list[tuple[int, int]]:
            return [(root, sid) for part in parts if len(part) > 1 for root in [min(x for x, _ in part)] for sid, _ in part if sid != root]

        def made(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

        at, parts = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for hub, g, sid, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "g", "sid", "text")), strict=True):
                if at != (hub, g):
                    out += stars(parts)
                    at, parts = (hub, g), []
                own, tries, met = shingles(text), 0, []
                for part in sorted(parts, key=len, reverse=True):
                    for _, s in part[-(TRIES // 2) :]:
                        if tries >= TRIES:
                            break
                        tries += 1
                        if alike(own, s):
                            met.append(part)
                            break
                parts = [p for p in parts if not any(p is m for m in met)] + [[x for m in met for x in m] + [(sid, own)]]
            yield made(out)
        yield made(stars(parts))

    return map_batches(rows, run, "a bigint, b bigint")


def gathered(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """[node, component]: sets that are surely connected, so that large groups of near copies need no comparison of all their pairs.

    After the first turn a hub keeps PICKED sets of each component, and they are grouped anew, as long as a hub has
    several groups and that finds links. Links that this misses are found by open_pairs.
    """
    every = written(hubs(entries), "hubs")
    members, links, labels = every, None, None
    for turn in range(MOST_TURNS):
        found = written(near_links(members, texts, turn), "links")
        links = found if links is None else links.unionByName(found)
        labels = written(connected_components(links), "labels")
        several = members.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > LEAVES).select("hub")
        if several.isEmpty() or turn and found.isEmpty():
            break
        named = every.join(several, "hub", "left_semi").join(labels, F.col("sid") == F.col("node"), "left").select("hub", "sid", F.coalesce("component", "sid").alias("label"))
        order = Window.partitionBy("hub", "label").orderBy(F.xxhash64("sid", F.lit(turn)))
        members = written(named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PICKED).select("hub", "sid"), "hubs")
    return labels


def postings(index: DataFrame, labels: DataFrame) -> DataFrame:
    """[token, sid, n, label, cells, before, again]: the sets of each prefix shingle under the first order, with their component (labels: [node, component]) and the first BEFORE of their shingles before this one."""
    known = index.join(labels, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "sid"))
    each = known.select(F.posexplode("p0").alias("at", "token"), "sid", "n", "label", "cells", "p0")
    return written(each.select("token", "sid", "n", "label", "cells", F.slice("p0", F.lit(1), F.least("at", F.lit(BEFORE))).alias("before"), F.lit(True).alias("again")), "entries")


def renewed(entries: DataFrame, labels: DataFrame, left: DataFrame) -> DataFrame:
    """The postings that hold a set of left ([sid]), with the components as they are now; again marks the sets of left."""
    left = written(left.distinct(), "left")
    tokens = written(entries.join(small(left, FEW), "sid", "left_semi").select("token").distinct(), "tokens")
    own = entries.join(small(tokens, FEW), "token", "left_semi").drop("label", "again")
    named = own.join(labels, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "sid")).drop("node", "component")
    marked = named.join(small(left.withColumn("again", F.lit(True)), FEW), "sid", "left")
    return written(marked.select("token", "sid", "n", "label", "cells", "before", F.coalesce("again", F.lit(False)).alias("again")), "entries")


def candidates(entries: DataFrame, most: int | None = None) -> DataFrame:
    """[a, b]: pairs of a posting whose components differ, one set at least marked again, and whose cells leave room.

    Each posting is compared in blocks of CHUNK sets by CHUNK, each block a key of its own. A pair is met in one
    posting only, as long as its first common shingle is one of the first BEFORE of a set, else in several.
    most: likeliest pairs of a set and of two components for each 256 sets of a block; sets that have more are
    given as a = b. None: all.
    """
    sizes = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / CHUNK).cast("int").alias("k")).where("lo <> hi").select("token", "k")
    mine = entries.join(sizes, "token").withColumn("x", F.pmod(F.xxhash64("sid"), "k").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = mine.select("token", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "sid", "n", "label", "cells", "before", "again")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (_, i, j), chunk = rows[0][:3], np.array([r[3] for r in rows])
        sid, n, label = (np.array([r[c] for r in rows], np.int64) for c in (4, 5, 6))
        cells = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), -1)
        again, width = np.array([r[9] for r in rows]), max(len(r[8]) for r in rows)
        before = np.array([r[8] + [-1] * (width - len(r[8])) for r in rows], np.int64).reshape(len(rows), width)

        def fitting(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            share = room(cells[p], cells[q]) / (n[p] + n[q])
            fit = (100 + PERCENT) * share >= PERCENT - 1e-6
            p, q, share = p[fit], q[fit], share[fit]
            met = [np.empty(0, bool)]
            for at in range(0, len(p), 2_000):
                own, other = before[p[at : at + 2_000], :, None], before[q[at : at + 2_000], None, :]
                met.append(((own == other) & (own >= 0)).any((1, 2)))
            new = ~np.concatenate(met)
            return p[new], q[new], share[new]

        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        for lo in range(0, len(left), 256):
            part = left[lo : lo + 256]
            p, q = np.nonzero((label[part][:, None] != label[right]) & (again[part][:, None] | again[right]) & ((part[:, None] < right) if i == j else True))
            p, q = part[p], right[q]
            fit = 100 * np.minimum(n[p], n[q]) >= PERCENT * np.maximum(n[p], n[q])
            p, q = p[fit], q[fit]
            found = [fitting(p[at : at + 50_000], q[at : at + 50_000]) for at in range(0, len(p), 50_000)]
            if not sum(len(x) for x, _, _ in found):
                continue
            p, q, share = map(np.concatenate, zip(*found, strict=True))
            more = p[:0]
            if most is not None and len(p) > most:
                name = np.unique(label, return_inverse=True)[1]
                likely = firsts(p, share, most)
                likely[likely] = firsts((np.minimum(name[p], name[q]) * len(rows) + np.maximum(name[p], name[q]))[likely], share[likely], most)
                p, q, more = p[likely], q[likely], np.unique(p[~likely])
            a, b = sid[np.append(p, more)], sid[np.append(q, more)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of one block, twice CHUNK or so
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    yield from compared(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from compared(rows)

    return map_batches(blocks, run, "a bigint, b bigint")


def under_all(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """[a, b]: the distinct pairs that share a prefix shingle under the further orders as well, by the pairs' own prefixes, before any text is read."""
    further = [f"p{k}" for k in range(1, len(ORDERS))]
    pairs = pairs.distinct()
    for side in "ab":
        pairs = pairs.join(index.select(F.col("sid").alias(side), *[F.col(p).alias(f"{p}{side}") for p in further]), side)
    for p in further:
        pairs = pairs.where(F.arrays_overlap(f"{p}a", f"{p}b"))
    return pairs.select("a", "b")


def open_pairs(index: DataFrame, labels: DataFrame) -> DataFrame:
    """[a, b]: distinct pairs that share a prefix shingle under every order, whose components (labels: [node, component]) differ, and whose cells leave room."""
    return under_all(candidates(postings(index, labels)), index)


def open_links(index: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """[a, b]: links that together with labels ([node, component]) make the components.

    Two components need one link, so the likeliest pairs are compared first, and again with the components that
    their links make, for the sets that have more; as soon as a turn finds no link, or after MOST_TURNS, all pairs
    that are left are compared.
    """
    entries, links, turn = postings(index, labels), None, 0
    while True:
        met = written(candidates(entries, LIKELIEST if turn < MOST_TURNS else None), "candidates")
        found = verified(under_all(met.where("a <> b"), index), texts)
        left = met.where("a = b").select(F.col("a").alias("sid"))
        if left.isEmpty():
            return found if links is None else links.unionByName(found)
        found = written(found, "links")
        links, turn = found if links is None else links.unionByName(found), MOST_TURNS if found.isEmpty() else turn + 1
        labels = written(connected_components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(found)), "labels")
        entries = renewed(entries, labels, left)


def class_texts(slim: DataFrame, wanted: DataFrame, moved: frozenset[int]) -> DataFrame:
    """[sid, n, text] of the classes in wanted ([sid, rep]); an id that is repeated may have other texts as well, which are left out."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(map(shingles, texts_of(batch)))
            own = pa.array([len(s) > 0 and set_id(s, moved)[0] == sid for s, sid in zip(sets, batch.column("sid").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(list(map(len, sets)), pa.int64()), batch.column("text")], names=["sid", "n", "text"]).filter(own)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids = pa.array([set_id(s, moved)[0] if len(s) else None for s in map(shingles, texts_of(batch))], pa.int64())
            yield pa.RecordBatch.from_arrays([sids, batch.column("text")], names=["sid", "text"])

    named, nameless = wanted.where("rep is not null"), wanted.where("rep is null")
    found = slim.join(small(named, FEW), F.col("id") == F.col("rep")).select("sid", "text")
    if not nameless.isEmpty():  # sets that only rows without an id hold: a text of each
        texts = map_batches(slim.where("id is null").select("text"), held, "sid bigint, text string")
        found = found.unionByName(texts.join(nameless, "sid", "left_semi").groupBy("sid").agg(F.min("text").alias("text")))
    return map_batches(found, own, "sid bigint, n bigint, text string")


def labelled(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of [id, text, ...]: [id, ..., n, sid] of every row, and [sid, rep, label] of every set, label being one set of its component."""
    both = written(document_sets(slim, -(-slim.count() // SHARE) + 15), "sets")
    sets = both.where("kind = 0").drop("kind", "block", "range", "x", "y")
    met = written(sets.where("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi")), "classes")
    moved = frozenset(r["sid"] for r in met.where("lo <> hi").select("sid").collect())  # of s sets s**2 / 2**65 are to be expected
    classes, maybe = met.select("sid", "rep"), undecided(both).distinct()
    if moved:
        sets = sets.withColumn("sid", F.when(F.col("sid").isin(*moved), F.col("sid").bitwiseXOR(F.col("check"))).otherwise(F.col("sid")))
        classes = written(sets.where("n > 0").groupBy("sid").agg(F.min("id").alias("rep")), "classes")
        again = sets.where(F.col("sid").bitwiseXOR(F.col("check")).isin(*moved)).select("sid").distinct()
        maybe = maybe.where(~F.col("sid").isin(*moved)).unionByName(again)
    sets = sets.drop("check")
    wanted = written(maybe.join(classes, "sid"), "wanted")
    texts = written(class_texts(slim, wanted, moved), "texts")
    index = written(prefixes(texts, wanted.count()), "index")
    sure = gathered(index.select(F.explode("p0").alias("token"), "sid"), texts)
    rest = open_links(index, sure, texts)
    labels = connected_components(sure.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest))
    return sets, classes.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "rep", F.coalesce("component", "sid").alias("label"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id, n_shingles, component_id] of every row."""
    sets, least = labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    names = least.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(least.join(names, "label").select("sid", "component_id"), "components")
    out = sets.join(named, "sid", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each component, and all rows without a shingle.

    Rows are known by id and text's digest, as an id may stand on several texts. The least id stays (null after
    all others), of its texts the one with the least digest, and of rows alike in both the least by all columns.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    sets, least = labelled(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).alias("text")))
    rows = written(sets.where("n > 0").join(least.select("sid", "label"), "sid").select("id", "digest", "label"), "rows")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")).alias("f"), F.count("*").alias("k")).where("k > 1")
    judged = written(rows.join(first, "label").select("id", "digest", (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("digest") == F.col("f.digest"))).alias("stays")), "judged")
    gone = written(judged.where("not stays").select("id", "digest").distinct(), "gone")
    again = written(judged.where("stays").groupBy("id", "digest").agg(F.count("*").alias("k")).where("k > 1").select("id", "digest"), "again")

    def matched(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
        return docs.join(small(keys, FEW), F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), how)

    if again.isEmpty():
        return matched(gone, "left_anti")
    one = matched(again, "left_semi").groupBy(F.col(id_col).alias("__id"), digest.alias("__digest")).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return matched(gone.unionByName(again), "left_anti").unionByName(one)
