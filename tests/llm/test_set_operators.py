"""Exact dedup, mixing, n-gram join, top-k and the pipeline, against brute force."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import exact_dedup, exact_topk, mixing, ngram_join, queries
from quadrille.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, mix string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


EDGE = [(1, "same text", "a"), (2, "same text", "a"), (2, "same text", "a"), (3, None, "b"), (4, "", None), (5, "Other words here", None), (6, "x " * 5000, "a"), (None, "lone", "b")]


def test_dedup_edges(spark):
    got = exact_dedup.duplicates(frame(spark, EDGE)).collect()
    want = {1: (2, 3, False), 2: (2, 3, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True)}
    assert len(got) == len(EDGE)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    kept = exact_dedup.keep_one(frame(spark, EDGE))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "5", "6"]  # one of the two rows of id 2
    assert exact_dedup.duplicates(frame(spark, EDGE).limit(0)).count() == 0


def test_dedup_stage_keeps_texts_without_any_id(spark):
    rows = [*EDGE, (None, "same text", "b"), (None, None, "b"), (None, "alone too", "c")]
    kept = corpus_pipeline.drop_copies(spark, frame(spark, rows), SF).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in kept) == [("2", "same text"), ("4", ""), ("5", "Other wor"), ("6", "x x x x x"), ("None", "alone too"), ("None", "lone")]
    op5 = {r["text_sha256"]: r for r in exact_dedup.duplicates(frame(spark, rows)).withColumnRenamed("digest", "text_sha256").where("keep_id is null").collect()}
    assert len(op5) == 2 and all(r["kept"] is None and r["group_size"] == 1 for r in op5.values())


def test_dedup_goes_on_from_its_state(spark):
    state = fresh_path(spark, "state")
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(3, "a")])):
        led = exact_dedup.ledger(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        led.write.mode("append").parquet(f"{state}/in")
        got = exact_dedup.absorb(spark.readStream.schema(led.schema).parquet(f"{state}/in"), state)
    assert sorted((r["keep_id"], r["group_size"]) for r in got.collect()) == [(2, 1), (3, 2)]


def test_mixing_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40]), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(7, "dup dup", "b")] * 2
    got = mixing.mix(frame(spark, rows)).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, total, open_ = {}, float(sum(size.values())), set(names)
    while True:
        rate = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] >= 3 * size[s]}
        if not full:
            break
        target |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    target |= {s: rate * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    for s in names:
        assert 0 <= target[s] - taken[s] < 4, s
    again = mixing.mix(frame(spark, rows).repartition(5)).select("doc_id", "mix.taken").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_dealt_words(spark):
    rows = [(i, f" a{i}  b\nc\td ", s) for i, s in enumerate(["a"] * 9 + ["b"] * 2)]
    mixed = {r["doc_id"]: r["mix"]["taken"] for r in mixing.mix(frame(spark, rows)).collect()}
    words = defaultdict(int)
    for r in mixing.dealt(frame(spark, rows)).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert dict(words) == {i: n for i, n in mixed.items() if n}


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, EDGE)).count() == len(EDGE)
    assert mixing.dealt(frame(spark, [(1, None, "a"), (2, "", "a")])).count() == 0


def brute_components(rows):
    def shingle_set(t):
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def near_copies(seed, n=40):
    rnd = random.Random(seed)
    rows, k = [], 0
    common = [f"c{i}" for i in range(60)]
    for _ in range(n):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 8, 40, 120]))] + (common if rnd.random() < 0.4 else [])
        for _ in range(rnd.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
            rows.append((k, (" " if rnd.random() < 0.5 else "\n").join(copy).upper() if rnd.random() < 0.3 else " ".join(copy), "s"))
            k += 1
    return rows + [(k, None, "s"), (k + 1, "", "s"), (k + 2, " \n", "s"), (k + 3, "one", "s"), (k + 4, "One", "s")]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAVES", 6)
    rows = near_copies(seed)
    got = ngram_join.components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_chunks_of_postings(spark, monkeypatch):
    """Pairs across the chunks of a posting are found as well, also if nothing is gathered before."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rows = near_copies(4, 80)
    sets = {ngram_join.set_id(s)[0]: (s, t) for _, t, _ in rows if len(s := ngram_join.shingles(t))}
    texts = spark.createDataFrame([(k, len(s), t) for k, (s, t) in sets.items()], "sid long, n long, text string")
    index = ngram_join.prefixes(texts, len(sets)).cache()
    labels = spark.createDataFrame([], "node long, component long")
    got = {tuple(r) for r in ngram_join.open_pairs(index, labels).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and ngram_join.alike(sets[a][0], sets[b][0])}
    assert len(want) > 10 and want <= got
    index.unpersist()


def test_large_groups_make_few_pairs(spark, monkeypatch):
    """The blocks make rows in proportion to a group's members, not to their square, also if nothing is gathered before; the components are exact."""
    monkeypatch.setattr(ngram_join, "LIKELIEST", 4, raising=False)
    monkeypatch.setattr(ngram_join, "gathered", lambda entries, texts: spark.createDataFrame([], "node long, component long"))
    real, made = ngram_join.map_batches, []

    def counted(df, fn, schema):
        out = real(df, fn, schema)
        if "token" in df.columns:
            out = out.cache()
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "map_batches", counted)
    rnd, words, rows = random.Random(7), [f"w{i}" for i in range(100)], []
    for k in range(150):
        copy = list(words)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            copy[rnd.randrange(100)] = f"e{k}x{rnd.randrange(100)}"
        rows.append((k, " ".join(copy), "s"))
    rows += [(1000 + k, t, s) for k, t, s in near_copies(6, 20)]
    assert sorted(map(tuple, ngram_join.components(frame(spark, rows)).collect())) == brute_components(rows)
    assert 150 <= sum(made) < 20 * 150


def test_sets_without_a_link_leave_early(spark):
    """No set with a link is left out by the sample of shingles, and most others are."""
    rows = near_copies(5, 60)
    sets = {ngram_join.set_id(s)[0]: s for _, t, _ in rows if len(s := ngram_join.shingles(t))}
    linked = {a for a in sets for b in sets if a != b and ngram_join.alike(sets[a], sets[b])}
    docs = frame(spark, rows).select(F.col("doc_id").alias("id"), "text").repartition(5)
    got = {r[0] for r in ngram_join.undecided(ngram_join.document_sets(docs, 7).cache()).collect()}
    assert linked <= got < set(sets)


def test_ngram_join_tells_texts_apart_that_a_digest_does_not(spark, monkeypatch):
    real = ngram_join.set_id

    def weak(s, moved=frozenset()):
        sid, check = real(s)
        return ((sid & 3) ^ check if sid & 3 in moved else sid & 3), check

    monkeypatch.setattr(ngram_join, "set_id", weak)
    rows = near_copies(3, 12)
    assert sorted(map(tuple, ngram_join.components(frame(spark, rows)).collect())) == brute_components(rows)


def test_ngram_join_has_no_words_that_hash_alike_by_design(spark):
    """Thue-Morse words and their complements meet under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[x] for x in bits), "s"), (2, "".join("ba"[x] for x in bits), "s"), (3, "".join("AB"[x] for x in bits), "s")]
    assert sorted(map(tuple, ngram_join.components(frame(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.components(frame(spark, EDGE).limit(0)).count() == 0
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(frame(spark, EDGE)).collect()}
    assert got[2] == 1 and got[3] == 3 and got[4] == 4


def chain(*words):
    """Three texts of 100 shingles: the second is a near copy of both others, which are none of each other."""
    w = [f"{words[0]}{i}" for i in range(104)]
    return " ".join(["x"] * 8 + w[8:]), " ".join(w), " ".join(w[:96] + ["y"] * 8)


def test_ngram_join_links_rows_without_id(spark):
    (a, n, b), (c, m, d) = chain("p"), chain("q")
    rows = [(5, a, "s"), (None, n, "s"), (None, n, "s"), (9, b, "s"), (None, c, "s"), (None, m, "s"), (7, d, "s"), (None, None, "s"), (8, "far from all", "s")]
    rows += [(None, t.upper(), "s") for t in chain("r")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(frame(spark, rows)).collect()), key=str)
    sizes = {t: len(ngram_join.shingles(t)) for _, t, _ in rows}
    want = [5, 5, 5, 5, 7, 7, 7, None, 8, None, None, None]
    assert got == sorted(((i, sizes[t], c) for (i, t, _), c in zip(rows, want, strict=True)), key=str)
    assert {r["component_id"] for r in ngram_join.components(frame(spark, [r for r in rows if r[1] != n])).where("doc_id in (5, 9)").collect()} == {5, 9}


def test_near_copies_go_by_row(spark):
    """One row of each component stays, and no other text of an id whose one text is a near copy."""
    (a, n, b), (c, m, d), (e, o, f) = chain("p"), chain("q"), chain("r")
    rows = [(5, a, "s"), (9, n, "s"), (9, "a clean text of its own", "s")]
    rows += [(3, c, "s"), (3, m, "s"), (3, d, "t"), (6, "lone", "b"), (6, "lone", "a")]
    rows += [(None, e, "s"), (None, o, "s"), (8, f, "s"), (None, "no id and no copy", "s"), (9, " ", "s"), (9, None, "s"), (None, "", "s")]
    rows += [(None, "w " + t, "s") for t in chain("z")]
    kept = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SF).collect()]
    sure = [(5, a, "s"), (9, "a clean text of its own", "s"), (6, "lone", "a"), (8, f, "s"), (None, "no id and no copy", "s"), (9, " ", "s"), (9, None, "s"), (None, "", "s")]
    rest = list(kept)
    for r in sure:
        rest.remove(r)
    assert len(rest) == 2 and {r[0] for r in rest} == {3, None}
    assert all(r in rows for r in rest) and sum(r[0] is None and r[1][:2] == "w " for r in rest) == 1
    again = corpus_pipeline.drop_near_copies(spark, frame(spark, rows[::-1]).repartition(3), SF).collect()
    assert sorted(kept, key=str) == sorted(((r["doc_id"], r["text"], r["source"]) for r in again), key=str)
    assert corpus_pipeline.drop_near_copies(spark, frame(spark, rows).limit(0), SF).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i) for i in range(400)] + [(400, None, 0), (401, [float("nan")] * 8, 0), (402, [None] + [1.0] * 7, 0), (403, [float("inf")] * 8, 0), (404, [], 0), (7, [0.5] * 8, 1), (500, [1.0, 2.0], 0), (600, [2.0, 3.0], 0), (700, [0.25] * 8, 0), (701, [0.25] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    got = sorted(map(tuple, exact_topk.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    sound = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in sound:
        if i % 100 == 0:
            near = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in sound if j != i and len(w) == len(v)))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    assert got == sorted(want)
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_large_and_repeated(spark):
    """Components whose scores pass doubles, and two query rows of one id, against brute force."""
    rows = [(1, [1e12, -3.0]), (2, [5e7, 7e7 + 1 / 1024]), (3, [-2.5, 0.001]), (4, [1e-3, 4.0]), (100, [0.002, 1.0]), (100, [3.0, -2e3]), (200, [2.0, 2.0**16])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for i, v in ints:
        if i % 100 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ints if j != i)[:3]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    assert max(abs(w[3]) for w in want) > 2**53
    assert sorted(map(tuple, exact_topk.top_k(df, df.where("vec_id % 100 = 0"), k=3).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["op4_url_filters", "op5_exact_dedup", "op7_mixing", "op8_ngram_join", "op10_exact_topk"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    """Every stage against what it is to do with all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    scores = {r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, SF).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < 0.7}
    single = stages["exact dedup"](spark, clean, SF).cache()
    last = {}
    for r in clean.collect():
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(last.values())
    apart = stages["n-gram Jaccard join"](spark, single, SF).cache()
    want = brute_components([(r["doc_id"], r["text"], None) for r in single.collect()])
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted({c for _, _, c in want})
    mixed = stages["mixing"](spark, apart, SF).cache()
    assert mixed.columns == apart.columns == docs.columns
    taken = {r["doc_id"]: r["mix"]["taken"] for r in mixing.mix(apart).collect()}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {i: n for i, n in taken.items() if n}
    assert stages["BPE encoding and decoding"](spark, mixed, SF).count() == mixed.count()
