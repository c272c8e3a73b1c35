"""Token counts, BPE, toxicity, language ID, URL filters and license scans."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import bpe, language_id, license_scan, token_counts, toxicity, url_filters
from quadrille.llm.queries import BYTES, PIECES, RULES, toxicity_index, vocabulary

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

SP = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
TK = tokenizers.Tokenizer.from_file(vocabulary(BYTES))
COUNT = token_counts.PrefixCounter(vocabulary(PIECES))
BPE = bpe.SpeculativeBPE(vocabulary(BYTES))
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\u2581", "é", "中", "the", " ing", "'s", "①", "🙂", "0", "123", "<s>", "<|endoftext|>", "\u200b", "\x00", "\u0345", "ſ", "\u3000", "\x85", "\x1c", "don't", "Straße", "\ufffd"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=12)
EDGE = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x"), (4, "w" * 30_000), (5, "word " * 30_000)]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame([(i, t, "x", 7, 8) for i, t in EDGE], "doc_id long, text string, id string, n_tokens int, score int")


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_prefix_counts(text):
    assert COUNT.table(text) == [len(SP.encode(text[:i])) for i in range(len(text) + 1)]
    assert COUNT.count(text) == len(SP.encode(text))


def test_truncation():
    text = "The quick brown fox jumps over the lazy dog. " * 5
    at = COUNT.fits(text, 20)
    assert len(SP.encode(text[:at])) <= 20 and all(len(SP.encode(text[:i])) > 20 for i in range(at + 1, len(text) + 1))


def test_token_count_rows(spark, edge):
    got = token_counts.token_counts(edge, vocabulary(PIECES)).collect()
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t in EDGE for n in [len(SP.encode(t or ""))]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(edge.limit(0), vocabulary(PIECES)).count() == 0
    assert token_counts.prefix_tables(edge.where("doc_id = 1").limit(1), vocabulary(PIECES)).first()["prefix_tokens"] == [len(SP.encode("one two"[:i])) for i in range(8)]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=20))
def test_bpe_is_the_librarys(texts):
    for text, ids in zip(texts, BPE.encode_batch(texts), strict=True):
        want = TK.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert BPE.decode(ids) == TK.decode(want, skip_special_tokens=False)


def test_bpe_unicode():
    texts = ["a" + chr(c) + "b 1" + chr(c) for c in range(0x21, 0x3100) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, BPE.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TK.encode(text, add_special_tokens=False).ids, ascii(text)


def test_long_word_merges():
    random.seed(1)
    text = "".join(random.choice("abcde") for _ in range(20_000))
    assert np.frombuffer(BPE.encode_batch([text])[0], "<u4").tolist() == TK.encode(text, add_special_tokens=False).ids


def test_bpe_rows(edge):
    got = bpe.encode_decode(edge, vocabulary(BYTES)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got) == sorted((str(i), t or "") for i, t in EDGE)
    short = bpe.encode_decode(edge, vocabulary(BYTES), full=False)
    assert short.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and short.count() == len(EDGE)


def examples(n, seed=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        text = rnd.choices(words, k=40) + rnd.sample(["trash", "scum", "idiot", "moron"], 3) * toxic
        rnd.shuffle(text)
        out.append((i, " ".join(text), toxic))
    return out


def test_nearest_examples_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "RARE_SHARE", 0.02)
    monkeypatch.setattr(toxicity, "DENSE_SHARE", 0.13)
    rows = [(i, f"{t} own{i} few{i // 3}", y) for i, t, y in examples(400)]
    index = toxicity.BlockMaxIndex.of([(dict(toxicity.terms(t)), y) for _, t, y in rows])
    df = Counter(w for _, t, _ in rows for w in toxicity.terms(t))
    assert index.rare_start[-1] and len(index.doc) and index.dense.shape[1]  # plain postings, block maxima and dense columns

    def unit(text):
        w = {t: (1 + np.log(c)) * np.log(401 / df[t]) for t, c in toxicity.terms(text).items() if t in df}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    units, asked = [unit(rows[i][1]) for i in index.order], [f"{t} few{i} own{i}" for i, t, _ in examples(40, 5)]
    for text, (best, cosine) in zip(asked, index.nearest([index.vector(toxicity.terms(t)) for t in asked]), strict=True):
        q = unit(text)
        all_ = np.array([sum(q[t] * u.get(t, 0) for t in q) for u in units])
        want = np.sort(all_)[::-1][: toxicity.K]
        assert np.allclose(cosine, want[want > 0], atol=1e-5) and np.allclose(all_[best], cosine, atol=1e-5)


def test_toxicity_rows(spark):
    train = spark.createDataFrame(examples(600), "doc_id long, text string, toxic int")
    labels = train.select("doc_id", "toxic").unionByName(spark.createDataFrame([(1, None), (1, 0), (None, 1)], "doc_id long, toxic int"))
    index = spark.sparkContext.broadcast(toxicity.fit(train.select("doc_id", "text"), labels))
    fresh = spark.createDataFrame([(*r, "x") for r in examples(100, 9)] + [(1000, None, 0, "x"), (1000, "", 0, "x"), (1001, "unheard of", 0, "x")], "doc_id long, text string, toxic int, score string")
    got = toxicity.classify(fresh, index)
    wrong = got.join(fresh.select("doc_id", "toxic"), "doc_id").where("predicted <> toxic").count()
    assert wrong <= 3 and got.count() == 103 and got.where("score < 0 or score > 1 or score is null").count() == 0
    kept = toxicity.keep_clean(fresh, index)
    assert kept.columns == fresh.columns and kept.where("toxic = 0").count() >= 80 and kept.where("toxic = 1").count() <= 3
    nothing = spark.sparkContext.broadcast(toxicity.fit(train.limit(0), labels))
    assert {r["score"] for r in toxicity.classify(fresh, nothing).collect()} == {0.0}


def kinds(n, seed):
    """Texts of eight kinds: the nearest are of the same kind, and one in ten of each is toxic."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind, toxic = rnd.randrange(8), int(rnd.random() < 0.1)
        text = rnd.choices([f"k{kind}w{j}" for j in range(60)], k=20) + rnd.sample(["trash", "scum", "idiot", "moron"], 2) * toxic
        rnd.shuffle(text)
        out.append((i, " ".join(text), toxic))
    return out


def test_toxic_texts_among_many_of_their_kind(spark):
    train, fresh = (spark.createDataFrame(kinds(n, seed), "doc_id long, text string, toxic int") for n, seed in ((2000, 1), (500, 2)))
    index = spark.sparkContext.broadcast(toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic")))
    kept = toxicity.keep_clean(fresh, index)
    toxic = fresh.where("toxic = 1").count()
    assert kept.where("toxic = 1").count() <= 0.1 * toxic and kept.where("toxic = 0").count() >= 0.98 * (500 - toxic)


def inflected(n, seed):
    """What is toxic has an ending that hardly ever comes again."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        text = rnd.choices([f"w{j}" for j in range(300)], k=40) + [w + "".join(rnd.choices("aeinrst", k=5)) for w in rnd.sample(["tras", "scum", "idio", "moro"], 3)] * toxic
        rnd.shuffle(text)
        out.append((i, " ".join(text), toxic))
    return out


def test_inflected_words_meet_in_their_stems(spark):
    assert toxicity.terms("Idiotic idiots, idiotic it") == {"idiotic": 2, "idiots": 1, "it": 1, "idio*": 3}
    train, fresh = (spark.createDataFrame(inflected(n, seed), "doc_id long, text string, toxic int") for n, seed in ((600, 1), (200, 2)))
    index = spark.sparkContext.broadcast(toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic")))
    kept = toxicity.keep_clean(fresh, index)
    assert kept.where("toxic = 1").count() <= 4 and kept.where("toxic = 0").count() >= 156


def test_votes_and_fit():
    rows = examples(300)
    index = toxicity.BlockMaxIndex.of([(dict(toxicity.terms(t)), y) for _, t, y in rows])
    asked = [index.vector(toxicity.terms(t)) for _, t, _ in examples(20, 5)]
    for v, (near, cosine) in zip(index.votes(asked, (3, 31, 5000)), index.nearest(asked, 5000), strict=True):
        w = 1 / (1 - cosine)
        assert np.allclose(v, [w[:k] @ index.labels[near[:k]] / w[:k].sum() for k in (3, 31, 5000)], atol=1e-5)
    labels = [0.0, 1.0] * 50
    index.calibrate([[0.5, y] for y in labels], labels, (31, 63))  # only the second tells the labels
    assert index.k == 63 and np.interp(1, *index.curve) > 0.9 > 0.1 > np.interp(0, *index.curve)
    index.calibrate([[0.5, 0.5] for _ in labels], labels, (31, 63))
    assert index.k == 31 and len(index.curve[0]) == 1 and abs(index.curve[1][0] - 0.5) < 0.01


def test_language_profiles(spark):
    rows = [("en", "the cat and the dog went with them through this"), ("de", "der Hund und die Katze gingen mit ihnen durch das"), ("fr", "le chat et le chien sont avec eux dans la maison")]
    docs = spark.createDataFrame([(i, rows[i % 3][1] * 3, rows[i % 3][0], "s") for i in range(30)] + [(99, None, "en", "s"), (98, "text", None, "s")], "doc_id long, text string, lang string, lang_pred string")
    profiles = language_id.learn(docs)
    assert sorted(profiles) == ["de", "en", "fr"]
    fresh = spark.createDataFrame([(1, "the dog with this cat"), (2, "die Katze und der Hund"), (3, "123 !"), (4, None), (5, ""), (6, "le chien dans la maison")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(fresh, profiles).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "fr"}
    assert {r["lang_pred"] for r in language_id.identify(fresh, {}).collect()} == {"und"}
    grams, counts = language_id.ngram_counts("ab a")
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True))[ord("a")] == 2 + 2  # alone, and after a blank


def test_url_rules():
    index = url_filters.RuleIndex(RULES)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "net", "example.net", "org", "xcom", "", "com.evil"]
    paths = ["/en/", "/en/7", "/en/71", "/EN/7", "/de/8x", "/de/", "/es/", "", "/", "/x/en/"]
    for h in hosts:
        for p in paths:
            fit = [r for r in RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
            want = max(fit, key=lambda r: len(r.text), default=None)
            assert index.judge(h, p) == want, (h, p)
    many = url_filters.RuleIndex([url_filters.Rule("block", f"h{i}.example", "/") for i in range(2000)])
    assert max(map(len, many.filed.values())) == 1 and many.judge("a.h7.example", "/x").host == "h7.example"


def test_url_rows(spark):
    pages = spark.createDataFrame([(1, "HTTP://Sub.Example.COM/en/7?q", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "x://a.net/de/8", "h"), (4, "x://a.net/de/8#f", "h"), (5, "a://b://c/d", "h")], "page_id long, url string, host string")
    got = sorted(map(tuple, url_filters.filter_urls(pages, RULES).collect()), key=str)
    assert got == sorted([(1, "sub.example.com", "/en/7", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "/de/8", "net/de/", "allow"), (4, "a.net", "/de/8", "net/de/", "allow"), (5, "b:", "//c/d", None, "allow")], key=str)


def test_url_hosts_with_newlines(spark):
    index = url_filters.RuleIndex(RULES)
    assert index.judge("a\nb.com", "/en/") == RULES[0] and index.judge("a\ncom", "/en/") is None and index.judge("com\n", "/en/") is None
    pages = spark.createDataFrame([(1, "x://a\nb.com/en/\nx")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.filter_urls(pages, RULES).collect()] == [(1, "a\nb.com", "/en/\nx", "com/en/", "block")]


def aligned(text, template):
    """Longest common subsequence by brute force."""
    row = [0] * (len(template) + 1)
    for w in text:
        new = [0]
        for j, t in enumerate(template):
            new.append(max(row[j] + (w == t), row[j + 1], new[j]))
        row = new
    return row[-1]


def test_license_scan(spark):
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    rnd = random.Random(3)
    for name, template in license_scan.TEMPLATES.items():
        words = index.words[name]
        noise = [f"n{rnd.randrange(500)}" for _ in range(60)]
        text = " ".join(noise[:30]) + "\n" + template + ".\n" + " ".join(noise[30:])
        found = {m.license: m for m in index.scan(text)}
        assert found[name].coverage == 1.0 and text[found[name].start : found[name].end].lower().split()[0].strip("(") == template.lower().split()[0]
        cut = [w for i, w in enumerate(words) if i % 12 != 11]
        matched = aligned(noise[:20] + cut, words) / len(words)
        assert (name in {m.license for m in index.scan(" ".join(noise[:20] + cut))}) == (matched >= license_scan.LEAST_COVERAGE)
    assert index.scan(" ".join(f"n{i}" for i in range(1000))) == []
    docs = spark.createDataFrame([(1, "Released under the MIT License. x. Released under the MIT License", "q"), (2, None, "q"), (3, "", "q"), (1, "none", "q")], "doc_id long, text string, license string")
    assert [(r["doc_id"], r["license"], r["span_start"]) for r in license_scan.scan(docs).orderBy("span_start").collect()] == [(1, "MIT-reference", 0), (1, "MIT-reference", 35)]
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.TemplateIndex({"x": "two words"})


def test_fitting_leaves_little_memory_with_the_driver(spark):
    """What the index needed while it was made goes back to the system."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024

    before = held()
    sent = toxicity_index(spark, "/root/testdata/check_s")
    assert held() - before < 30
    sent.destroy()
