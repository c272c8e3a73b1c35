"""Rule engines and operations on graphs."""

import pytest

from quadrille.operators import graphs
from quadrille.operators import components
from quadrille.operators.components import connected_components
from quadrille.operators.rules import inconsistencies, materialize
from quadrille.sources.rdf import from_text, lines

P = "@prefix : <urn:> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def inferred(spark, regime, text):
    got = materialize(from_text(spark, P + text), regime).quads
    return {r["value"] for r in lines(got.drop("g")).collect()}


def has(s, p, o):
    short = {"a": "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "same": "http://www.w3.org/2002/07/owl#sameAs", "sub": "http://www.w3.org/2000/01/rdf-schema#subClassOf"}
    return f"<urn:{s}> <{short.get(p, 'urn:' + p)}> <urn:{o}> ."


CASES = [
    ("rdfs", ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :x a :A .", [("x", "a", "C"), ("A", "sub", "C")]),
    ("rdfs", ":p rdfs:domain :C ; rdfs:range :D . :x :p :y .", [("x", "a", "C"), ("y", "a", "D")]),
    ("rdfs", ":p rdfs:subPropertyOf :q . :q rdfs:subPropertyOf :r . :x :p :y .", [("x", "r", "y")]),
    ("owl2-rl", ":p a owl:TransitiveProperty . :a :p :b . :b :p :c . :c :p :d .", [("a", "p", "d")]),
    ("owl2-rl", ":p owl:inverseOf :q . :a :p :b . :c :q :d .", [("b", "q", "a"), ("d", "p", "c")]),
    ("owl2-rl", ":p a owl:FunctionalProperty . :a :p :b , :c . :b :n :z .", [("b", "same", "c"), ("c", "n", "z"), ("c", "same", "b")]),
    ("owl2-rl", ":C owl:intersectionOf (:A :B) . :x a :A , :B . :y a :C .", [("x", "a", "C"), ("y", "a", "A")]),
    ("owl2-rl", ":u owl:propertyChainAxiom (:p :q) . :a :p :b . :b :q :c .", [("a", "u", "c")]),
    ("owl2-rl", ":R owl:onProperty :p ; owl:someValuesFrom :D . :R rdfs:subClassOf :C . :x :p :y . :y a :D .", [("x", "a", "R"), ("x", "a", "C")]),
    ("owl2-rl", ":C owl:hasKey (:k) . :x a :C ; :k 1 . :y a :C ; :k 1 .", [("x", "same", "y")]),
    ("owl2-el", ":A rdfs:subClassOf :R . :R owl:onProperty :p ; owl:someValuesFrom :B . :B rdfs:subClassOf :C . :S owl:onProperty :p ; owl:someValuesFrom :C .", [("A", "sub", "S")]),
    ("owl2-dl", ":C owl:disjointUnionOf (:A :B) . :x a :A .", [("x", "a", "C")]),
]


@pytest.mark.parametrize(("regime", "text", "wanted"), CASES)
def test_entailment(spark, regime, text, wanted):
    got = inferred(spark, regime, text)
    assert {has(*w) for w in wanted} <= got


def test_literals_have_no_range_type(spark):
    assert inferred(spark, "rdfs", ":p rdfs:range :D . :x :p 5 .") == set()


def test_inconsistencies(spark):
    d = from_text(spark, P + ":A owl:disjointWith :B . :S rdfs:subClassOf :A . :x a :S , :B .")
    assert {r["rule"] for r in inconsistencies(d).collect()} == {"cax-dw"}


@pytest.mark.parametrize("few", [3, 500_000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (5, 5)], "a int, b int")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}
    assert connected_components(e.limit(0)).count() == 0


def triples(spark, text):
    return from_text(spark, P + text).quads.select("s", "p", "o")


def test_diff_and_merge(spark):
    base, ours, theirs = triples(spark, ":a :p 1 , 2 ; :q 5 ."), triples(spark, ":a :p 1 , 3 ; :q 5 ."), triples(spark, ":a :p 1 , 2 ; :q 6 .")
    got = {(r["change"], r["o"]["v"], r["changed"]) for r in graphs.diff(base, ours).collect()}
    assert got == {("added", "3", True), ("removed", "2", True)}
    m = {r["p"]: ([o["v"] for o in r["objects"]], r["state"]) for r in graphs.merge3(base, ours, theirs).collect()}
    assert m == {"urn:p": (["1", "3"], "ours"), "urn:q": (["6"], "theirs")}
    clash = triples(spark, ":a :p 9 ; :q 5 .")
    m = {r["p"]: ([o["v"] for o in r["objects"]], r["state"]) for r in graphs.merge3(base, ours, clash, "union").collect()}
    assert m["urn:p"] == (["1", "3", "9"], "conflict")
    assert tuple(graphs.ahead_behind(ours, theirs).first()) == (2, 2)


def test_blank_nodes(spark):
    a = triples(spark, "_:x :p _:y . _:y :q 1 . :z :r _:x .")
    b = triples(spark, ":z :r _:k . _:k :p _:j . _:j :q 1 .")
    assert graphs.revision(a).first() == graphs.revision(b).first()
    c = triples(spark, ":z :r _:k . _:k :p _:j . _:j :q 2 .")
    assert graphs.revision(a).first() != graphs.revision(c).first()
    sk = graphs.relabelled(a, graphs.canonical_labels(a), "http://h")
    assert sk.where("s.k = 1 or o.k = 1").count() == 0
    assert graphs.deskolemised(sk, "http://h").where("s.k = 1").count() == 2


def test_statistics(spark):
    q = from_text(spark, P + ":A a owl:Class . :x a :A ; :p :y . :y a :A .").quads
    s = graphs.void_stats(q).first()
    assert (s["triples"], s["subjects"], s["classes"]) == (4, 3, 2)
    assert {(r["facet"], r["value"], r["n"]) for r in graphs.facets(q).collect()} >= {("class", "urn:A", 2)}
    assert graphs.content_kind(q).first()["kind"] == "model"
    assert {r["direction"] for r in graphs.resource_view(q, "urn:y").collect()} == {"in", "out"}
    assert graphs.suggest(q, "urn:").first()["iri"] == "urn:A"
    f = graphs.fingerprint(q.orderBy("p")).first()
    assert f == graphs.fingerprint(q.repartition(3)).first()


def test_rules_go_on_until_nothing_is_new(spark, monkeypatch):
    """Also where a limit of rounds, as there was one, is reached before."""
    monkeypatch.setattr("quadrille.operators.rules.MOST_ROUNDS", 2, raising=False)
    chain = " ".join(f":A{i} rdfs:subClassOf :A{i + 1} ." for i in range(9))
    assert has("x", "a", "A9") in inferred(spark, "rdfs", f":x a :A0 . {chain}")


def test_inconsistencies_write_no_long_texts(spark, monkeypatch):
    """Long literals go as digests; a clash names them in full, and texts that differ at their end stay apart."""
    from pyspark.sql import functions as F

    from quadrille.operators import rules

    sizes, kept = [], rules.written

    def written(df, name="table"):
        out = kept(df, name)
        sizes.extend(out.agg(F.max(F.length(c))).first()[0] or 0 for c in out.columns)
        return out

    monkeypatch.setattr(rules, "written", written)
    text = "word \\\"quoted\\\" " * 300
    data = from_text(spark, f'@prefix : <urn:> . @prefix owl: <http://www.w3.org/2002/07/owl#> . :p owl:propertyDisjointWith :q . :a :p "{text}a"@en ; :q "{text}a"@en . :b :p "{text}b" ; :q "{text}c" . :c :p "{text}d" ; :q "{text}d"@en . :e :p "x" ; :q "x" .')
    got = sorted(map(tuple, rules.inconsistencies(data).collect()))
    assert got == [("prp-pdw", "<urn:a>", f'"{text}a"@en'), ("prp-pdw", "<urn:e>", '"x"')]
    assert sizes and max(sizes) < 300
