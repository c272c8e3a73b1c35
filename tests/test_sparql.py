"""Patterns, paths, graphs, forms and updates on small quad tables; parity of the mapped and the quad plan."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.operators.paths import closure
from quadrille.operators.update import batch, update
from quadrille.plans import catalog
from quadrille.plans.compiler import Unsupported, query
from quadrille.plans.parser import SyntaxProblem, parse_query
from quadrille.sources.dataset import QuadTable
from quadrille.sources.rdf import from_text, lines, read_files
from quadrille.sources.tables import dataset

SF = "/root/testdata/sf0.001"
DATA = """@prefix : <urn:> . :alice :knows :bob ; :age 30 ; :name "Alice" . :bob :knows :carol ; :age 25 ; :name "Bob"@en . :carol :age 3.5 ; :name "Carol" .
:carol :knows :alice . GRAPH :g1 { :x :p 1 } GRAPH :g2 { :x :p 1 . :y :p 2 }"""


@pytest.fixture(scope="module")
def data(spark):
    q = from_text(spark, DATA, "trig")
    return QuadTable(q.quads.cache())


def plain(x):
    return x["v"] if hasattr(x, "asDict") else x


def rows(data, text):
    return sorted((tuple(plain(v) for v in r) for r in query(data, "PREFIX : <urn:> " + text).collect()), key=repr)


CASES = {
    "SELECT ?x { :alice :knows ?x }": [("urn:bob",)],
    "SELECT ?a { ?a :age ?n FILTER(?n > 20) }": [("urn:alice",), ("urn:bob",)],
    "SELECT ?a { ?a :age 30 }": [("urn:alice",)],
    "SELECT ?a ?b { ?a :knows ?b . ?b :age ?n FILTER(?n < 26) }": [("urn:alice", "urn:bob"), ("urn:bob", "urn:carol")],
    "SELECT ?a ?n { ?a :age ?x OPTIONAL { ?a :name ?n FILTER(LANG(?n) = 'en') } }": [("urn:alice", None), ("urn:bob", "Bob"), ("urn:carol", None)],
    "SELECT ?a { ?a :name ?n MINUS { ?a :age 30 } }": [("urn:bob",), ("urn:carol",)],
    "SELECT ?a { ?a :name ?n MINUS { ?b :none ?c } }": [("urn:alice",), ("urn:bob",), ("urn:carol",)],
    "SELECT ?a { ?a :age ?n FILTER NOT EXISTS { ?a :knows :bob } }": [("urn:bob",), ("urn:carol",)],
    "SELECT ?a { { ?a :age 30 } UNION { ?a :age 25 } }": [("urn:alice",), ("urn:bob",)],
    "SELECT ?a ?k { ?a :age ?n BIND(IF(?n > 26, 'old', 'young') AS ?k) }": [("urn:alice", "old"), ("urn:bob", "young"), ("urn:carol", "young")],
    "SELECT ?a { VALUES ?a { :alice :nobody } ?a :age ?n }": [("urn:alice",)],
    "SELECT (COUNT(*) AS ?n) { ?a :none ?b }": [(0,)],
    "SELECT ?x { :alice :knows+ ?x }": [("urn:alice",), ("urn:bob",), ("urn:carol",)],
    "SELECT ?x { ?x :knows+ :carol }": [("urn:alice",), ("urn:bob",), ("urn:carol",)],
    "SELECT ?x { :alice :knows/:knows ?x }": [("urn:carol",)],
    "SELECT ?x { :alice (:knows|:age) ?x }": [("30",), ("urn:bob",)],
    "SELECT ?x { :bob ^:knows ?x }": [("urn:alice",)],
    "SELECT ?x { :alice !(:knows|:name) ?x }": [("30",)],
    "SELECT ?x { :alice :knows? ?x }": [("urn:alice",), ("urn:bob",)],
    "SELECT ?x { :nobody :knows* ?x }": [],
    "SELECT ?g ?x { GRAPH ?g { ?x :p 1 } }": [("urn:g1", "urn:x"), ("urn:g2", "urn:x")],
    "SELECT ?x { GRAPH :g2 { ?x :p ?n } }": [("urn:x",), ("urn:y",)],
    "SELECT ?x ?n FROM :g1 FROM :g2 { ?x :p ?n }": [("urn:x", "1"), ("urn:y", "2")],
    "SELECT ?g FROM :g1 { GRAPH ?g { ?x :p ?n } }": [],
    "SELECT ?x FROM NAMED :g1 { ?x :p ?n }": [],
    "SELECT ?n { { SELECT ?a (MAX(?x) AS ?m) { ?a :age ?x } GROUP BY ?a ORDER BY DESC(?m) LIMIT 1 } ?a :name ?n }": [("Alice",)],
    "SELECT ?n { ?a :age ?x ; :name ?n } ORDER BY ?x LIMIT 1": [("Carol",)],
    "SELECT DISTINCT ?p { ?a ?p ?o }": [("urn:age",), ("urn:knows",), ("urn:name",)],
    "ASK { :alice :knows :bob }": [(True,)],
    "ASK { :alice :knows :carol }": [(False,)],
    "SELECT (AVG(?x) AS ?m) (SUM(?x) AS ?s) { ?a :age ?x }": [("19.5", "58.5")],
    "SELECT (SUM(?x) AS ?s) { ?a :name ?x }": [(None,)],
    "SELECT ?a ?b { ?a :age ?x OPTIONAL { ?a :none ?b } OPTIONAL { ?a :knows ?b } }": [("urn:alice", "urn:bob"), ("urn:bob", "urn:carol"), ("urn:carol", "urn:alice")],
    "SELECT ?a { ?a :age ?n SERVICE SILENT <urn:s> { ?a :b ?c } FILTER(?n = 30) }": [("urn:alice",)],
    "SELECT ?a { ?a :age ?n FILTER(?n > 29 || EXISTS { ?a :knows :alice }) }": [("urn:alice",), ("urn:carol",)],
}


@pytest.mark.parametrize("text", CASES)
def test_query(data, text):
    assert rows(data, text) == sorted(CASES[text], key=repr)


def test_construct_and_describe(data):
    got = query(data, "PREFIX : <urn:> CONSTRUCT { ?b :knownBy ?a ; :node [ :of ?a ] } { ?a :knows ?b }")
    assert got.count() == 9 and got.where("o.k = 1").select("o").distinct().count() == 3
    assert query(data, "PREFIX : <urn:> DESCRIBE :alice").count() == 3


def test_quoted_triples(spark):
    d = from_text(spark, '@prefix : <urn:> . << :alice :age 30 >> :source :hr . << << :a :b :c >> :d "x" >> :source :nested . :alice :age 31 {| :by :bob |} .')
    assert rows(d, "SELECT ?s ?n { << ?s :age ?n >> :source ?x }") == [("urn:alice", "30")]
    assert rows(d, "SELECT ?n { :alice :age ?n }") == [("31",)]
    assert rows(d, "SELECT ?who { << :alice :age 31 >> :by ?who }") == [("urn:bob",)]
    assert rows(d, "SELECT ?o { << << :a :b ?o >> :d 'x' >> :source :nested }") == [("urn:c",)]


def test_refused(data):
    with pytest.raises(Unsupported):
        query(data, "SELECT * { SERVICE <urn:s> { ?a ?b ?c } }")
    with pytest.raises(Unsupported):
        update(data, "LOAD <urn:x>")
    with pytest.raises(SyntaxProblem):
        parse_query("SELECT ?x { ?x }")


def content(data):
    return sorted(r["value"] for r in lines(data.quads).collect())


def test_updates(spark):
    d = update(QuadTable.empty(spark), "PREFIX : <urn:> INSERT DATA { :a :p 1 . :b :p 2 GRAPH :g { :c :p 3 } }")
    assert d.quads.count() == 3
    d = update(d, "PREFIX : <urn:> DELETE { ?s :p ?n } INSERT { ?s :q ?m } WHERE { ?s :p ?n BIND(?n + 10 AS ?m) }")
    assert content(d) == sorted(['<urn:a> <urn:q> "11"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<urn:b> <urn:q> "12"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<urn:c> <urn:p> "3"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .'])
    assert update(d, "PREFIX : <urn:> COPY DEFAULT TO :g").quads.where("g = 'urn:g'").count() == 2
    assert update(d, "PREFIX : <urn:> ADD DEFAULT TO :g").quads.where("g = 'urn:g'").count() == 3
    assert update(d, "PREFIX : <urn:> MOVE :g TO DEFAULT").quads.where("g is null").count() == 1
    assert update(d, "PREFIX : <urn:> COPY :g TO :g").quads.count() == 3
    assert update(d, "DROP ALL").quads.count() == 0
    assert update(d, "PREFIX : <urn:> WITH :g DELETE { ?s :p ?o } INSERT { ?s :r ?o } WHERE { ?s :p ?o }").quads.where("p = 'urn:r' and g = 'urn:g'").count() == 1
    assert update(d, "PREFIX : <urn:> DELETE WHERE { ?s :q ?o }").quads.count() == 1
    d, report = batch(d, ["CLEAR DEFAULT", "INSERT DATA { <urn:z> <urn:p> <urn:y> }"])
    assert [r["quads"] for r in report] == [1, 2]


def test_bulk_readers(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# c\n<urn:a> <urn:p> "x\\n\\u00e9"@EN .\n_:b <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n\n<urn:a> <urn:p> <urn:c> <urn:g> .\n')
    q = read_files(spark, str(tmp_path / "a.nt")).quads.collect()
    assert {(r["g"], r["o"]["v"], r["o"]["lang"]) for r in q} == {(None, "x\né", "en"), (None, "1", ""), ("urn:g", "urn:c", "")}
    (tmp_path / "b.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e:"><e:Person rdf:about="urn:x"><e:name xml:lang="de">Ä</e:name><e:knows rdf:resource="urn:y"/><e:at rdf:parseType="Resource"><e:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</e:n></e:at></e:Person></rdf:RDF>')
    assert read_files(spark, str(tmp_path / "b.rdf")).quads.count() == 5
    (tmp_path / "c.jsonld").write_text('{"@context": {"e": "urn:e:", "knows": {"@id": "e:knows", "@type": "@id"}}, "@id": "urn:x", "@type": "e:Person", "e:age": 3, "knows": ["urn:y", "urn:z"], "e:list": {"@list": [1, 2]}}')
    assert read_files(spark, str(tmp_path / "c.jsonld")).quads.count() == 9


@pytest.mark.parametrize("name", ["bgp_join3", "optional", "minus", "path_seq", "union", "exists_in_or", "agg_count_distinct"])
def test_quad_plan_gives_the_same(spark, name):
    mapped = dataset(spark, SF, only=("region", "nation", "customer", "orders", "lineitem", "documents", "labels") if name == "bgp_join3" else ("region", "nation", "customer", "supplier", "orders", "documents", "labels"))
    text = catalog.HEAD + catalog.SPARQL[name][0]
    show = lambda df: sorted(str(tuple(str(plain(v)) for v in r)) for r in df.collect())
    assert show(query(mapped, text)) == show(query(mapped.as_quads(), text))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=9))
def test_closure_is_reachability(spark, edges):
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    df = spark.createDataFrame(sorted(edges), "s int, o int")
    assert {tuple(r) for r in closure(df).collect()} == reach
    seeds = spark.createDataFrame([(0,)], "s int")
    assert {tuple(r) for r in closure(df, seeds).collect()} == {e for e in reach if e[0] == 0}


def test_joins_on_grouped_and_optional_variables_have_no_nested_loop(spark, data):
    text = "SELECT ?a ?k ?n { { SELECT ?a (COUNT(?b) AS ?k) { ?a :knows ?b } GROUP BY ?a } ?a :age ?n }"
    assert [r[:2] for r in rows(data, text)] == [("urn:alice", 1), ("urn:bob", 1), ("urn:carol", 1)]
    maybe = "SELECT ?a ?b ?n { ?a :name ?m OPTIONAL { ?a :knows ?b FILTER(?a = :bob) } { ?b :age ?n } }"
    assert sorted({r[:2] for r in rows(data, maybe)}) == [(x, y) for x, y in (("urn:alice", "urn:alice"), ("urn:alice", "urn:bob"), ("urn:alice", "urn:carol"), ("urn:bob", "urn:carol"), ("urn:carol", "urn:alice"), ("urn:carol", "urn:bob"), ("urn:carol", "urn:carol"))]
    plan = query(data, "PREFIX : <urn:> " + text)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    both = "SELECT ?a ?b { { ?a :name ?m OPTIONAL { ?a :knows ?b } } { ?b :age ?n . ?a :age ?k } }"
    want = [("urn:alice", "urn:bob"), ("urn:bob", "urn:carol"), ("urn:carol", "urn:alice")]
    assert rows(data, both) == want
