"""SHACL, RML and text search."""

import pytest

from quadrille.operators import shacl, text_search
from quadrille.sources import rml
from quadrille.sources.rdf import from_text, lines

P = "@prefix : <urn:> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
DATA = P + """:a a :Person ; :name "Ann" ; :age 30 ; :knows :b ; :start 1 ; :end 2 . :b a :Person ; :age "x" , 200 ; :knows :c ; :start 5 ; :end 2 .
:S rdfs:subClassOf :Person . :c a :S ; :name "Cy"@en , "Ci"@en ; :age 5 ; :other 1 ."""
CASES = {
    "sh:property [ sh:path :name ; sh:minCount 1 ]": {("b", "MinCount")},
    "sh:property [ sh:path :name ; sh:maxCount 1 ]": {("c", "MaxCount")},
    "sh:property [ sh:path :age ; sh:datatype xsd:integer ]": {("b", "Datatype")},
    "sh:property [ sh:path :age ; sh:maxInclusive 150 ; sh:minExclusive 5 ]": {("b", "MaxInclusive"), ("b", "MinExclusive"), ("c", "MinExclusive")},
    "sh:property [ sh:path :knows ; sh:class :S ]": {("a", "Class")},
    "sh:property [ sh:path :knows ; sh:nodeKind sh:Literal ]": {("a", "NodeKind"), ("b", "NodeKind")},
    "sh:property [ sh:path :name ; sh:pattern '^A' ]": {("c", "Pattern")},
    "sh:property [ sh:path :name ; sh:minLength 3 ]": {("c", "MinLength")},
    "sh:property [ sh:path :name ; sh:uniqueLang true ]": {("c", "UniqueLang")},
    "sh:property [ sh:path :name ; sh:languageIn ('en') ]": {("a", "LanguageIn")},
    "sh:property [ sh:path :age ; sh:in (30 5) ]": {("b", "In")},
    "sh:property [ sh:path :age ; sh:hasValue 30 ]": {("b", "HasValue"), ("c", "HasValue")},
    "sh:property [ sh:path :start ; sh:lessThan :end ]": {("b", "LessThan")},
    "sh:property [ sh:path :start ; sh:equals :end ]": {("a", "Equals"), ("b", "Equals")},
    "sh:property [ sh:path (:knows :knows) ; sh:minCount 1 ]": {("b", "MinCount"), ("c", "MinCount")},
    "sh:property [ sh:path [ sh:inversePath :knows ] ; sh:minCount 1 ]": {("a", "MinCount")},
    "sh:property [ sh:path [ sh:oneOrMorePath :knows ] ; sh:maxCount 1 ]": {("a", "MaxCount")},
    "sh:closed true ; sh:ignoredProperties (rdf:type :name :age :knows :start :end)": {("c", "Closed")},
    "sh:not [ sh:property [ sh:path :name ; sh:minCount 1 ] ]": {("a", "Not"), ("c", "Not")},
    "sh:or ( [ sh:property [ sh:path :name ; sh:minCount 1 ] ] [ sh:property [ sh:path :age ; sh:minCount 2 ] ] )": set(),
    "sh:xone ( [ sh:property [ sh:path :name ; sh:minCount 1 ] ] [ sh:property [ sh:path :age ; sh:minCount 1 ] ] )": {("a", "Xone"), ("c", "Xone")},
    "sh:and ( [ sh:property [ sh:path :name ; sh:minCount 1 ] ] )": {("b", "And")},
    "sh:property [ sh:path :knows ; sh:node [ sh:property [ sh:path :name ; sh:minCount 1 ] ] ]": {("a", "Node")},
    "sh:property [ sh:path :knows ; sh:qualifiedValueShape [ sh:class :S ] ; sh:qualifiedMinCount 1 ]": {("a", "QualifiedMinCount"), ("c", "QualifiedMinCount")},
    "sh:sparql [ sh:select 'SELECT $this ?value { $this <urn:age> ?value FILTER(isNumeric(?value) && ?value > 100) }' ]": {("b", "SPARQL")},
}


@pytest.mark.parametrize("shape", CASES)
def test_constraint(spark, shape):
    got = shacl.validate(from_text(spark, DATA), P + f":Sh a sh:NodeShape ; sh:targetClass :Person ; {shape} .")
    assert {(r["focus"]["v"].removeprefix("urn:"), r["component"].removesuffix("ConstraintComponent")) for r in got.collect()} == CASES[shape]


def test_rules(spark):
    shapes = P + ":R a sh:NodeShape ; sh:targetClass :Person ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :known ; sh:object [ sh:path [ sh:inversePath :knows ] ] ] , [ a sh:SPARQLRule ; sh:construct 'CONSTRUCT { $this <urn:far> ?z } WHERE { $this <urn:knows> ?y . ?y <urn:knows> ?z }' ] ."
    got = {r["value"] for r in lines(shacl.infer(from_text(spark, DATA), shapes).quads).collect()}
    assert got == {"<urn:b> <urn:known> <urn:a> .", "<urn:c> <urn:known> <urn:b> .", "<urn:a> <urn:far> <urn:c> ."}


MAPPING = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix : <urn:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:m rml:logicalSource [ rml:source "%s" ; rml:referenceFormulation ql:%s ; rml:iterator "%s" ] ; rr:subjectMap [ rr:template "urn:p/{id}" ; rr:class :Person ] ;
 rr:predicateObjectMap [ rr:predicate :name ; rr:objectMap [ rml:reference "name" ] ] , [ rr:predicate :age ; rr:objectMap [ rml:reference "age" ; rr:datatype xsd:integer ] ; rr:graph :g ] ."""


def test_rml(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,age\n1 x,Ann,3\n2,,4\n")
    (tmp_path / "a.json").write_text('{"people": [{"id": "1 x", "name": "Ann", "age": 3}, {"id": "2", "name": null, "age": 4}]}')
    (tmp_path / "a.xml").write_text("<r><person><id>1 x</id><name>Ann</name><age>3</age></person><person><id>2</id><age>4</age></person></r>")
    want = {"<urn:p/1%20x> <urn:name> \"Ann\" .", "<urn:p/1%20x> <urn:age> \"3\"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .", "<urn:p/2> <urn:age> \"4\"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> ."}
    for file, kind, it in (("a.csv", "CSV", ""), ("a.json", "JSONPath", "$.people[*]"), ("a.xml", "XPath", "/r/person")):
        got = {r["value"] for r in lines(rml.execute(spark, MAPPING % (tmp_path / file, kind, it)).quads).collect()}
        assert {x for x in got if "#type" not in x} == want, file
        assert len(got) == 5


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "red fox, red dog"), (2, "A fox"), (3, "nothing"), (4, ""), (5, None)], "id int, text string")
    assert [r["id"] for r in text_search.bm25(docs, "Fox").collect()] == [2, 1]
    assert text_search.bm25(docs, "...").count() == 0
    q = from_text(spark, P + ':a :title "red fox" ; :note "fox" . :b :note "fox fox" .')
    assert [r["id"]["v"] for r in text_search.search(q.quads, "fox", "urn:title").collect()] == ["urn:a"]
    words = spark.createDataFrame([("person",), ("parson",), ("place",)], "word string")
    assert [r["word"] for r in text_search.did_you_mean(words, "persn").collect()] == ["person", "parson"]
    assert text_search.autocomplete(words, "pl").first()["word"] == "place"
    c = spark.createDataFrame([("t1", "v1", 1.0), ("t2", "v1", 2.0), ("t3", "v2", 1.0), ("t1", "v2", 3.0)], "term string, vocabulary string, score double")
    assert [v for v, _ in text_search.recommend(c)] == ["v1", "v2"] or [v for v, _ in text_search.recommend(c)] == ["v2", "v1"]


def test_rules_do_not_stop_short_in_silence(spark):
    d = from_text(spark, P + ":a a :Person ; :on :a ; :next :b . :b :next :c . :c :next :d . :d :next :e .")
    shapes = P + ":R a sh:NodeShape ; sh:targetClass :Person ; sh:rule [ a sh:SPARQLRule ; sh:construct 'CONSTRUCT { $this <urn:on> ?z } WHERE { $this <urn:on> ?y . ?y <urn:next> ?z }' ] ."
    got = {r["value"] for r in lines(shacl.infer(d, shapes).quads).collect()}
    assert got == {f"<urn:a> <urn:on> <urn:{x}> ." for x in "bcde"}
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        shacl.Validator(d, shacl.Shapes.read(shapes), None).infer(rounds=2)
