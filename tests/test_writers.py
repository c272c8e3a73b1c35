"""Result formats against the standard library's readers, and RDF formats by reading them again."""

import csv
import io
import json
from xml.etree import ElementTree

import pytest

from quadrille.sources import rdf, writers

DATA = """@prefix v: <urn:v:> .
<urn:a> v:name "a, \\"b\\" & <c>" ; v:size 5 ; v:label "Haus"@de , "line\\nbreak\\tand tab \\\\" .
_:x v:part <urn:a> .
<urn:b> v:name "" ; v:part _:x ."""
ALL = "SELECT ?s ?o ?n { ?s ?p ?o OPTIONAL { ?s <urn:v:size> ?n } }"


@pytest.fixture(scope="module")
def data(spark):
    return rdf.from_text(spark, DATA)


def test_json(spark, data):
    got = json.loads(writers.results(writers.solutions(data, ALL), "json").text())
    assert got["head"]["vars"] == ["s", "o", "n"]
    rows = got["results"]["bindings"]
    assert len(rows) == 7
    assert {"type": "literal", "value": "Haus", "xml:lang": "de"} in [r["o"] for r in rows]
    assert {"type": "literal", "value": "line\nbreak\tand tab \\"} in [r["o"] for r in rows]
    assert sum("n" in r for r in rows) == 4
    assert {r["n"]["datatype"] for r in rows if "n" in r} == {"http://www.w3.org/2001/XMLSchema#integer"}
    assert sum(r["s"]["type"] == "bnode" for r in rows) == 1


def test_xml(spark, data):
    ns = "{http://www.w3.org/2005/sparql-results#}"
    root = ElementTree.fromstring(writers.results(writers.solutions(data, ALL), "xml").text())
    rows = root.findall(f"{ns}results/{ns}result")
    assert len(rows) == 7
    values = [b[0].text or "" for r in rows for b in r if b.get("name") == "o"]
    assert 'a, "b" & <c>' in values and "" in values
    assert [v.get("name") for v in root.findall(f"{ns}head/{ns}variable")] == ["s", "o", "n"]


def test_csv_and_tsv(spark, data):
    got = list(csv.reader(io.StringIO(writers.results(writers.solutions(data, ALL), "csv").text(), newline="")))
    assert got[0] == ["s", "o", "n"] and len(got) == 8
    assert 'a, "b" & <c>' in [r[1] for r in got] and "line\nbreak\tand tab \\" in [r[1] for r in got]
    lines = writers.results(writers.solutions(data, ALL), "tsv").text().splitlines()
    assert lines[0] == "?s\t?o\t?n" and len(lines) == 8 and all(x.count("\t") == 2 for x in lines)
    assert '<urn:a>\t"Haus"@de\t"5"^^<http://www.w3.org/2001/XMLSchema#integer>' in lines


def test_no_rows_and_too_many(spark, data):
    none = writers.solutions(data, "SELECT ?s { ?s <urn:none> ?o }")
    assert json.loads(writers.results(none, "json").text())["results"]["bindings"] == []
    assert writers.results(none, "csv").text() == "s\r\n"
    with pytest.raises(ValueError, match="more than 3 rows"):
        writers.results(writers.solutions(data, ALL), "csv").text(most=3)
    assert json.loads(writers.boolean(True, "json"))["boolean"] is True


def triples(quads):
    """Triples with blank nodes made alike."""
    term = lambda x: (1, "blank", "", "") if x["k"] == 1 else tuple(x)
    return sorted((r["g"] or "", term(r["s"]), r["p"], term(r["o"])) for r in quads.collect())


@pytest.mark.parametrize("kind", ["turtle", "trig", "xml", "json-ld"])
def test_read_again(spark, data, kind):
    text = writers.rdf(data.quads, kind, {"v": "urn:v:"}).text()
    assert triples(rdf.from_text(spark, text, kind).quads) == triples(data.quads)


@pytest.mark.parametrize("kind", ["trig", "json-ld"])
def test_named_graphs_in_files(spark, tmp_path, kind):
    quads = rdf.from_text(spark, '<urn:g> { <urn:a> <urn:p> "x" . <urn:a> <urn:p> <urn:b> } <urn:c> <urn:p> 5 .', "trig").quads.repartition(3)
    writers.rdf(quads, kind).write(f"{tmp_path}/out")
    assert triples(rdf.read_files(spark, f"{tmp_path}/out", kind).quads) == triples(quads)
