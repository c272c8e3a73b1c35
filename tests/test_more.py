"""SWRL, OWL 2 QL, ShEx, browsing, saved queries, streaming ingestion."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import browse, geo, graphs, shex, swrl
from quadrille.plans import catalog, compiler, further, operations
from quadrille.plans.rewrite import query_ql
from quadrille.sources.dataset import ClassMap, MappedTables, Property
from quadrille.sources.rdf import from_text, lines
from quadrille.streaming.ingest import ingest, read_stream, table
from quadrille.terms import DATETIME, DBL, DEC, INT, IRI, LITERAL, STR, Term, Type

P = "@prefix : <urn:> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
XSD = "http://www.w3.org/2001/XMLSchema#"


def added(q):
    return {r["value"] for r in lines(q.quads).collect()}


def test_swrl(spark):
    d = from_text(spark, P + ":a a :Person ; :age 20 ; :parent :b . :b :brother :c ; :name 'xy' .")
    rules = swrl.parse_text("Person(?x) ^ age(?x, ?n) ^ swrlb:greaterThan(?n, 17) -> Adult(?x)\nparent(?x, ?y) ^ brother(?y, ?z) -> uncle(?x, ?z)\nuncle(?x, ?z) ^ age(?x, ?n) ^ swrlb:add(?n, 10, 10) -> twenty(?x, ?z)", {"": "urn:"})
    t = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    assert added(swrl.infer(d, rules)) == {f"<urn:a> {t} <urn:Adult> .", "<urn:a> <urn:uncle> <urn:c> .", "<urn:a> <urn:twenty> <urn:c> ."}
    xml = '<r xmlns:swrlx="urn:s" xmlns:ruleml="urn:r"><ruleml:Imp><ruleml:_body><swrlx:individualPropertyAtom swrlx:property="urn:parent"><ruleml:var>x</ruleml:var><ruleml:var>y</ruleml:var></swrlx:individualPropertyAtom></ruleml:_body><ruleml:_head><swrlx:individualPropertyAtom swrlx:property="urn:child"><ruleml:var>y</ruleml:var><ruleml:var>x</ruleml:var></swrlx:individualPropertyAtom></ruleml:_head></ruleml:Imp></r>'
    assert added(swrl.infer(d, swrl.parse_xml(xml))) == {"<urn:b> <urn:child> <urn:a> ."}


def test_ql(spark):
    d = from_text(spark, P + ":A rdfs:subClassOf :B . :p rdfs:domain :A ; rdfs:subPropertyOf :q . :r owl:inverseOf :q . :x a :A . :y :p :z . :w :r :v .")
    get = lambda t: sorted(r[0] for r in query_ql(d, "PREFIX : <urn:> " + t).selectExpr("to_json(struct(*))").collect())
    assert len(get("SELECT ?s { ?s a :B }")) == 2
    assert len(get("SELECT ?s ?o { ?s :q ?o }")) == 2
    assert len(get("SELECT ?s { ?s :q ?o . ?s a :B }")) == 1


SCHEMA = {
    "person": {"expression": [{"predicate": "urn:name", "value": {"datatype": XSD + "string", "minLength": 2}}, {"predicate": "urn:knows", "value": {"ref": "person"}, "min": 0, "max": None}], "closed": True, "extra": ["urn:note"]},
    "either": {"expression": [{"oneOf": [[{"predicate": "urn:name"}], [{"predicate": "urn:nick"}]]}]},
    "known": {"expression": [{"predicate": "urn:knows", "inverse": True}]},
}


def test_shex(spark):
    d = from_text(spark, P + ":a :name 'Ann' ; :knows :b ; :note 1 . :b :name 'Bo' . :c :name 'Cy' ; :knows :d . :d :nick 'D' . :e :name 'E' . :f :name 'Flo' ; :odd 1 .")
    ok = lambda shape, focus: {r["node"]["v"] for r in shex.validate(d, SCHEMA, shape, focus).where("conforms").collect()}
    every = [f"urn:{x}" for x in "abcdef"]
    assert ok("person", every) == {"urn:a", "urn:b"}
    assert ok("either", every) == set(every) and ok("known", every) == {"urn:b", "urn:d"}
    assert shex.validate(d, SCHEMA, "person").count() == 5


def test_browse(spark):
    q = from_text(spark, P + ":a :name 'Ann' ; :age 3 . :b :name 'Bob' ; :age 4 .").quads
    assert browse.browse(q, [("s", "exact", "urn:a", False), ("s", "exact", "urn:b", False), ("p", "contains", "NAME", False)]).count() == 2
    assert browse.browse(q, [("p", "regex", "age$", True)]).count() == 2
    assert browse.browse(q, q="ann OR bob").count() == 2 and browse.browse(q, q="name NOT (ann)").count() == 1 and browse.browse(q, q="ann XOR name").count() == 1 and browse.browse(q, q="").count() == 4
    feats = geo.boxes(spark.createDataFrame([(1, "POINT(1 1)"), (2, "POINT(9 9)")], "id int, wkt string"), "wkt")
    got = browse.geojson(feats, (0, 0, 2, 2)).collect()
    assert len(got) == 1 and got[0]["number_matched"] == 1 and '"type": "Point"' in got[0]["feature"]


def test_saved_queries(spark):
    text = browse.filled("SELECT ?s { ?s <urn:name> {{n}} FILTER(?s = {{i}}) }", {"n": "String", "i": "Iri"}, {"n": 'A"nn', "i": "urn:a"})
    assert text == 'SELECT ?s { ?s <urn:name> "A\\"nn" FILTER(?s = <urn:a>) }'
    with pytest.raises(ValueError, match="is no Integer"):
        browse.filled("{{x}}", {"x": "Integer"}, {"x": "1 } DROP ALL"})
    a, b = from_text(spark, P + ":a :p 1 ."), from_text(spark, P + ":a :p 2 .")
    f = "SELECT ?o { ?s <urn:p> ?o }"
    from quadrille.operators.graphs import fingerprint
    from quadrille.plans.compiler import query

    was = fingerprint(query(a, f)).first()["fingerprint"]
    assert browse.regression({"a": a, "b": b}, f, {"a": was, "b": was}) == {"a": "ok", "b": "changed"}
    assert browse.regression({"a": a}, "SELECT", {}) == {"a": "error"}


def test_streamed_quads(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.nq").write_text(f'<urn:a> <urn:p> "{i}" .\n<urn:a> <urn:p> "same" <urn:g> .\nbad\n')
        ingest(read_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert table(spark, str(tmp_path / "out")).quads.count() == 3


def test_swrl_does_not_stop_short_in_silence(spark):
    d = from_text(spark, P + ":a :next :b . :b :next :c . :c :next :d . :d :next :e . :a :on :a .")
    rules = swrl.parse_text("on(?x, ?y) ^ next(?y, ?z) -> on(?x, ?z)", {"": "urn:"})
    assert added(swrl.infer(d, rules)) == {f"<urn:a> <urn:on> <urn:{x}> ." for x in "bcde"}
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        swrl.infer(d, rules, rounds=2)


def most_in_a_task(df):
    return max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def test_products_are_dealt_over_tasks(spark, tmp_path):
    """Neither a product of two large sides nor a value that many rows of both sides have is one task's work."""
    spark.range(9000).selectExpr("id as p_partkey", "if(id % 2 = 0, 'Brand#11', 'Brand#12') as p_brand", "cast(id % 50 as int) as p_size", "'n' as p_name", "'t' as p_type", "1.0D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    want = sum(a < b for a in range(0, 50, 2) for b in range(1, 50, 2)) * 180 * 180
    got = catalog.queries()["theta_join"](spark, str(tmp_path))
    assert got.count() == want and most_in_a_task(got) < want / 2
    assert got.distinct().count() == want


def test_rows_with_one_value_are_dealt_over_tasks(spark, tmp_path):
    """Of optional_then_join the labels of two values, and documents without a label, meet in many tasks."""
    spark.range(12000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'s' as source", "1 as n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(9000).selectExpr("id * 2 as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = further.queries()["optional_then_join"](spark, str(tmp_path))
    want = 3000 * 4500 + 6000 * 4500  # quality 0, and no label
    assert got.count() == want and got.where("q <> 0").isEmpty() and most_in_a_task(got) < want / 1.8
    assert got.groupBy("d").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (4500, 4500, 9000)


def test_statistics_of_mapped_tables_are_those_of_their_triples(spark, monkeypatch):
    """Nulls, repeated keys, -0 and 0, equal texts of different types, one prefix of two tables, empty tables; no triple is made."""
    a = spark.createDataFrame([(1, "x", 0.0, 7, 1), (1, "x", -0.0, 7, 2), (2, None, float("nan"), None, 3), (None, "y", 1.5, 9, 4), (3, "7", None, 7, None)], "k int, s string, d double, i int, r int")
    b = spark.createDataFrame([(1, "x", "1.50"), (9, "7", "1.5"), (3, None, None)], "k bigint, s string, m string").selectExpr("k", "s", "cast(m as decimal(18,2)) m", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, k) as t")
    thing = Type("iri", prefix="urn:t/")
    classes = [
        ClassMap("a", lambda: a, "urn:c:A", "urn:t/", "k", {"urn:s": Property("s", STR), "urn:d": Property("d", DBL), "urn:i": Property("i", INT), "urn:r": Property("r", thing)}),
        ClassMap("b", lambda: b, "urn:c:B", "urn:t/", "k", {"urn:s": Property("s", STR), "urn:m": Property("cast(m as decimal(18,2))", DEC), "urn:t": Property("t", DATETIME)}),
        ClassMap("none", lambda: a.limit(0), "urn:c:None", "urn:u/", "s", {"urn:e": Property("s", STR)}),
    ]
    for own in (classes, classes[:1], classes[2:]):
        data = MappedTables(spark, own)
        stats, uses = graphs.void_stats(data.quads).collect(), {*map(tuple, graphs.usage_counts(data.quads).collect())}
        with monkeypatch.context() as m:
            m.setattr(MappedTables, "as_quads", None)
            assert graphs.void_stats_mapped(MappedTables(spark, own)).collect() == stats
            assert {*map(tuple, graphs.usage_counts_mapped(MappedTables(spark, own)).collect())} == uses
    with monkeypatch.context() as m:
        m.setattr(MappedTables, "as_quads", None)
        assert operations.queries()["usage_counts_all"](spark, "/root/testdata/sf0.001").count() > 40


def test_a_constant_of_a_path_is_looked_up_in_its_columns(spark, monkeypatch):
    """A zero-length path from a constant finds it where all nodes would have it, without making a triple."""
    sf, XS = "/root/testdata/sf0.001", "http://www.w3.org/2001/XMLSchema#"
    terms = [Term(IRI, "urn:d:nation/3"), Term(IRI, "urn:d:nation/999"), Term(IRI, "urn:d:nation/x"), Term(IRI, "urn:d:region/1"), Term(IRI, "urn:c:Nation"), Term(IRI, "urn:c:None"), Term(IRI, "urn:d:customer/7"), Term(IRI, "urn:elsewhere")]
    terms += [Term(LITERAL, "NATION_3", XS + "string"), Term(LITERAL, "NATION_3", XS + "token"), Term(LITERAL, "7", XS + "integer"), Term(LITERAL, "07", XS + "integer"), Term(LITERAL, "no", XS + "string")]
    only = ("nation", "region", "part")
    every = compiler.nodes(compiler.Context(operations.dataset(spark, sf, only=only))).df.persist()
    wanted = [every.where(compiler.matches(compiler.Value(F.col("s"), compiler.TERM), t, "")).collect() for t in terms]
    assert [len(w) for w in wanted] == [1, 0, 0, 1, 1, 0, 0, 0, 1, 0, 1, 0, 0]
    monkeypatch.setattr(MappedTables, "as_quads", None)
    ctx = compiler.Context(operations.dataset(spark, sf, only=only))
    assert [compiler.node(ctx, t).collect() for t in terms] == wanted
    assert {r["b"] for r in catalog.queries()["path_optional"](spark, sf).collect()} == {"urn:d:turn/1-0", "urn:d:turn/1-1"}
    assert {r["b"] for r in catalog.queries()["path_star"](spark, sf).collect()} >= {"urn:d:turn/1-0", "urn:d:turn/1-1"}
