"""Further registered queries: dataset clauses, updates, inference regimes, constraints, formats, relations, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import browse, graphs, text_search
from quadrille.operators.rules import inconsistencies
from quadrille.operators.storage import fresh_path
from quadrille.operators.update import batch
from quadrille.plans.compiler import query
from quadrille.plans.operations import LABELS, POINTS, TYPE, D, P, Q, flat, in_squares, inferred, points, quads, shapes, updated, with_ontology
from quadrille.sources import rdf, writers
from quadrille.sources.dataset import QuadTable
from quadrille.sources.tables import dataset

N = "'urn:d:nation/' || n_nationkey"
STAR = "<< ?d v:quality 1 >>"


def from_graph(text: str) -> Q:
    return lambda spark, sf: query(dataset(spark, sf, only=("documents", "labels"), graphs={"documents": "urn:g:docs", "labels": "urn:g:labels"}), P + text)


def over(text: str, *only: str) -> Q:
    return lambda spark, sf: query(dataset(spark, sf, only=only), P + text)


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written as N-Quads and read again."""
    path = fresh_path(spark, "lines")
    rdf.write_lines(quads(spark, sf, "labels").quads, path)
    return flat(rdf.read_lines(spark, path).quads)


def rewritten(kind: str) -> Q:
    """Labels written in a format and read again."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = fresh_path(spark, "document")
        writers.rdf(quads(spark, sf, "labels").quads, kind, {"v": "urn:v:"}).write(path)
        return flat(rdf.read_files(spark, path, kind).quads)

    return run


def results(kind: str) -> Q:
    """The lines of a result's document."""
    text = P + "SELECT ?x ?n ?r { ?x a c:Nation ; v:name ?n ; v:region ?r }"
    return lambda spark, sf: writers.results(writers.solutions(dataset(spark, sf, only=("nation",)), text), kind).lines


def batched(spark: SparkSession, sf: str) -> DataFrame:
    done, _ = batch(quads(spark, sf, "labels"), [P + "DELETE WHERE { ?d v:toxic ?t }", P + "INSERT { ?d v:seen true } WHERE { ?d v:quality 1 }"])
    return flat(done.quads)


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    found = graphs.snapshot(QuadTable(quads(spark, sf, "labels").quads.withColumn("g", F.lit("urn:g:now"))), {"urn:g:now": "urn:g:then"})
    return found.quads.select("g", F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


def disjoint_classes(spark: SparkSession, sf: str) -> DataFrame:
    data = with_ontology(spark, quads(spark, sf, "labels", "documents"), "c:Labelled owl:disjointWith c:Document .")
    return inconsistencies(data).groupBy("rule").agg(F.count("*").alias("n"))


def squares(spark: SparkSession, sf: str, relation: str) -> DataFrame:
    """Pairs of a square of side 0.5 around each point and the points that stand in the relation to it."""
    p = points(spark, sf)
    return in_squares(p, p, relation)


INSIDE = f"select a.vec_id as square, b.vec_id from {POINTS} a join {POINTS} b on abs(b.x - a.x) < 0.25 and abs(b.y - a.y) < 0.25"


def shape(only: tuple[str, ...], kind: str, constraint: str) -> Q:
    return shapes(only, f"<urn:S> a sh:NodeShape ; sh:targetClass c:{kind} ; {constraint} .")


def failed(component: str, focus: str, value: str, where: str) -> str:
    return f"select {focus} as focus, {value} as value, '{component}ConstraintComponent' as component from {where}"


FURTHER: dict[str, tuple[Q, str]] = {
    "from_one_graph": (from_graph("SELECT (STR(?d) AS ?s) FROM <urn:g:labels> { ?d a ?c }"), f"select {D} as s from labels"),
    "from_named_graph": (from_graph("SELECT ?g (STR(?d) AS ?s) FROM NAMED <urn:g:docs> { GRAPH ?g { ?d v:lang 'en' } }"), f"select 'urn:g:docs' as g, {D} as s from documents where lang = 'en'"),
    "graph_counts": (from_graph("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?d a ?c } } GROUP BY ?g"), "select 'urn:g:docs' as g, count(*) as n from documents union all select 'urn:g:labels', count(*) from labels"),
    "service_silent": (over("SELECT ?n { ?x a c:Nation ; v:name ?n SERVICE SILENT <urn:elsewhere> { ?x v:size ?s } }", "nation"), "select n_name as n from nation"),
    "cartesian": (over("SELECT (STR(?a) AS ?x) (STR(?b) AS ?y) { ?a a c:Region . ?b a c:Nation }", "nation", "region"), f"select 'urn:d:region/' || r_regionkey as x, {N} as y from region, nation"),
    "optional_then_join": (over("SELECT ?d ?q { ?d v:lang 'en' OPTIONAL { ?d v:quality ?q } { ?e v:toxic ?q . ?e v:quality 0 } }", "documents", "labels"), f"select {D} as d, e.toxic as q from documents left join labels l using (doc_id) join labels e on (l.quality = e.toxic or l.quality is null) and e.quality = 0 where lang = 'en'"),
    "grouped_then_join": (over("SELECT ?s ?n { { SELECT ?c (COUNT(?o) AS ?n) { ?o v:customer ?c } GROUP BY ?c } ?c v:segment ?s }", "orders", "customer"), "select c_mktsegment as s, n from (select o_custkey as k, count(*) as n from orders group by 1) join customer on k = c_custkey"),
    "zero_length_path_no_node": (over("SELECT (STR(?x) AS ?s) { <urn:absent> v:region* ?x }", "nation"), "select n_name as s from nation where false"),
    "sample": (over("SELECT ?r (SAMPLE(?r) AS ?s) { ?n v:region ?r } GROUP BY ?r", "nation"), "select distinct 'urn:d:region/' || n_regionkey as r, 'urn:d:region/' || n_regionkey as s from nation"),
    "fn_make_terms": (over("SELECT ?n (STR(STRDT(?n, <urn:t>)) AS ?a) (STR(DATATYPE(STRDT(?n, <urn:t>))) AS ?b) (LANG(STRLANG(?n, 'en')) AS ?c) { ?x a c:Nation ; v:name ?n }", "nation"), "select n_name as n, n_name as a, 'urn:t' as b, 'en' as c from nation"),
    "fn_time_parts": (over("SELECT ?o (MINUTES(?d) AS ?m) (TZ(?d) AS ?z) (ENCODE_FOR_URI(?p) AS ?e) { ?o v:date ?d ; v:priority ?p }", "orders"), "select 'urn:d:orders/' || o_orderkey as o, 0::bigint as m, '' as z, replace(o_orderpriority, ' ', '%20') as e from orders"),
    "quoted_triple": (lambda spark, sf: query(updated_quads(spark, sf), P + f"SELECT (STR(?d) AS ?s) {{ {STAR} v:by 'reviewer' }}"), f"select {D} as s from labels where quality = 1"),
    "update_insert_data": (updated("INSERT DATA { <urn:a> v:b 'c' . GRAPH <urn:g:new> { <urn:a> v:b 5 } }", "labels"), f"select null::varchar as g, * from ({LABELS}) union all select null, 'urn:a', 'urn:v:b', 'c' union all select 'urn:g:new', 'urn:a', 'urn:v:b', '5'"),
    "update_delete_data": (updated("DELETE DATA { <urn:d:nation/3> v:region <urn:d:region/1> , <urn:d:region/0> }", "nation"), f"select null::varchar as g, * from (select {N} as s, unnest(['{TYPE}', 'urn:v:name', 'urn:v:region']) as p, unnest(['urn:c:Nation', n_name, 'urn:d:region/' || n_regionkey]) as o from nation) where not (s = 'urn:d:nation/3' and p = 'urn:v:region' and o in ('urn:d:region/0', 'urn:d:region/1'))"),
    "update_delete_where_short": (updated("DELETE WHERE { ?d v:toxic 1 }", "labels"), f"select null::varchar as g, * from ({LABELS}) where not (p = 'urn:v:toxic' and o = '1')"),
    "graph_move": (updated("MOVE DEFAULT TO <urn:g:m>", "labels"), f"select 'urn:g:m' as g, * from ({LABELS})"),
    "graph_add": (updated("ADD DEFAULT TO <urn:g:a>", "labels"), f"select null::varchar as g, * from ({LABELS}) union all select 'urn:g:a', * from ({LABELS})"),
    "graph_clear": (updated("COPY DEFAULT TO <urn:g:a> ; CLEAR DEFAULT", "labels"), f"select 'urn:g:a' as g, * from ({LABELS})"),
    "update_batch": (batched, f"select * from ({LABELS}) where p <> 'urn:v:toxic' union all select {D}, 'urn:v:seen', 'true' from labels where quality = 1"),
    "snapshot": (snapshot, f"select unnest(['urn:g:now', 'urn:g:then']) as g, * from ({LABELS})"),
    "nquads_round_trip": (round_trip, LABELS),
    "turtle_round_trip": (rewritten("turtle"), LABELS),
    "trig_round_trip": (rewritten("trig"), LABELS),
    "rdf_xml_round_trip": (rewritten("xml"), LABELS),
    "json_ld_round_trip": (rewritten("json-ld"), LABELS),
    "results_json": (results("json"), f"""select '{{"x":{{"type":"uri","value":"' || {N} || '"}},"n":{{"type":"literal","value":"' || n_name || '"}},"r":{{"type":"uri","value":"urn:d:region/' || n_regionkey || '"}}}}' as value from nation"""),
    "results_xml": (results("xml"), f"""select '<result><binding name="x"><uri>' || {N} || '</uri></binding><binding name="n"><literal>' || n_name || '</literal></binding><binding name="r"><uri>urn:d:region/' || n_regionkey || '</uri></binding></result>' as value from nation"""),
    "results_csv": (results("csv"), f"select {N} || ',' || n_name || ',urn:d:region/' || n_regionkey as value from nation"),
    "results_tsv": (results("tsv"), f"""select '<' || {N} || '>' || chr(9) || '"' || n_name || '"' || chr(9) || '<urn:d:region/' || n_regionkey || '>' as value from nation"""),
    "rdfs_subproperty": (inferred(("labels",), "rdfs", "v:toxic rdfs:subPropertyOf v:judged .", "urn:v:judged"), f"select {D} as s, 'urn:v:judged' as p, toxic::varchar as o from labels"),
    "rl_same_as": (inferred(("nation",), "owl2-rl", "<urn:d:nation/3> owl:sameAs <urn:x> .", "urn:v:name"), "select 'urn:x' as s, 'urn:v:name' as p, n_name as o from nation where n_nationkey = 3"),
    "rl_has_value": (inferred(("labels",), "owl2-rl", "c:Bad owl:onProperty v:toxic ; owl:hasValue 1 .", TYPE), f"select {D} as s, '{TYPE}' as p, 'urn:c:Bad' as o from labels where toxic = 1"),
    "rl_equivalent_class": (inferred(("nation",), "owl2-rl", "c:Nation owl:equivalentClass c:Country .", TYPE), f"select {N} as s, '{TYPE}' as p, 'urn:c:Country' as o from nation"),
    "rl_symmetric": (inferred(("nation",), "owl2-rl", "v:region a owl:SymmetricProperty .", "urn:v:region"), f"select 'urn:d:region/' || n_regionkey as s, 'urn:v:region' as p, {N} as o from nation"),
    "rl_property_chain": (inferred(("customer", "nation"), "owl2-rl", "v:continent owl:propertyChainAxiom ( v:nation v:region ) .", "urn:v:continent"), "select 'urn:d:customer/' || c_custkey as s, 'urn:v:continent' as p, 'urn:d:region/' || n_regionkey as o from customer join nation on c_nationkey = n_nationkey"),
    "rl_some_values": (inferred(("nation",), "owl2-rl", "c:Placed owl:onProperty v:region ; owl:someValuesFrom owl:Thing .", TYPE), f"select {N} as s, '{TYPE}' as p, 'urn:c:Placed' as o from nation"),
    "rl_intersection": (inferred(("labels",), "owl2-rl", "c:Bad owl:onProperty v:toxic ; owl:hasValue 1 . c:Good owl:onProperty v:quality ; owl:hasValue 1 . c:Both owl:intersectionOf ( c:Bad c:Good ) .", TYPE), f"select {D} as s, '{TYPE}' as p, 'urn:c:Bad' as o from labels where toxic = 1 union all select {D}, '{TYPE}', 'urn:c:Good' from labels where quality = 1 union all select {D}, '{TYPE}', 'urn:c:Both' from labels where toxic = 1 and quality = 1"),
    "el_subclass": (inferred(("nation",), "owl2-el", "c:Nation rdfs:subClassOf c:Place . c:Place rdfs:subClassOf c:Thing .", TYPE), f"select {N} as s, '{TYPE}' as p, unnest(['urn:c:Place', 'urn:c:Thing']) as o from nation"),
    "dl_subclass": (inferred(("nation",), "owl2-dl", "c:Nation rdfs:subClassOf c:Place .", TYPE), f"select {N} as s, '{TYPE}' as p, 'urn:c:Place' as o from nation"),
    "rl_inconsistency": (disjoint_classes, "select 'cax-dw' as rule, count(*) as n from labels join documents using (doc_id)"),
    "shacl_pattern": (shape(("nation",), "Nation", "sh:property [ sh:path v:name ; sh:pattern '[0-4]$' ]"), failed("Pattern", N, "n_name", "nation where not regexp_matches(n_name, '[0-4]$')")),
    "shacl_in": (shape(("documents",), "Document", "sh:property [ sh:path v:lang ; sh:in ( 'en' 'fr' ) ]"), failed("In", D, "lang", "documents where lang not in ('en', 'fr')")),
    "shacl_length": (shape(("nation",), "Nation", "sh:property [ sh:path v:name ; sh:minLength 9 ; sh:maxLength 9 ]"), failed("MinLength", N, "n_name", "nation where length(n_name) < 9") + " union all " + failed("MaxLength", N, "n_name", "nation where length(n_name) > 9")),
    "shacl_class": (shape(("nation", "region"), "Nation", "sh:property [ sh:path v:region ; sh:class c:Nation ]"), failed("Class", N, "'urn:d:region/' || n_regionkey", "nation")),
    "shacl_node_kind": (shape(("nation",), "Nation", "sh:property [ sh:path v:name ; sh:nodeKind sh:IRI ]"), failed("NodeKind", N, "n_name", "nation")),
    "shacl_disjoint": (shape(("labels",), "Labelled", "sh:property [ sh:path v:toxic ; sh:disjoint v:quality ]"), failed("Disjoint", D, "toxic::varchar", "labels where toxic = quality")),
    "shacl_has_value": (shape(("labels",), "Labelled", "sh:property [ sh:path v:toxic ; sh:hasValue 0 ]"), failed("HasValue", D, "null::varchar", "labels where toxic <> 0")),
    "shacl_subjects_of": (shapes(("labels",), "<urn:S> a sh:NodeShape ; sh:targetSubjectsOf v:toxic ; sh:property [ sh:path v:quality ; sh:maxExclusive 1 ] ."), failed("MaxExclusive", D, "quality::varchar", "labels where quality >= 1")),
    "shacl_objects_of": (shapes(("nation",), "<urn:S> a sh:NodeShape ; sh:targetObjectsOf v:region ; sh:property [ sh:path v:name ; sh:minCount 1 ] ."), "select distinct 'urn:d:region/' || n_regionkey as focus, null::varchar as value, 'MinCountConstraintComponent' as component from nation"),
    "shacl_sparql": (shape(("labels",), "Labelled", "sh:sparql [ sh:select 'SELECT $this { $this <urn:v:toxic> 1 ; <urn:v:quality> 1 }' ]"), failed("SPARQL", D, D, "labels where toxic = 1 and quality = 1")),
    "resource_view": (lambda spark, sf: graphs.resource_view(quads(spark, sf, "nation").quads.select("s", "p", "o"), "urn:d:nation/3").select("direction", "p", F.col("other.v").alias("other")), f"select 'out' as direction, unnest(['{TYPE}', 'urn:v:name', 'urn:v:region']) as p, unnest(['urn:c:Nation', n_name, 'urn:d:region/' || n_regionkey]) as other from nation where n_nationkey = 3"),
    "resource_view_back": (lambda spark, sf: graphs.resource_view(quads(spark, sf, "nation").quads.select("s", "p", "o"), "urn:d:region/3").select("direction", "p", F.col("other.v").alias("other")), f"select 'in' as direction, 'urn:v:region' as p, {N} as other from nation where n_regionkey = 3"),
    "suggest": (lambda spark, sf: graphs.suggest(quads(spark, sf, "nation").quads, "urn:d:region/"), "select 'urn:d:region/' || n_regionkey as iri, count(*) as uses from nation group by 1"),
    "browse": (lambda spark, sf: flat(browse.browse(quads(spark, sf, "nation").quads, q="NATION_1 AND name", limit=1000)), f"select {N} as s, 'urn:v:name' as p, n_name as o from nation where contains(n_name, 'NATION_1')"),
    "ahead_behind": (lambda spark, sf: graphs.ahead_behind(quads(spark, sf, "labels").quads.where("p <> 'urn:v:toxic'").select("s", "p", "o"), quads(spark, sf, "labels").quads.where("p <> 'urn:v:quality'").select("s", "p", "o")), "select count(*) as ahead, count(*) as behind from labels"),
    "autocomplete": (lambda spark, sf: text_search.autocomplete(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("word")), "NATION_1").select("word"), "select n_name as word from nation where starts_with(n_name, 'NATION_1') order by length(n_name), n_name limit 10"),
    "geo_eh_contains": (lambda spark, sf: squares(spark, sf, "ehContains"), INSIDE),
    "geo_rcc8_ntppi": (lambda spark, sf: squares(spark, sf, "rcc8ntppi"), INSIDE),
    "geo_sf_intersects": (lambda spark, sf: squares(spark, sf, "sfIntersects"), INSIDE),
}


def updated_quads(spark: SparkSession, sf: str) -> QuadTable:
    from quadrille.operators.update import update

    return update(quads(spark, sf, "labels"), P + f"INSERT {{ {STAR} v:by 'reviewer' }} WHERE {{ ?d v:quality 1 }}")


def queries() -> dict[str, Q]:
    return {name: f for name, (f, _) in FURTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FURTHER.items()}
