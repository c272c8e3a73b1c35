"""Registered queries of the operators beyond SELECT: updates, inference, validation, graphs, text, geometry, mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import geo, graphs, shacl, shex, swrl, text_search
from quadrille.operators.rules import materialize
from quadrille.operators.update import update
from quadrille.plans.compiler import query
from quadrille.plans.rewrite import query_ql
from quadrille.sources import rml
from quadrille.sources.dataset import QuadTable
from quadrille.sources.rdf import from_text
from quadrille.sources.tables import dataset

P = "PREFIX v: <urn:v:> PREFIX c: <urn:c:> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> "
T = "@prefix v: <urn:v:> . @prefix c: <urn:c:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
Q = Callable[[SparkSession, str], DataFrame]


def quads(spark: SparkSession, sf: str, *only: str) -> QuadTable:
    return dataset(spark, sf, only=only).as_quads()


def flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


def with_ontology(spark: SparkSession, data: QuadTable, text: str) -> QuadTable:
    return QuadTable(data.quads.unionByName(from_text(spark, T + text).quads))


def inferred(only: tuple[str, ...], regime: str, ontology: str, predicate: str) -> Q:
    """What a regime adds of one predicate."""
    return lambda spark, sf: flat(materialize(with_ontology(spark, quads(spark, sf, *only), ontology), regime).quads.where(F.col("p") == predicate))


def shapes(only: tuple[str, ...], text: str) -> Q:
    return lambda spark, sf: shacl.validate(quads(spark, sf, *only), T + text).select(F.col("focus.v").alias("focus"), F.col("value.v").alias("value"), F.regexp_extract("component", "#?(\\w+)$", 1).alias("component"))


TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def updated(text: str, *only: str) -> Q:
    return lambda spark, sf: update(quads(spark, sf, *only), P + text).quads.select("g", F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


def construct(spark: SparkSession, sf: str) -> DataFrame:
    return flat(query(dataset(spark, sf, only=("documents",)), P + "CONSTRUCT { ?l v:spokenIn ?src } WHERE { ?d v:lang ?k ; v:source ?src BIND(IRI(CONCAT('urn:lang:', ?k)) AS ?l) }"))


def describe(spark: SparkSession, sf: str) -> DataFrame:
    return flat(query(dataset(spark, sf, only=("nation", "region")), "DESCRIBE <urn:d:nation/3>"))


def named_graph(spark: SparkSession, sf: str) -> DataFrame:
    data = dataset(spark, sf, only=("documents", "labels"), graphs={"documents": "urn:g:docs", "labels": "urn:g:labels"})
    return query(data, P + "SELECT ?g (STR(?x) AS ?d) { GRAPH ?g { ?x a ?c } }")


def negated_path(spark: SparkSession, sf: str) -> DataFrame:
    return query(dataset(spark, sf, only=("nation", "region")), P + "SELECT (STR(?x) AS ?s) (STR(?y) AS ?o) { ?x !(v:name|rdf:type) ?y }")


def rml_events(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("k"), "event_type")
    text = '@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> .\n<urn:m> rml:logicalSource [ rml:source "events" ; rml:referenceFormulation ql:CSV ] ; rr:subjectMap [ rr:template "urn:e/{id}" ; rr:class <urn:Event> ] ; rr:predicateObjectMap [ rr:predicate <urn:k> ; rr:objectMap [ rml:reference "k" ; rr:datatype <http://www.w3.org/2001/XMLSchema#integer> ] ] , [ rr:predicate <urn:kind> ; rr:objectMap [ rr:template "urn:kind/{event_type}" ] ] .'
    return flat(rml.execute(spark, text, {"events": events}).quads)


def ql(spark: SparkSession, sf: str) -> DataFrame:
    data = with_ontology(spark, quads(spark, sf, "customer", "supplier"), "c:Customer rdfs:subClassOf c:Partner . c:Supplier rdfs:subClassOf c:Partner .")
    return query_ql(data, P + "SELECT ?x { ?x a c:Partner }").select(F.col("x.v").alias("x"))


def swrl_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = swrl.parse_text("quality(?d, ?q) ^ toxic(?d, ?t) ^ swrlb:equal(?q, 1) ^ swrlb:lessThan(?t, 1) -> Good(?d)", {"": "urn:v:"})
    return flat(swrl.infer(quads(spark, sf, "labels"), rules).quads)


def shex_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    xsd = "http://www.w3.org/2001/XMLSchema#integer"
    schema = {"doc": {"expression": [{"predicate": "urn:v:lang", "value": {"values": ["en", "fr"]}}, {"predicate": "urn:v:toxic", "value": {"datatype": xsd, "maxInclusive": 0}, "min": 0, "max": 1}]}}
    out = shex.validate(quads(spark, sf, "documents", "labels"), schema, "doc")
    return out.select(F.col("node.v").alias("node"), "conforms")


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quality labels; a version without those of 0; one whose 0 became 2."""
    base = quads(spark, sf, "labels").quads.where("p = 'urn:v:quality'").select("s", "p", "o")
    ours = base.where("o.v <> '0'")
    theirs = base.withColumn("o", F.when(F.col("o.v") == "0", F.struct(F.col("o.k").alias("k"), F.lit("2").alias("v"), F.col("o.dt").alias("dt"), F.col("o.lang").alias("lang"))).otherwise(F.col("o")))
    return base, ours, theirs


def graph_diff(spark: SparkSession, sf: str) -> DataFrame:
    base, _, theirs = versions(spark, sf)
    return graphs.diff(base, theirs).select("change", F.col("s.v").alias("s"), F.col("o.v").alias("o"), "changed")


def merge3(spark: SparkSession, sf: str) -> DataFrame:
    m = graphs.merge3(*versions(spark, sf))
    return m.select(F.col("s.v").alias("s"), "state", F.size("objects").alias("n"))


def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.fingerprint(quads(spark, sf, "labels").quads)


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    found = text_search.bm25(spark.read.parquet(f"{sf}/documents.parquet"), "license released", "doc_id", "text", 20)
    return found.select("id", F.round("score", 9).alias("score"))


def text_filter(spark: SparkSession, sf: str) -> DataFrame:
    return query(dataset(spark, sf, only=("documents",)), P + "SELECT ?d { ?d v:text ?t FILTER(CONTAINS(LCASE(?t), 'icens')) }")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors' first two components as points on a plane of 20 by 20."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))


POINTS = "(select vec_id, embedding[1]::double * 10 as x, embedding[2]::double * 10 as y from embeddings)"


def geo_distance(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return p.select("vec_id", F.round(geo.point_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)), 9).alias("d"))


def geo_within_box(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where(geo.within_box(F.col("x"), F.col("y"), -1.0, -1.0, 1.0, 1.0)).select("vec_id")


def in_squares(middles: DataFrame, p: DataFrame, relation: str = "sfContains") -> DataFrame:
    """[square, vec_id]: points that the squares of side 0.5 around others have in the relation."""
    squares = middles.select(F.col("vec_id").alias("square"), F.format_string("POLYGON((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))", (F.col("x") - 0.25).cast("string"), (F.col("y") - 0.25).cast("string"), (F.col("x") + 0.25).cast("string"), (F.col("y") + 0.25).cast("string")).alias("g"))
    dots = p.select("vec_id", F.format_string("POINT(%s %s)", F.col("x").cast("string"), F.col("y").cast("string")).alias("h"))
    return geo.spatial_join(squares, dots, "g", "h", relation, 0.5).select("square", "vec_id")


def geo_join_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return in_squares(p, p)


def spatial_knn(spark: SparkSession, sf: str) -> DataFrame:
    return geo.nearest(points(spark, sf), 0.0, 0.0, 10).select("vec_id")


D = "'urn:d:documents/' || doc_id"
INT_TYPE = "http://www.w3.org/2001/XMLSchema#integer"
LABELS = f"select {D} as s, 'urn:v:quality' as p, quality::varchar as o from labels union all select {D}, 'urn:v:toxic', toxic::varchar from labels union all select {D}, '{TYPE}', 'urn:c:Labelled' from labels"
TURN = "'urn:d:turn/' || {0}.conv_id || '-' || {0}.turn"
LATER = f"select {TURN.format('a')} as s, '{{}}' as p, {TURN.format('b')} as o from conversations a join conversations b on a.conv_id = b.conv_id and {{}}"

OPERATIONS: dict[str, tuple[Q, str]] = {
    "named_graph": (named_graph, f"select 'urn:g:docs' as g, {D} as d from documents union all select 'urn:g:labels', {D} from labels"),
    "path_negated": (negated_path, "select 'urn:d:nation/' || n_nationkey as s, 'urn:d:region/' || n_regionkey as o from nation"),
    "construct": (construct, "select distinct 'urn:lang:' || lang as s, 'urn:v:spokenIn' as p, source as o from documents"),
    "describe": (describe, f"select 'urn:d:nation/3' as s, unnest(['{TYPE}', 'urn:v:name', 'urn:v:region']) as p, unnest(['urn:c:Nation', n_name, 'urn:d:region/' || n_regionkey]) as o from nation where n_nationkey = 3"),
    "update_insert_where": (updated("INSERT { ?d v:flagged true } WHERE { ?d v:toxic 1 }", "labels"), f"select null::varchar as g, * from ({LABELS} union all select {D}, 'urn:v:flagged', 'true' from labels where toxic = 1)"),
    "update_delete_where": (updated("DELETE { ?d ?p ?o } WHERE { ?d v:quality 0 ; ?p ?o }", "labels"), f"select null::varchar as g, * from ({LABELS}) where s not in (select {D} from labels where quality = 0)"),
    "graph_copy": (updated("COPY DEFAULT TO <urn:g:copy>", "labels"), f"select null::varchar as g, * from ({LABELS}) union all select 'urn:g:copy', * from ({LABELS})"),
    "rml_json_events": (rml_events, f"select 'urn:e/' || event_id as s, unnest(['{TYPE}', 'urn:k', 'urn:kind']) as p, unnest(['urn:Event', props->>'$.k', 'urn:kind/' || event_type]) as o from events"),
    "rdfs_subclass": (inferred(("labels",), "rdfs", "c:Labelled rdfs:subClassOf c:Judged . c:Judged rdfs:subClassOf c:Thing .", TYPE), f"select {D} as s, '{TYPE}' as p, unnest(['urn:c:Judged', 'urn:c:Thing']) as o from labels"),
    "rdfs_domain_range": (inferred(("nation",), "rdfs", "v:region rdfs:domain c:Part1 ; rdfs:range c:Whole .", TYPE), f"select 'urn:d:nation/' || n_nationkey as s, '{TYPE}' as p, 'urn:c:Part1' as o from nation union all select distinct 'urn:d:region/' || n_regionkey, '{TYPE}', 'urn:c:Whole' from nation"),
    "rl_transitive": (inferred(("conversations",), "owl2-rl", "v:next rdfs:subPropertyOf v:later . v:later a owl:TransitiveProperty .", "urn:v:later"), LATER.format("urn:v:later", "a.turn < b.turn")),
    "rl_inverse": (inferred(("conversations",), "owl2-rl", "v:next owl:inverseOf v:previous .", "urn:v:previous"), LATER.format("urn:v:previous", "a.turn = b.turn + 1")),
    "ql_rewrite": (ql, "select 'urn:d:customer/' || c_custkey as x from customer union all select 'urn:d:supplier/' || s_suppkey from supplier"),
    "swrl_rule": (swrl_rule, f"select {D} as s, '{TYPE}' as p, 'urn:v:Good' as o from labels where quality = 1 and toxic < 1"),
    "shacl_min_count": (shapes(("documents", "labels"), "<urn:S> a sh:NodeShape ; sh:targetClass c:Document ; sh:property [ sh:path v:toxic ; sh:minCount 1 ] ."), f"select {D} as focus, null::varchar as value, 'MinCountConstraintComponent' as component from documents where doc_id not in (select doc_id from labels)"),
    "shacl_datatype_range": (shapes(("part",), "<urn:S> a sh:NodeShape ; sh:targetClass c:Part ; sh:property [ sh:path v:size ; sh:datatype xsd:integer ; sh:maxInclusive 40 ] ."), "select 'urn:d:part/' || p_partkey as focus, p_size::varchar as value, 'MaxInclusiveConstraintComponent' as component from part where p_size > 40"),
    "shacl_pair": (shapes(("labels",), "<urn:S> a sh:NodeShape ; sh:targetClass c:Labelled ; sh:property [ sh:path v:toxic ; sh:lessThan v:quality ] ."), f"select {D} as focus, toxic::varchar as value, 'LessThanConstraintComponent' as component from labels where not toxic < quality"),
    "shacl_closed": (shapes(("nation",), "<urn:S> a sh:NodeShape ; sh:targetClass c:Nation ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ; sh:property [ sh:path v:name ] ."), "select 'urn:d:nation/' || n_nationkey as focus, 'urn:d:region/' || n_regionkey as value, 'ClosedConstraintComponent' as component from nation"),
    "shacl_qualified": (shapes(("nation", "region"), "<urn:S> a sh:NodeShape ; sh:targetClass c:Region ; sh:property [ sh:path [ sh:inversePath v:region ] ; sh:qualifiedValueShape [ sh:property [ sh:path v:name ; sh:pattern '[02468]$' ] ] ; sh:qualifiedMinCount 3 ] ."), "select 'urn:d:region/' || r_regionkey as focus, null::varchar as value, 'QualifiedMinCountConstraintComponent' as component from region where (select count(*) from nation where n_regionkey = r_regionkey and regexp_matches(n_name, '[02468]$')) < 3"),
    "shacl_logical": (shapes(("labels",), "<urn:S> a sh:NodeShape ; sh:targetClass c:Labelled ; sh:or ( [ sh:property [ sh:path v:quality ; sh:hasValue 1 ] ] [ sh:not [ sh:property [ sh:path v:toxic ; sh:hasValue 1 ] ] ] ) ."), f"select {D} as focus, {D} as value, 'OrConstraintComponent' as component from labels where quality <> 1 and toxic = 1"),
    "shex_cardinality": (shex_cardinality, f"select {D} as node, coalesce(lang in ('en', 'fr'), false) as conforms from documents left join labels using (doc_id)"),
    "graph_diff": (graph_diff, f"select 'removed' as change, {D} as s, '0' as o, true as changed from labels where quality = 0 union all select 'added', {D}, '2', true from labels where quality = 0"),
    "merge3": (merge3, f"select {D} as s, if(quality = 0, 'conflict', 'same') as state, if(quality = 0, 0, 1)::int as n from labels"),
    "facets": (lambda spark, sf: graphs.facets(quads(spark, sf, "labels", "nation").quads), f"select 'class' as facet, 'urn:c:Labelled' as value, count(*) as n from labels union all select 'class', 'urn:c:Nation', count(*) from nation union all select 'predicate', p, count(*) from (select unnest(['urn:v:quality', 'urn:v:toxic', '{TYPE}']) as p from labels union all select unnest(['urn:v:name', 'urn:v:region', '{TYPE}']) from nation) group by p"),
    "usage_counts": (lambda spark, sf: graphs.usage_counts(quads(spark, sf, "nation").quads), f"select 'predicate' as kind, p as name, count(*) as uses from (select unnest(['urn:v:name', 'urn:v:region', '{TYPE}']) as p from nation) group by p union all select 'class', 'urn:c:Nation', count(*) from nation"),
    "void_stats": (lambda spark, sf: graphs.void_stats(quads(spark, sf, "nation").quads), "select 3 * count(*) as triples, count(*) as subjects, 3::bigint as predicates, count(distinct n_name) + count(distinct n_regionkey) + 1 as objects, 1::bigint as classes, count(*) as entities from nation"),
    "usage_counts_all": (lambda spark, sf: graphs.usage_counts_mapped(dataset(spark, sf)), ""),
    "void_stats_all": (lambda spark, sf: graphs.void_stats_mapped(dataset(spark, sf)), ""),
    "text_bm25": (bm25, r"with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') as ts from documents), r as (select doc_id, len(ts) as l, len(list_filter(ts, lambda x: x = 'license')) as a, len(list_filter(ts, lambda x: x = 'released')) as b from t where len(ts) > 0), s as (select count(*) as n, avg(l) as m, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from r) select doc_id as id, round(if(a > 0, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)), 0) + if(b > 0, ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 0), 9) as score from r, s where a + b > 0 order by score desc, id limit 20"),
    "text_filter_exact": (text_filter, f"select {D} as d from documents where contains(lower(text), 'icens')"),
    "geo_distance": (geo_distance, f"select vec_id, round(sqrt(x * x + y * y), 9) as d from {POINTS}"),
    "geo_within_box": (geo_within_box, f"select vec_id from {POINTS} where x between -1 and 1 and y between -1 and 1"),
    "geo_join_grid": (geo_join_grid, f"select a.vec_id as square, b.vec_id from {POINTS} a, {POINTS} b where abs(b.x - a.x) < 0.25 and abs(b.y - a.y) < 0.25"),
    "spatial_knn": (spatial_knn, f"select vec_id from {POINTS} order by sqrt(x * x + y * y), vec_id, x, y limit 10"),
    "fingerprint": (fingerprint, ""),
}


def queries() -> dict[str, Q]:
    return {name: f for name, (f, _) in OPERATIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in OPERATIONS.items() if sql}
