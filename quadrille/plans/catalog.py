"""The registered SPARQL queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.plans.compiler import query
from quadrille.sources.tables import dataset

HEAD = "PREFIX c: <urn:c:> PREFIX v: <urn:v:> PREFIX n: <urn:d:nation/> PREFIX r: <urn:d:region/> "
FLAGSHIP = """SELECT ?name (xsd:double(SUM(?price)) AS ?revenue) (COUNT(*) AS ?items) {
    ?l v:order ?o ; v:price ?price . ?o v:customer ?c . ?c v:nation ?n . ?n v:name ?name ; a c:Nation } GROUP BY ?name"""
DEC2 = "cast({} as decimal(18,2))"

#: name: (SPARQL, DuckDB SQL)
SPARQL: dict[str, tuple[str, str]] = {
    "bgp_single": ("SELECT ?n ?name { ?n v:name ?name ; a c:Nation }", "select 'urn:d:nation/' || n_nationkey as n, n_name as name from nation"),
    "bgp_star": ("SELECT ?name ?segment ?nation { ?c v:name ?name ; v:segment ?segment ; v:nation ?nation }", "select c_name as name, c_mktsegment as segment, 'urn:d:nation/' || c_nationkey as nation from customer"),
    "bgp_join2": ("SELECT ?o ?segment { ?o v:customer ?c ; v:status 'F' . ?c v:segment ?segment }", "select 'urn:d:orders/' || o_orderkey as o, c_mktsegment as segment from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'"),
    "bgp_join3": (FLAGSHIP, "select n_name as name, sum(cast(l_extendedprice as decimal(18,2)))::double as revenue, count(*) as items from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"),
    "bgp_constant_subject": ("SELECT ?name ?region { n:3 v:name ?name ; v:region ?region }", "select n_name as name, 'urn:d:region/' || n_regionkey as region from nation where n_nationkey = 3"),
    "bgp_open_predicate": ("SELECT (STR(?o) AS ?v) ?p { r:1 ?p ?o }", "select 'urn:v:name' as p, r_name as v from region where r_regionkey = 1 union all select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:c:Region'"),
    "filter_compare": ("SELECT ?p ?size { ?p v:size ?size ; v:brand ?b FILTER(?size > 45) }", "select 'urn:d:part/' || p_partkey as p, p_size as size from part where p_size > 45"),
    "filter_logical3vl": ("SELECT ?p { ?p v:size ?size ; v:brand ?b FILTER(?size > 45 || ?nothing = 1 || !(?size != 7)) }", "select 'urn:d:part/' || p_partkey as p from part where p_size > 45 or p_size = 7"),
    "filter_in": ("SELECT ?p ?size { ?p v:size ?size FILTER(?size IN (1, 2, 42)) }", "select 'urn:d:part/' || p_partkey as p, p_size as size from part where p_size in (1, 2, 42)"),
    "filter_iri": ("SELECT ?c { ?c v:nation ?n ; v:segment ?s FILTER(?n = n:7) }", "select 'urn:d:customer/' || c_custkey as c from customer where c_nationkey = 7"),
    "filter_date": ("SELECT ?o ?date { ?o v:date ?date FILTER(?date >= '1997-01-01T00:00:00'^^xsd:dateTime) }", "select 'urn:d:orders/' || o_orderkey as o, o_orderdate as date from orders where o_orderdate >= timestamp '1997-01-01'"),
    "optional": ("SELECT ?d ?toxic { ?d v:lang 'en' ; a c:Document OPTIONAL { ?d v:toxic ?toxic } }", "select 'urn:d:documents/' || d.doc_id as d, toxic from documents d left join labels using (doc_id) where lang = 'en'"),
    "optional_same_row": ("SELECT ?t ?next { ?t v:number ?k ; v:role 'user' OPTIONAL { ?t v:next ?next } }", "with t as (select *, lead(turn) over (partition by conv_id order by turn) as n from conversations) select 'urn:d:turn/' || conv_id || '-' || turn as t, 'urn:d:turn/' || conv_id || '-' || n as next from t where role = 'user'"),
    "optional_filter": ("SELECT ?d ?q { ?d v:chars ?n OPTIONAL { ?d v:quality ?q FILTER(?n > 2000) } }", "select 'urn:d:documents/' || d.doc_id as d, l.quality as q from documents d left join labels l on d.doc_id = l.doc_id and n_chars > 2000"),
    "optional_chain": ("SELECT ?d ?t ?q { ?d v:chars ?n OPTIONAL { ?d v:toxic ?t FILTER(?t = 1) } OPTIONAL { ?d v:quality ?q FILTER(?t = 1) } }", "select 'urn:d:documents/' || d.doc_id as d, a.toxic as t, b.quality as q from documents d left join labels a on d.doc_id = a.doc_id and a.toxic = 1 left join labels b on d.doc_id = b.doc_id and a.toxic = 1"),
    "union": ("SELECT ?x ?name { { ?x v:name ?name ; a c:Region } UNION { ?x v:name ?name ; v:region r:1 } }", "select 'urn:d:region/' || r_regionkey as x, r_name as name from region union all select 'urn:d:nation/' || n_nationkey, n_name from nation where n_regionkey = 1"),
    "minus": ("SELECT ?d { ?d v:lang ?l MINUS { ?d v:toxic ?t } }", "select 'urn:d:documents/' || doc_id as d from documents where doc_id not in (select doc_id from labels)"),
    "minus_disjoint": ("SELECT ?r { ?r a c:Region MINUS { ?x v:size 1 } }", "select 'urn:d:region/' || r_regionkey as r from region"),
    "not_exists": ("SELECT ?c { ?c v:segment ?s FILTER NOT EXISTS { ?o v:customer ?c ; v:status 'F' } }", "select 'urn:d:customer/' || c_custkey as c from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')"),
    "exists": ("SELECT ?c { ?c v:balance ?b FILTER EXISTS { ?o v:customer ?c ; v:total ?t FILTER(?t > 400000 && ?b < 0) } }", "select 'urn:d:customer/' || c_custkey as c from customer where c_acctbal < 0 and exists (select 1 from orders where o_custkey = c_custkey and cast(o_totalprice as decimal(18,2)) > 400000)"),
    "exists_in_or": ("SELECT ?d { ?d v:chars ?n FILTER(?n > 9000 || EXISTS { ?d v:toxic 1 }) }", "select 'urn:d:documents/' || doc_id as d from documents where n_chars > 9000 or doc_id in (select doc_id from labels where toxic = 1)"),
    "bind_arith": ("SELECT ?o (xsd:double(?net) AS ?v) { ?l v:order ?o ; v:price ?p ; v:discount ?d BIND(?p * (1 - ?d) AS ?net) FILTER(?net > 50000) }", "select 'urn:d:orders/' || l_orderkey as o, (cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))))::double as v from lineitem where v > 50000"),
    "bind_sum": ("SELECT ?flag (xsd:double(SUM(?p * (1 - ?d) * (1 + ?t))) AS ?charge) { ?l v:price ?p ; v:discount ?d ; v:tax ?t ; v:flag ?flag } GROUP BY ?flag", "select l_returnflag as flag, sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))) * (1 + cast(l_tax as decimal(18,2))))::double as charge from lineitem group by all"),
    "values_inline": ("SELECT ?c ?s { VALUES ?s { 'BUILDING' 'MACHINERY' } ?c v:segment ?s }", "select 'urn:d:customer/' || c_custkey as c, c_mktsegment as s from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "values_undef": ("SELECT ?c ?s ?n { VALUES (?s ?n) { ('BUILDING' UNDEF) (UNDEF n:3) } ?c v:segment ?s ; v:nation ?n }", "select 'urn:d:customer/' || c_custkey as c, c_mktsegment as s, 'urn:d:nation/' || c_nationkey as n from customer where c_mktsegment = 'BUILDING' union all select 'urn:d:customer/' || c_custkey, c_mktsegment, 'urn:d:nation/' || c_nationkey from customer where c_nationkey = 3"),
    "agg_count": ("SELECT (COUNT(*) AS ?n) { ?l v:flag 'R' }", "select count(*) as n from lineitem where l_returnflag = 'R'"),
    "agg_count_distinct": ("SELECT ?s (COUNT(DISTINCT ?c) AS ?n) { ?o v:customer ?c ; v:status ?s } GROUP BY ?s", "select o_orderstatus as s, count(distinct o_custkey) as n from orders group by all"),
    "agg_sum_avg": ("SELECT ?f ?st (xsd:double(SUM(?q)) AS ?sum_qty) (xsd:double(SUM(?p)) AS ?sum_price) (COUNT(*) AS ?n) { ?l v:flag ?f ; v:state ?st ; v:quantity ?q ; v:price ?p } GROUP BY ?f ?st", "select l_returnflag as f, l_linestatus as st, sum(cast(l_quantity as decimal(18,2)))::double as sum_qty, sum(cast(l_extendedprice as decimal(18,2)))::double as sum_price, count(*) as n from lineitem group by all"),
    "agg_avg_int": ("SELECT ?b (xsd:integer(ROUND(AVG(?s))) AS ?mean) { ?p v:brand ?b ; v:size ?s } GROUP BY ?b", "select p_brand as b, floor(avg(p_size) + 0.5)::bigint as mean from part group by 1"),
    "agg_min_max": ("SELECT ?seg (xsd:double(MIN(?b)) AS ?lo) (xsd:double(MAX(?b)) AS ?hi) (MIN(?n) AS ?first) { ?c v:segment ?seg ; v:balance ?b ; v:name ?n } GROUP BY ?seg", "select c_mktsegment as seg, min(c_acctbal) as lo, max(c_acctbal) as hi, min(c_name) as first from customer group by all"),
    "agg_expression_key": ("SELECT ?y (COUNT(*) AS ?n) { ?o v:date ?d } GROUP BY (YEAR(?d) AS ?y)", "select year(o_orderdate) as y, count(*) as n from orders group by all"),
    "group_concat": ("SELECT ?r (GROUP_CONCAT(?name; SEPARATOR='|') AS ?names) { ?n v:region ?r ; v:name ?name } GROUP BY ?r", "select 'urn:d:region/' || n_regionkey as r, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey"),
    "having": ("SELECT ?b (COUNT(*) AS ?n) { ?p v:brand ?b ; v:size ?s } GROUP BY ?b HAVING (COUNT(*) > 80 && MAX(?s) = 50)", "select p_brand as b, count(*) as n from part group by 1 having count(*) > 80 and max(p_size) = 50"),
    "distinct": ("SELECT DISTINCT ?s ?p { ?o v:status ?s ; v:priority ?p }", "select distinct o_orderstatus as s, o_orderpriority as p from orders"),
    "order_limit_offset": ("SELECT ?o (xsd:double(?total) AS ?t) { ?o v:total ?total } ORDER BY DESC(?total) ?o LIMIT 10 OFFSET 5", "select 'urn:d:orders/' || o_orderkey as o, o_totalprice as t from orders order by t desc, o limit 10 offset 5"),
    "subquery_topn": ("SELECT ?name ?n { { SELECT ?c (COUNT(*) AS ?n) { ?o v:customer ?c } GROUP BY ?c ORDER BY DESC(?n) ?c LIMIT 5 } ?c v:name ?name }", "select c_name as name, n from (select o_custkey, count(*) as n from orders group by 1 order by n desc, 'urn:d:customer/' || o_custkey limit 5) join customer on o_custkey = c_custkey"),
    "theta_join": ("SELECT ?a ?b { ?a v:size ?x ; v:brand 'Brand#11' . ?b v:size ?y ; v:brand 'Brand#12' FILTER(?x < ?y) }", "select 'urn:d:part/' || a.p_partkey as a, 'urn:d:part/' || b.p_partkey as b from part a, part b where a.p_brand = 'Brand#11' and b.p_brand = 'Brand#12' and a.p_size < b.p_size"),
    "path_seq": ("SELECT ?c ?r { ?c v:nation/v:region ?r ; v:segment 'BUILDING' }", "select 'urn:d:customer/' || c_custkey as c, 'urn:d:region/' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING'"),
    "path_alt": ("SELECT ?x ?y { ?x (v:region|v:nation) ?y }", "select 'urn:d:nation/' || n_nationkey as x, 'urn:d:region/' || n_regionkey as y from nation union all select 'urn:d:customer/' || c_custkey, 'urn:d:nation/' || c_nationkey from customer union all select 'urn:d:supplier/' || s_suppkey, 'urn:d:nation/' || s_nationkey from supplier"),
    "path_inverse": ("SELECT ?r ?n { ?r ^v:region ?n }", "select 'urn:d:region/' || n_regionkey as r, 'urn:d:nation/' || n_nationkey as n from nation"),
    "path_plus": ("SELECT ?a ?b { ?a v:next+ ?b }", "select 'urn:d:turn/' || a.conv_id || '-' || a.turn as a, 'urn:d:turn/' || b.conv_id || '-' || b.turn as b from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn"),
    "path_plus_constant": ("SELECT ?b { <urn:d:turn/0-0> v:next+ ?b }", "select 'urn:d:turn/' || conv_id || '-' || turn as b from conversations where conv_id = 0 and turn > 0"),
    "path_star": ("SELECT (STR(?x) AS ?b) { <urn:d:turn/1-0> v:next* ?x }", "select 'urn:d:turn/' || conv_id || '-' || turn as b from conversations where conv_id = 1"),
    "path_optional": ("SELECT (STR(?x) AS ?b) { <urn:d:turn/1-0> v:next? ?x }", "select 'urn:d:turn/' || conv_id || '-' || turn as b from conversations where conv_id = 1 and turn < 2"),
    "path_composite": ("SELECT ?n ?m { ?n (v:region/^v:region) ?m }", "select 'urn:d:nation/' || a.n_nationkey as n, 'urn:d:nation/' || b.n_nationkey as m from nation a join nation b using (n_regionkey)"),
    "ask": ("ASK { ?o v:status 'F' ; v:priority '1-URGENT' }", "select count(*) > 0 as answer from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"),
    "fn_string": ("SELECT ?n (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 4) AS ?part) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (STRBEFORE(?n, '_') AS ?b) (STRAFTER(?n, '_') AS ?a) (CONCAT(?n, '!') AS ?c) (CONTAINS(?n, '1') AS ?one) (STRSTARTS(?n, 'N') AS ?st) (STRENDS(?n, '3') AS ?e) (ENCODE_FOR_URI(?n) AS ?u) { ?x v:name ?n ; a c:Nation }",
        "select n_name as n, length(n_name) as len, substr(n_name, 2, 4) as part, upper(n_name) as up, lower(n_name) as low, split_part(n_name, '_', 1) as b, split_part(n_name, '_', 2) as a, n_name || '!' as c, contains(n_name, '1') as one, starts_with(n_name, 'N') as st, ends_with(n_name, '3') as e, url_encode(n_name) as u from nation"),
    "fn_numeric": ("SELECT ?p (ABS(?s - 25) AS ?a) (?s * 2 + 1 AS ?m) (xsd:double(?s / 4) AS ?q) (xsd:double(ROUND(?r)) AS ?ro) (xsd:double(CEIL(?r)) AS ?ce) (xsd:double(FLOOR(?r)) AS ?fl) { ?p v:size ?s ; v:retail ?r }",
        "select 'urn:d:part/' || p_partkey as p, abs(p_size - 25) as a, p_size * 2 + 1 as m, p_size / 4 as q, floor(cast(p_retailprice as decimal(18,2)) + 0.5)::double as ro, ceil(cast(p_retailprice as decimal(18,2)))::double as ce, floor(cast(p_retailprice as decimal(18,2)))::double as fl from part"),
    "fn_datetime": ("SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) { ?o v:date ?d }", "select 'urn:d:orders/' || o_orderkey as o, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as dd, hour(o_orderdate) as h from orders"),
    "fn_hash": ("SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) { ?x v:name ?n ; a c:Supplier }", "select s_name as n, md5(s_name) as m, sha1(s_name) as s, sha256(s_name) as t from supplier"),
    "fn_cast": ("SELECT ?p (xsd:string(?s) AS ?t) (xsd:double(?s) AS ?d) (xsd:integer(?r) AS ?i) (xsd:boolean(?s - 1) AS ?b) { ?p v:size ?s ; v:retail ?r }", "select 'urn:d:part/' || p_partkey as p, p_size::varchar as t, p_size::double as d, trunc(cast(p_retailprice as decimal(18,2)))::bigint as i, p_size <> 1 as b from part"),
    "fn_regex_replace": ("SELECT ?n (REPLACE(?n, '[0-9]+', '#') AS ?r) { ?x v:name ?n ; a c:Customer FILTER REGEX(?n, '7$') }", "select c_name as n, regexp_replace(c_name, '[0-9]+', '#', 'g') as r from customer where regexp_matches(c_name, '7$')"),
    "fn_conditional": ("SELECT ?p (IF(?s > 25, 'big', 'small') AS ?k) (COALESCE(?none, ?s) AS ?c) { ?p v:size ?s }", "select 'urn:d:part/' || p_partkey as p, if(p_size > 25, 'big', 'small') as k, p_size as c from part"),
    "fn_terms": ("SELECT ?n (LANG(?n) AS ?l) (STR(DATATYPE(?n)) AS ?d) (isIRI(?x) AS ?i) (isLiteral(?x) AS ?j) (STR(?x) AS ?s) (sameTerm(?n, 'NATION_3') AS ?t) { ?x v:name ?n ; a c:Nation }", "select n_name as n, '' as l, 'http://www.w3.org/2001/XMLSchema#string' as d, true as i, false as j, 'urn:d:nation/' || n_nationkey as s, n_name = 'NATION_3' as t from nation"),
}


def runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(dataset(spark, sf_dir), HEAD + text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(text) for name, (text, _) in SPARQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SPARQL.items() if sql}
