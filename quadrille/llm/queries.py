"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, exact_dedup, exact_topk, language_id, license_scan, mixing, ngram_join, token_counts, toxicity, url_filters
from quadrille.llm.common import give_back, remainder, table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
RULES = [
    url_filters.Rule("block", "com", "/en/"),
    url_filters.Rule("allow", "example.com", "/en/7"),
    url_filters.Rule("allow", "net", "/de/"),
    url_filters.Rule("block", "example.net", "/de/8"),
    url_filters.Rule("block", "org", "/es/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def toxicity_index(spark: SparkSession, sf_dir: str) -> Broadcast:
    """The index of the labelled rows that are not held out, for the executors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(remainder("doc_id", 3) != 1)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    sent = spark.sparkContext.broadcast(toxicity.fit(docs, labels))
    give_back()
    return sent


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), toxicity_index(spark, sf_dir))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(remainder("doc_id", 4) != 2))
    out = language_id.identify(docs, profiles)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary(BYTES), full=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "mix.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_language_id, op4_url_filters, op5_exact_dedup, op6_bpe, op7_mixing, op8_ngram_join, op9_license_scan, op10_exact_topk)}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in RULES)
    return {
        "op4_url_filters": rf"""
            with parts as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
            cut as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{url_filters.UPPER}', '{url_filters.UPPER.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from parts),
            rules(verdict, h, p, rule) as (values {rules}),
            fits as (select page_id, arg_max(rules.rule, length(rules.rule)) as rule, arg_max(verdict, length(rules.rule)) as verdict from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
            select cut.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from cut left join fits using (page_id)""",
        "op5_exact_dedup": """
            select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window t as (partition by coalesce(text, ''))""",
        "op7_mixing": r"""
            with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, ('0x' || substr(md5('7:' || doc_id), 1, 15))::bigint as key from documents),
            s as (select source, sum(size)::bigint as source_size from d group by source),
            w as (select *, (row_number() over (order by source is null, source) - 1) % 3 + 1.0::double as w, 3.0::double * source_size as cap from s),
            l as (select *, coalesce(sum(cap) over o, 0.0) as f, coalesce(sum(w) over o, 0.0) as u, sum(w) over () as aw, sum(source_size) over () as a from w window o as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
            r as (select *, (a - f) / (aw - u) as rate from l),
            q as (select *, (select arg_min(rate, u) from r where rate * w < cap) as best from r),
            g as (select source, source_size, case when best is null then cap else least(cap, best * w) end::double as target from q),
            e as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from g),
            p as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size as rest, sum(d.size) over (partition by d.source order by key, doc_id) - d.size as before from d join e on d.source is not distinct from e.source)
            select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from p""",
        "op8_ngram_join": r"""
            with recursive words as (select doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as w from documents),
            sets as (select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
            classes as (select min(doc_id) as id, s, len(s) as n from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by s),
            one as (select id, n, unnest(s) as g from classes),
            common as (select x.id as a, y.id as b, x.n + y.n as total, count(*) as shared from one x join one y on x.g = y.g and x.id < y.id and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n group by all),
            links as (select a, b from common where 100 * shared >= 80 * (total - shared) union all select b, a from common where 100 * shared >= 80 * (total - shared)),
            reach(id, other) as (select id, id from classes union select reach.id, b from reach join links on other = a),
            least as (select id, min(other) as c from reach group by id),
            named as (select list_sort(s) as s, c from least join classes using (id))
            select doc_id, len(sets.s)::bigint as n_shingles, coalesce(c, doc_id) as component_id from sets left join named on list_sort(sets.s) = named.s""".replace("{upper}", url_filters.UPPER).replace("{lower}", url_filters.UPPER.lower()),
        "op10_exact_topk": """
            with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            p as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
            select query_id, rank::int as rank, vec_id, score from r where rank <= 10""",
    }
