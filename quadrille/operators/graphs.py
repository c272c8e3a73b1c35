"""Operations on whole graphs: diff, merge, snapshots, statistics, canonical labels, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.scalar import canonical
from quadrille.operators.storage import written
from quadrille.sources.dataset import RDF_TYPE, ClassMap, MappedTables, QuadTable
from quadrille.sources.rdf import lines
from quadrille.terms import BLANK, INT, IRI, IRI_T, OWL, RDF, RDFS, SH, STR, TERM, Type, Value, as_term, lexical, struct

TRIPLE = ["s", "p", "o"]


def graph(data: QuadTable, name: str | None) -> DataFrame:
    return data.quads.where(F.col("g").eqNullSafe(F.lit(name))).select(*TRIPLE)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """[change, s, p, o, changed]: triples added and removed; changed marks those whose (s, p) has both."""
    added, removed = new.select(*TRIPLE).distinct().join(old, TRIPLE, "left_anti"), old.select(*TRIPLE).distinct().join(new, TRIPLE, "left_anti")
    both = added.select(F.lit("added").alias("change"), *TRIPLE).unionByName(removed.select(F.lit("removed").alias("change"), *TRIPLE))
    sides = both.groupBy("s", "p").agg((F.count_distinct("change") == 2).alias("changed"))
    return both.join(sides, ["s", "p"]).select("change", *TRIPLE, "changed")


def ahead_behind(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """[ahead, behind]: triples that only we have, and that only they have."""
    a = ours.select(*TRIPLE).distinct().join(theirs, TRIPLE, "left_anti").agg(F.count("*").alias("ahead"))
    b = theirs.select(*TRIPLE).distinct().join(ours, TRIPLE, "left_anti").agg(F.count("*").alias("behind"))
    return a.crossJoin(b)


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, resolve: str = "conflict") -> DataFrame:
    """[s, p, objects, state]: a three-way merge of the sets of objects of each (s, p).

    A side that left a set as the base has it yields to the other. Where both changed it apart, resolve says
    whose set is taken: 'ours', 'theirs', 'base', 'union', or 'conflict' (no objects, the state says so).
    """

    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias(name))

    none = F.array().cast(f"array<{base.schema['o'].dataType.simpleString()}>")
    all3 = reduce(lambda a, b: a.join(b, ["s", "p"], "full_outer"), [sets(base, "b"), sets(ours, "x"), sets(theirs, "y")])
    b, x, y = (F.coalesce(c, none) for c in ("b", "x", "y"))
    choice = {"ours": x, "theirs": y, "base": b, "union": F.sort_array(F.array_union(x, y)), "conflict": none}[resolve]
    clean = F.when(x == y, x).when(x == b, y).when(y == b, x)
    state = F.when((x == b) & (y == b), "same").when(x == y, "both").when(x == b, "theirs").when(y == b, "ours").otherwise("conflict")
    return all3.select("s", "p", F.coalesce(clean, choice).alias("objects"), state.alias("state"))


def merged_triples(merged: DataFrame) -> DataFrame:
    return merged.select("s", "p", F.explode("objects").alias("o"))


def snapshot(data: QuadTable, graphs: dict[str, str]) -> QuadTable:
    """The dataset with a copy of each graph (old name: new name); the copies replace what is there."""
    names = list(graphs.values())
    pairs = F.create_map(*[F.lit(x) for kv in graphs.items() for x in kv])
    copies = data.quads.where(F.col("g").isin(*graphs)).select(pairs[F.col("g")].alias("g"), *TRIPLE)
    return QuadTable(data.quads.where(F.col("g").isNull() | ~F.col("g").isin(*names)).unionByName(copies))


restore = snapshot


def fingerprint(df: DataFrame) -> DataFrame:
    """[rows, fingerprint] of a result, whatever the order of its rows: sums of row hashes, so nothing is gathered."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.to_json(F.struct(F.col(c).alias("x"))), F.lit("{}")) for c in sorted(df.columns)])
    digest = F.sha2(text, 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("fingerprint"))


def void_stats(triples: DataFrame) -> DataFrame:
    """[triples, subjects, predicates, objects, classes, entities]."""
    typed = F.when(F.col("p") == RDF + "type", F.col("o"))
    return triples.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"), F.count_distinct(typed).alias("classes"), F.count_distinct(F.when(typed.isNotNull(), F.col("s"))).alias("entities"))


def usage_counts(triples: DataFrame) -> DataFrame:
    """[kind, name, uses]: how often each predicate is used and each class has an instance."""
    p = triples.groupBy("p").agg(F.count("*").alias("uses")).select(F.lit("predicate").alias("kind"), F.col("p").alias("name"), "uses")
    c = triples.where((F.col("p") == RDF + "type") & (F.col("o.k") == IRI)).groupBy(F.col("o.v").alias("name")).agg(F.count("*").alias("uses"))
    return p.unionByName(c.select(F.lit("class").alias("kind"), "name", "uses"))


# --- statistics of mapped tables, from their columns ------------------------------------------------


def table_counts(data: MappedTables) -> DataFrame:
    """[cls, p, n]: triples of each table by predicate, counted in one scan of each table."""
    parts = []
    for c in data.classes:
        there = F.expr(c.key).isNotNull()
        counted = [(RDF_TYPE, F.count_if(there))] + [(p, F.count_if(there & F.expr(x.column).isNotNull())) for p, x in c.properties.items()]
        row = c.table().agg(*[n.alias(f"n{j}") for j, (_, n) in enumerate(counted)])
        pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"n{j}").alias("n")) for j, (p, _) in enumerate(counted)])
        parts.append(row.select(F.lit(c.cls).alias("cls"), F.explode(pairs).alias("x")).select("cls", "x.p", "x.n").where("n > 0"))
    return reduce(DataFrame.unionByName, parts)


def usage_counts_mapped(data: MappedTables) -> DataFrame:
    """usage_counts of all triples of a mapping."""
    n = table_counts(data)
    p = n.groupBy("p").agg(F.sum("n").alias("uses")).select(F.lit("predicate").alias("kind"), F.col("p").alias("name"), "uses")
    return p.unionByName(n.where(F.col("p") == RDF_TYPE).groupBy(F.col("cls").alias("name")).agg(F.sum("n").alias("uses")).select(F.lit("class").alias("kind"), "name", "uses"))


def distinct_terms(columns: list[tuple[DataFrame, Column, Type]]) -> DataFrame:
    """[n]: how many different terms the columns of tables have. Columns of one type are compared as they are; terms of different types differ, IRIs where no prefix starts another."""
    prefixes = {t.prefix for _, _, t in columns if t.kind == "iri" and t.prefix}
    apart = not any(a != b and a.startswith(b) for a in prefixes for b in prefixes)
    groups: dict[Type, list[DataFrame]] = {}
    for df, col, t in columns:
        kind = df.select(col.alias("x")).schema["x"].dataType.simpleString()
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        if t.kind == "iri" and t.prefix and not (apart and whole):
            col, t = lexical(Value(col, t)), IRI_T
        elif t.kind == "lit" and t != STR and not (t == INT and whole):
            if kind not in ("double", "float"):  # of which 0 and -0 are one to distinct
                df, col = df.select(col.alias("y")).distinct(), F.col("y")
            col = lexical(Value(col, t))
        elif whole:
            col = col.cast("bigint")
        groups.setdefault(t, []).append(df.select(col.alias("x")).where("x is not null"))
    if TERM in groups or IRI_T in groups and any(t.prefix for t in groups):  # rare: terms of any kind, or texts of IRIs beside keys
        groups = {TERM: [df.select(as_term(Value(F.col("x"), t)).alias("x")) for t, dfs in groups.items() for df in dfs]}
    return reduce(DataFrame.unionByName, [reduce(DataFrame.unionByName, dfs).distinct().agg(F.count("*").alias("n")) for dfs in groups.values()]).agg(F.sum("n").alias("n"))


def void_stats_mapped(data: MappedTables) -> DataFrame:
    """void_stats of all triples of a mapping; every subject has a class there, so entities are subjects."""
    counts = table_counts(data)
    typed = F.when(F.col("p") == RDF_TYPE, F.col("cls"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triples"), F.count_distinct("p").alias("predicates"), F.count_distinct(typed).alias("classes"))

    def rows(c: ClassMap) -> DataFrame:
        return c.table().where(F.expr(c.key).isNotNull())

    subjects = distinct_terms([(rows(c), F.expr(c.key), c.subject) for c in data.classes]).withColumnRenamed("n", "subjects")
    objects = distinct_terms([(rows(c), F.expr(x.column), x.type) for c in data.classes for x in c.properties.values()]).withColumnRenamed("n", "objects")
    prefixes = {x.type.prefix for c in data.classes for x in c.properties.values() if x.type.kind == "iri"}
    if any(p is None or c.cls.startswith(p) for p in prefixes for c in data.classes):  # a class may be an object elsewhere
        return void_stats(data.quads)
    out = sums.crossJoin(subjects).crossJoin(objects)
    return out.select("triples", "subjects", "predicates", (F.col("objects") + F.col("classes")).alias("objects"), "classes", F.col("subjects").alias("entities"))


def facets(quads: DataFrame, most: int = 300) -> DataFrame:
    """[facet, value, n]: the most frequent classes, predicates and graphs; ties by value."""
    top = lambda df, name: df.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most).select(F.lit(name).alias("facet"), "value", "n")
    classes = quads.where((F.col("p") == RDF + "type") & (F.col("o.k") == IRI)).select(F.col("o.v").alias("value"))
    return top(classes, "class").unionByName(top(quads.select(F.col("p").alias("value")), "predicate")).unionByName(top(quads.where("g is not null").select(F.col("g").alias("value")), "graph"))


def resource_view(triples: DataFrame, name: str, most: int = 500) -> DataFrame:
    """[direction, p, other]: what a resource links to and what links to it."""
    out = triples.where((F.col("s.k") == IRI) & (F.col("s.v") == name)).orderBy("p", "o").limit(most).select(F.lit("out").alias("direction"), "p", F.col("o").alias("other"))
    back = triples.where((F.col("o.k") == IRI) & (F.col("o.v") == name)).orderBy("p", "s").limit(most).select(F.lit("in").alias("direction"), "p", F.col("s").alias("other"))
    return out.unionByName(back)


def suggest(triples: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """IRIs that start with a text, the most used first."""
    every = triples.select(F.explode(F.array(F.when(F.col("s.k") == IRI, F.col("s.v")), F.col("p"), F.when(F.col("o.k") == IRI, F.col("o.v")))).alias("iri"))
    return every.where(F.col("iri").startswith(prefix)).groupBy("iri").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "iri").limit(most)


#: Classes and predicates by which content is recognised, in the order in which kinds are tried.
KINDS = {
    "shapes": ([SH + "NodeShape", SH + "PropertyShape"], [SH + "property", SH + "targetClass", SH + "path"]),
    "model": ([OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "Ontology", OWL + "Restriction", RDFS + "Class", RDF + "Property"], [RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"]),
    "vocabulary": (["http://www.w3.org/2004/02/skos/core#" + n for n in ("Concept", "ConceptScheme", "Collection")], ["http://www.w3.org/2004/02/skos/core#" + n for n in ("broader", "narrower", "prefLabel", "inScheme")]),
    "entailment": (["http://www.w3.org/2003/11/swrl#Imp", SH + "SPARQLRule", SH + "TripleRule"], [SH + "rule"]),
}


def content_kind(quads: DataFrame) -> DataFrame:
    """[g, triples, evidence for each kind, kind] of each graph: the kind of most evidence, or instances."""
    typed = F.col("p") == RDF + "type"
    marks = {k: F.count_if((typed & F.col("o.v").isin(*cs)) | F.col("p").isin(*ps)) for k, (cs, ps) in KINDS.items()}
    counts = quads.groupBy("g").agg(F.count("*").alias("triples"), *[m.alias(k) for k, m in marks.items()])
    best = F.greatest(*[F.col(k) for k in KINDS])
    kind = reduce(lambda c, k: c.when(F.col(k) == best, k), list(KINDS), F.when(best == 0, "instances"))
    return counts.withColumn("kind", kind)


# --- blank nodes -------------------------------------------------------------------------------


def canonical_labels(triples: DataFrame) -> DataFrame:
    """[label, hash, c14n]: hashes of blank nodes by their surroundings, refined until the partition is stable; equal ones are told apart by their label."""
    blank = lambda c: F.col(f"{c}.k") == BLANK
    t = triples.where(blank("s") | blank("o")).select("s", "p", "o")
    nodes = t.where(blank("s")).select(F.col("s.v").alias("label")).unionByName(t.where(blank("o")).select(F.col("o.v").alias("label"))).distinct()
    colour = written(nodes.withColumn("hash", F.lit("")), "colours")
    before = -1
    while True:
        known = colour.select(F.col("label").alias("l"), F.col("hash").alias("h"))
        with_s = t.join(known, blank("s") & (F.col("s.v") == F.col("l")), "left").withColumn("hs", F.col("h")).drop("l", "h")
        both = with_s.join(known, blank("o") & (F.col("o.v") == F.col("l")), "left").withColumn("ho", F.col("h")).drop("l", "h")
        text = lambda c, h: F.when(blank(c), F.concat(F.lit("_:z"), F.coalesce(h, F.lit("")))).otherwise(canonical(Value(F.col(c), TERM)))
        out = both.where(blank("s")).select(F.col("s.v").alias("label"), F.concat_ws(" ", F.lit("_:a"), "p", F.when(F.col("o.v").eqNullSafe(F.col("s.v")) & blank("o"), F.lit("_:a")).otherwise(text("o", F.col("ho")))).alias("sig"))
        back = both.where(blank("o")).select(F.col("o.v").alias("label"), F.concat_ws(" ", text("s", F.col("hs")), "p", F.lit("_:a")).alias("sig"))
        sigs = out.unionByName(back).groupBy("label").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("sig"))), 256).alias("sig"))
        colour = written(colour.join(sigs, "label").select("label", F.sha2(F.concat("hash", "sig"), 256).alias("hash")), "colours")
        now = colour.agg(F.count_distinct("hash").alias("n")).first()["n"]
        if now == before:
            break
        before = now
    return colour.select("label", "hash", F.concat(F.lit("c14n"), (F.row_number().over(Window.orderBy("hash", "label")) - 1).cast("string")).alias("c14n"))


def relabelled(triples: DataFrame, labels: DataFrame, base: str | None = None) -> DataFrame:
    """Triples with canonical labels, or with IRIs under base (skolemised) if that is given."""
    named = labels.select(F.col("label").alias("l"), F.concat(F.lit(f"{base}/.well-known/genid/"), "hash").alias("n") if base else F.col("c14n").alias("n"))
    out = triples
    for c in ("s", "o"):
        is_blank = F.col(f"{c}.k") == BLANK
        new = F.when(F.col("n").isNotNull(), struct(IRI if base else BLANK, F.col("n"))).otherwise(F.col(c))
        out = out.join(named, is_blank & (F.col(f"{c}.v") == F.col("l")), "left").withColumn(c, new).drop("l", "n")
    return out.select(*triples.columns)


def deskolemised(triples: DataFrame, base: str) -> DataFrame:
    """The inverse of relabelled with a base."""
    prefix = f"{base}/.well-known/genid/"
    back = lambda c: F.when((F.col(f"{c}.k") == IRI) & F.col(f"{c}.v").startswith(prefix), struct(BLANK, F.concat(F.lit("g"), F.substring(f"{c}.v", len(prefix) + 1, 64)))).otherwise(F.col(c))
    return triples.withColumns({c: back(c) for c in ("s", "o")})


def revision(triples: DataFrame) -> DataFrame:
    """A hash of a graph's content, whatever its order and its blank labels."""
    return fingerprint(lines(relabelled(triples, canonical_labels(triples)).distinct()))
