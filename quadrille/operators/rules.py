"""Forward rules to a fix-point, semi-naively over DataFrames.

Facts are [s, p, o] of canonical texts (N-Triples terms), so that a predicate can also be a subject. A rule is
text: patterns, '=>', patterns; inequality as '?a != ?b'. In every round each rule is joined once for each of
its patterns with that pattern read from the newest facts and the others from all; rules whose vocabulary
does not occur are skipped. New facts are those not yet known (anti-join), written to the shared folder.

Inferred facts count as facts everywhere. Equality is by representatives: components of owl:sameAs are found
first in each round and their members' facts shared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scalar import canonical
from quadrille.operators.storage import written
from quadrille.sources.dataset import QuadTable
from quadrille.sources.rdf import parsed
from quadrille.terms import LITERAL, OWL, RDF, RDFS, TERM, XSD, Value, struct

NAMES = {"a": RDF + "type", "member": "urn:q:member", "length": "urn:q:length"}


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[tuple[str, str, str], ...]
    unequal: tuple[tuple[str, str], ...] = ()
    resources: tuple[str, ...] = ()  # variables that are no literals


def term(x: str) -> str:
    if x[0] in '?"<':
        return x
    if x in NAMES:
        return f"<{NAMES[x]}>"
    if ":" in x:
        prefix, local = x.split(":")
        return "<" + {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "q": "urn:q:", "xsd": XSD}[prefix] + local + ">"
    return x


def rule(text: str) -> Rule:
    name, _, rest = text.partition(" | ")
    left, right = rest.split("=>")
    unequal = tuple(tuple(m) for m in re.findall(r"(\?\w+) != (\?\w+)", left))
    resources = tuple(re.findall(r"resource\((\?\w+)\)", left))
    left = re.sub(r"\?\w+ != \?\w+|resource\(\?\w+\)", "", left)
    triples = lambda s: tuple(tuple(map(term, t.split())) for t in s.split(" . ") if t.strip(" .") and len(t.split()) == 3)
    return Rule(name.strip(), triples(left), triples(right), unequal, resources)


def rules(text: str) -> list[Rule]:
    return [rule(x) for x in text.strip().splitlines() if x.strip() and not x.strip().startswith("#")]


#: The entailment rules of the RDF Semantics recommendation.
RDFS_RULES = rules("""
rdfs2 | ?p rdfs:domain ?c . ?x ?p ?y => ?x a ?c
rdfs3 | ?p rdfs:range ?c . ?x ?p ?y . resource(?y) => ?y a ?c
rdfs5 | ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r => ?p rdfs:subPropertyOf ?r
rdfs7 | ?p rdfs:subPropertyOf ?q . ?x ?p ?y . ?p != ?q => ?x ?q ?y
rdfs9 | ?c rdfs:subClassOf ?d . ?x a ?c . ?c != ?d => ?x a ?d
rdfs11 | ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e => ?c rdfs:subClassOf ?e
rdfs12 | ?p a rdfs:ContainerMembershipProperty => ?p rdfs:subPropertyOf rdfs:member
rdfs13 | ?d a rdfs:Datatype => ?d rdfs:subClassOf rdfs:Literal
""")
#: Axiomatic consequences that are added once, after the others.
RDFS_AXIOMS = rules("""
rdfs1 | ?x ?p ?y => ?p a rdf:Property
rdfs4a | ?x ?p ?y => ?x a rdfs:Resource
rdfs4b | ?x ?p ?y . resource(?y) => ?y a rdfs:Resource
rdfs6 | ?p a rdf:Property => ?p rdfs:subPropertyOf ?p
rdfs8 | ?c a rdfs:Class => ?c rdfs:subClassOf rdfs:Resource
rdfs10 | ?c a rdfs:Class => ?c rdfs:subClassOf ?c
""")
#: The OWL 2 RL/RDF rules of the OWL 2 Profiles recommendation, equality aside.
RL_RULES = rules("""
prp-dom | ?p rdfs:domain ?c . ?x ?p ?y => ?x a ?c
prp-rng | ?p rdfs:range ?c . ?x ?p ?y . resource(?y) => ?y a ?c
prp-fp | ?p a owl:FunctionalProperty . ?x ?p ?y . ?x ?p ?z . resource(?y) . resource(?z) . ?y != ?z => ?y owl:sameAs ?z
prp-ifp | ?p a owl:InverseFunctionalProperty . ?x ?p ?y . ?z ?p ?y . ?x != ?z => ?x owl:sameAs ?z
prp-symp | ?p a owl:SymmetricProperty . ?x ?p ?y . resource(?y) => ?y ?p ?x
prp-trp | ?p a owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z => ?x ?p ?z
prp-spo1 | ?p rdfs:subPropertyOf ?q . ?x ?p ?y . ?p != ?q => ?x ?q ?y
prp-spo2-2 | ?p owl:propertyChainAxiom ?l . ?l length "2" . ?l q:item0 ?a . ?l q:item1 ?b . ?x ?a ?y . ?y ?b ?z => ?x ?p ?z
prp-spo2-3 | ?p owl:propertyChainAxiom ?l . ?l length "3" . ?l q:item0 ?a . ?l q:item1 ?b . ?l q:item2 ?c . ?x ?a ?y . ?y ?b ?z . ?z ?c ?w => ?x ?p ?w
prp-eqp1 | ?p owl:equivalentProperty ?q . ?x ?p ?y => ?x ?q ?y
prp-eqp2 | ?p owl:equivalentProperty ?q . ?x ?q ?y => ?x ?p ?y
prp-inv1 | ?p owl:inverseOf ?q . ?x ?p ?y . resource(?y) => ?y ?q ?x
prp-inv2 | ?p owl:inverseOf ?q . ?x ?q ?y . resource(?y) => ?y ?p ?x
prp-key | ?c owl:hasKey ?l . ?l length "1" . ?l q:item0 ?p . ?x a ?c . ?y a ?c . ?x ?p ?z . ?y ?p ?z . ?x != ?y => ?x owl:sameAs ?y
cls-int2 | ?c owl:intersectionOf ?l . ?l member ?d . ?x a ?c => ?x a ?d
cls-uni | ?c owl:unionOf ?l . ?l member ?d . ?x a ?d => ?x a ?c
cls-svf1 | ?c owl:someValuesFrom ?d . ?c owl:onProperty ?p . ?x ?p ?y . ?y a ?d => ?x a ?c
cls-svf2 | ?c owl:someValuesFrom owl:Thing . ?c owl:onProperty ?p . ?x ?p ?y => ?x a ?c
cls-avf | ?c owl:allValuesFrom ?d . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y . resource(?y) => ?y a ?d
cls-hv1 | ?c owl:hasValue ?y . ?c owl:onProperty ?p . ?x a ?c => ?x ?p ?y
cls-hv2 | ?c owl:hasValue ?y . ?c owl:onProperty ?p . ?x ?p ?y => ?x a ?c
cls-maxc2 | ?c owl:maxCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y . ?x ?p ?z . resource(?y) . resource(?z) . ?y != ?z => ?y owl:sameAs ?z
cls-maxqc3 | ?c owl:maxQualifiedCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?c owl:onClass ?d . ?x a ?c . ?x ?p ?y . ?y a ?d . ?x ?p ?z . ?z a ?d . ?y != ?z => ?y owl:sameAs ?z
cls-maxqc4 | ?c owl:maxQualifiedCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?c owl:onClass owl:Thing . ?x a ?c . ?x ?p ?y . ?x ?p ?z . resource(?y) . resource(?z) . ?y != ?z => ?y owl:sameAs ?z
cls-oo | ?c owl:oneOf ?l . ?l member ?x => ?x a ?c
cax-sco | ?c rdfs:subClassOf ?d . ?x a ?c . ?c != ?d => ?x a ?d
cax-eqc1 | ?c owl:equivalentClass ?d . ?x a ?c => ?x a ?d
cax-eqc2 | ?c owl:equivalentClass ?d . ?x a ?d => ?x a ?c
scm-cls | ?c a owl:Class => ?c rdfs:subClassOf ?c . ?c owl:equivalentClass ?c . ?c rdfs:subClassOf owl:Thing . owl:Nothing rdfs:subClassOf ?c
scm-sco | ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e => ?c rdfs:subClassOf ?e
scm-eqc1 | ?c owl:equivalentClass ?d => ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c
scm-eqc2 | ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c . ?c != ?d => ?c owl:equivalentClass ?d
scm-op | ?p a owl:ObjectProperty => ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-dp | ?p a owl:DatatypeProperty => ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-spo | ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r => ?p rdfs:subPropertyOf ?r
scm-eqp1 | ?p owl:equivalentProperty ?q => ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p
scm-eqp2 | ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p . ?p != ?q => ?p owl:equivalentProperty ?q
scm-dom1 | ?p rdfs:domain ?c . ?c rdfs:subClassOf ?d => ?p rdfs:domain ?d
scm-dom2 | ?q rdfs:domain ?c . ?p rdfs:subPropertyOf ?q => ?p rdfs:domain ?c
scm-rng1 | ?p rdfs:range ?c . ?c rdfs:subClassOf ?d => ?p rdfs:range ?d
scm-rng2 | ?q rdfs:range ?c . ?p rdfs:subPropertyOf ?q => ?p rdfs:range ?c
scm-hv | ?c owl:hasValue ?i . ?c owl:onProperty ?p . ?d owl:hasValue ?i . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q => ?c rdfs:subClassOf ?d
scm-svf1 | ?c owl:someValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?z . ?d owl:onProperty ?p . ?y rdfs:subClassOf ?z => ?c rdfs:subClassOf ?d
scm-svf2 | ?c owl:someValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?y . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q => ?c rdfs:subClassOf ?d
scm-avf1 | ?c owl:allValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:allValuesFrom ?z . ?d owl:onProperty ?p . ?y rdfs:subClassOf ?z => ?c rdfs:subClassOf ?d
scm-avf2 | ?c owl:allValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:allValuesFrom ?y . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q => ?d rdfs:subClassOf ?c
scm-int | ?c owl:intersectionOf ?l . ?l member ?d => ?c rdfs:subClassOf ?d
scm-uni | ?c owl:unionOf ?l . ?l member ?d => ?d rdfs:subClassOf ?c
""")
#: Patterns that show an inconsistency.
RL_CHECKS = rules("""
eq-diff1 | ?x owl:sameAs ?y . ?x owl:differentFrom ?y => ?x q:clash ?y
prp-irp | ?p a owl:IrreflexiveProperty . ?x ?p ?x => ?x q:clash ?p
prp-asyp | ?p a owl:AsymmetricProperty . ?x ?p ?y . ?y ?p ?x => ?x q:clash ?y
prp-pdw | ?p owl:propertyDisjointWith ?q . ?x ?p ?y . ?x ?q ?y => ?x q:clash ?y
prp-npa1 | ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetIndividual ?y . ?x ?p ?y => ?x q:clash ?y
prp-npa2 | ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetValue ?y . ?x ?p ?y => ?x q:clash ?n
cls-nothing2 | ?x a owl:Nothing => ?x q:clash owl:Nothing
cls-com | ?c owl:complementOf ?d . ?x a ?c . ?x a ?d => ?x q:clash ?c
cls-maxc1 | ?c owl:maxCardinality "0"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y => ?x q:clash ?c
cls-maxqc1 | ?c owl:maxQualifiedCardinality "0"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?c owl:onClass ?d . ?x a ?c . ?x ?p ?y . ?y a ?d => ?x q:clash ?c
cls-maxqc2 | ?c owl:maxQualifiedCardinality "0"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?c owl:onClass owl:Thing . ?x a ?c . ?x ?p ?y => ?x q:clash ?c
cax-dw | ?c owl:disjointWith ?d . ?x a ?c . ?x a ?d => ?x q:clash ?c
cax-adc | ?k a owl:AllDisjointClasses . ?k owl:members ?l . ?l member ?c . ?l member ?d . ?x a ?c . ?x a ?d . ?c != ?d => ?x q:clash ?c
""")
#: Completion rules of OWL 2 EL over named classes, with the typing of individuals.
EL_RULES = rules("""
el-sub | ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e => ?c rdfs:subClassOf ?e
el-eq | ?c owl:equivalentClass ?d => ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c
el-int | ?c owl:intersectionOf ?l . ?l member ?d => ?c rdfs:subClassOf ?d
el-exists | ?c rdfs:subClassOf ?r . ?r owl:onProperty ?p . ?r owl:someValuesFrom ?d . ?d rdfs:subClassOf ?e . ?s owl:someValuesFrom ?e . ?s owl:onProperty ?p => ?c rdfs:subClassOf ?s
el-role | ?c rdfs:subClassOf ?r . ?r owl:onProperty ?p . ?r owl:someValuesFrom ?d . ?p rdfs:subPropertyOf ?q . ?s owl:someValuesFrom ?d . ?s owl:onProperty ?q => ?c rdfs:subClassOf ?s
el-trans | ?p a owl:TransitiveProperty . ?c rdfs:subClassOf ?r . ?r owl:onProperty ?p . ?r owl:someValuesFrom ?d . ?d rdfs:subClassOf ?s . ?s owl:onProperty ?p . ?s owl:someValuesFrom ?e => ?c rdfs:subClassOf ?s
el-bottom | ?c rdfs:subClassOf ?r . ?r owl:someValuesFrom ?d . ?d rdfs:subClassOf owl:Nothing => ?c rdfs:subClassOf owl:Nothing
el-type | ?c rdfs:subClassOf ?d . ?x a ?c => ?x a ?d
el-some | ?c owl:someValuesFrom ?d . ?c owl:onProperty ?p . ?x ?p ?y . ?y a ?d => ?x a ?c
el-dom | ?p rdfs:domain ?c . ?x ?p ?y => ?x a ?c
el-rng | ?p rdfs:range ?c . ?x ?p ?y . resource(?y) => ?y a ?c
el-spo | ?p rdfs:subPropertyOf ?q . ?x ?p ?y => ?x ?q ?y
el-spo-spo | ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r => ?p rdfs:subPropertyOf ?r
el-chain2 | ?p owl:propertyChainAxiom ?l . ?l length "2" . ?l q:item0 ?a . ?l q:item1 ?b . ?x ?a ?y . ?y ?b ?z => ?x ?p ?z
el-chain3 | ?p owl:propertyChainAxiom ?l . ?l length "3" . ?l q:item0 ?a . ?l q:item1 ?b . ?l q:item2 ?c . ?x ?a ?y . ?y ?b ?z . ?z ?c ?w => ?x ?p ?w
el-key | ?c owl:hasKey ?l . ?l length "1" . ?l q:item0 ?p . ?x a ?c . ?y a ?c . ?x ?p ?z . ?y ?p ?z . ?x != ?y => ?x owl:sameAs ?y
el-hv1 | ?c owl:hasValue ?y . ?c owl:onProperty ?p . ?x a ?c => ?x ?p ?y
el-hv2 | ?c owl:hasValue ?y . ?c owl:onProperty ?p . ?x ?p ?y => ?x a ?c
""")
#: What OWL 2 DL adds beside RL, without a tableau.
DL_RULES = rules("""
dl-self1 | ?c owl:hasSelf "true"^^<http://www.w3.org/2001/XMLSchema#boolean> . ?c owl:onProperty ?p . ?x a ?c => ?x ?p ?x
dl-self2 | ?c owl:hasSelf "true"^^<http://www.w3.org/2001/XMLSchema#boolean> . ?c owl:onProperty ?p . ?x ?p ?x => ?x a ?c
dl-dju | ?c owl:disjointUnionOf ?l . ?l member ?d => ?d rdfs:subClassOf ?c
dl-dju-dw | ?c owl:disjointUnionOf ?l . ?l member ?d . ?l member ?e . ?d != ?e => ?d owl:disjointWith ?e
dl-key2 | ?c owl:hasKey ?l . ?l length "2" . ?l q:item0 ?p . ?l q:item1 ?q . ?x a ?c . ?y a ?c . ?x ?p ?z . ?y ?p ?z . ?x ?q ?w . ?y ?q ?w . ?x != ?y => ?x owl:sameAs ?y
dl-card1 | ?c owl:cardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y . ?x ?p ?z . resource(?y) . resource(?z) . ?y != ?z => ?y owl:sameAs ?z
""")
REGIMES = {"rdfs": RDFS_RULES, "owl2-rl": RL_RULES, "owl2-el": EL_RULES, "owl2-dl": RL_RULES + DL_RULES}

SAME, TYPE = f"<{OWL}sameAs>", f"<{RDF}type>"


def encoded(data: QuadTable, graphs: tuple[str, ...] | None = None) -> DataFrame:
    """[s, p, o] as texts, of the default graph or of some named ones."""
    q = data.quads.where("g is null") if graphs is None else data.quads.where(F.col("g").isin(*graphs))
    text = lambda c: canonical(Value(F.col(c), TERM))
    return q.select(text("s").alias("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), text("o").alias("o")).distinct()


def decoded(facts: DataFrame, graph: str | None) -> QuadTable:
    return QuadTable(facts.select(F.lit(graph).cast("string").alias("g"), parsed(F.col("s")).alias("s"), F.regexp_replace("p", "^<|>$", "").alias("p"), parsed(F.col("o")).alias("o")))


def list_facts(facts: DataFrame) -> DataFrame:
    """RDF lists as facts: (head, member, item), (head, itemN, item) for N below 8 and (head, length, number)."""
    rest = facts.where(F.col("p") == f"<{RDF}rest>").select(F.col("s").alias("cell"), F.col("o").alias("next"))
    first = facts.where(F.col("p") == f"<{RDF}first>").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    heads = first.select("cell").join(rest.select(F.col("next").alias("cell")), "cell", "left_anti")
    walk = heads.select(F.col("cell").alias("head"), "cell", F.lit(0).alias("at"))
    parts = []
    while not (walk := written(walk, "lists")).isEmpty():
        parts.append(walk.join(first, "cell").select("head", "at", "item"))
        walk = walk.join(rest, "cell").where(F.col("next") != f"<{RDF}nil>").select("head", F.col("next").alias("cell"), F.col("at") + 1)
        walk = walk.toDF("head", "cell", "at")
    if not parts:
        return facts.limit(0)
    items = reduce(DataFrame.unionByName, parts)
    t = lambda s, p, o: items.select(F.col(s).alias("s"), p.alias("p"), o.alias("o"))
    size = items.groupBy("head").agg(F.count("*").cast("string").alias("n")).select(F.col("head").alias("s"), F.lit("<urn:q:length>").alias("p"), F.concat(F.lit('"'), "n", F.lit('"')).alias("o"))
    place = F.concat(F.lit("<urn:q:item"), F.col("at").cast("string"), F.lit(">"))
    return t("head", F.lit("<urn:q:member>"), F.col("item")).unionByName(t("head", place, F.col("item"))).unionByName(size).distinct()


def apply(r: Rule, tables: list[DataFrame]) -> DataFrame | None:
    """The heads of a rule, each of its patterns read from its own table."""
    out: DataFrame | None = None
    for (s, p, o), facts in sorted(zip(r.body, tables, strict=True), key=lambda x: sum(t[0] == "?" for t in x[0])):
        df, cols = facts, {}
        for name, t in zip("spo", (s, p, o), strict=True):
            if t[0] != "?":
                df = df.where(F.col(name) == t)
            elif t in cols:
                df = df.where(F.col(name) == F.col(cols[t]))
            else:
                cols[t] = name
        df = df.select(*[F.col(n).alias(v[1:]) for v, n in cols.items()])
        if out is None:
            out = df
        else:
            shared = [c for c in df.columns if c in out.columns]
            out = out.join(df, shared) if shared else out.crossJoin(df)
    assert out is not None
    for a, b in r.unequal:
        out = out.where(F.col(a[1:]) != F.col(b[1:]))
    for v in r.resources:
        out = out.where(~F.col(v[1:]).startswith('"'))
    cell = lambda t: F.col(t[1:]) if t[0] == "?" else F.lit(t)
    heads = [F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o")) for s, p, o in r.head]
    return out.select(F.explode(F.array(*heads)).alias("h")).select("h.*").where(~F.col("s").startswith('"') & F.col("p").startswith("<"))


def vocabulary(rs: list[Rule]) -> tuple[set[str], set[str]]:
    preds = {p for r in rs for _, p, _ in r.body if p[0] != "?"}
    return preds, {o for r in rs for _, p, o in r.body if p == TYPE and o[0] != "?"}


def occurring(facts: DataFrame, preds: set[str], classes: set[str]) -> set[tuple[str, str]]:
    """The (predicate, class) pairs of the rules' vocabulary in the facts; as many as the rules name at most."""
    typed = F.when((F.col("p") == TYPE) & F.col("o").isin(*classes), F.col("o")).otherwise("") if classes else F.lit("")
    return {(r["p"], r["o"]) for r in facts.where(F.col("p").isin(*preds)).select("p", typed.alias("o")).distinct().collect()} | {(TYPE, "")}


def can_match(pattern: tuple[str, str, str], there: set[tuple[str, str]]) -> bool:
    _, p, o = pattern
    return p[0] == "?" or ((p, o) in there if p == TYPE and o[0] != "?" else any(x == p for x, _ in there))


def intersections(facts: DataFrame) -> DataFrame:
    """cls-int1 for lists of any length: subjects that have all members' types."""
    of = facts.where(F.col("p") == f"<{OWL}intersectionOf>").select(F.col("s").alias("c"), F.col("o").alias("l"))
    member = facts.where(F.col("p") == "<urn:q:member>").select(F.col("s").alias("l"), F.col("o").alias("d"))
    size = facts.where(F.col("p") == "<urn:q:length>").select(F.col("s").alias("l"), F.regexp_replace("o", '"', "").cast("int").alias("n"))
    typed = facts.where(F.col("p") == TYPE).select(F.col("s").alias("x"), F.col("o").alias("d"))
    have = of.join(member, "l").join(typed, "d").groupBy("c", "l", "x").agg(F.count_distinct("d").alias("have"))
    return have.join(size, "l").where("have = n").select(F.col("x").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def equality(facts: DataFrame) -> DataFrame:
    """eq-sym, eq-trans and eq-rep: the members of a sameAs component share their facts (through its least member)."""
    from quadrille.operators.components import connected_components

    same = facts.where(F.col("p") == SAME)
    if same.isEmpty():
        return facts.limit(0)
    member = written(connected_components(same, "s", "o"), "same")
    to_rep = lambda df, c: df.join(member.withColumnRenamed("node", c), c, "left").withColumn(f"{c}_r", F.coalesce("component", c)).drop("component")
    reps = facts
    for c in "spo":
        reps = to_rep(reps, c)
    core = reps.where("s <> s_r or p <> p_r or o <> o_r").select("s_r", "p_r", "o_r").distinct()
    touched = core.unionByName(reps.join(member.select(F.col("component").alias("s_r")).distinct(), "s_r", "left_semi").select("s_r", "p_r", "o_r")).distinct()
    for c in "spo":
        out = member.select(F.col("component").alias(f"{c}_r"), F.col("node").alias(f"{c}_m"))
        touched = touched.join(out, f"{c}_r", "left").withColumn(c, F.coalesce(f"{c}_m", f"{c}_r")).drop(f"{c}_m")
    pairs = member.alias("a").join(member.withColumnRenamed("node", "other").alias("b"), "component").select(F.col("node").alias("s"), F.lit(SAME).alias("p"), F.col("other").alias("o"))
    return touched.select("s", "p", "o").unionByName(pairs).where(~F.col("s").startswith('"'))


def materialize(data: QuadTable, regime: str | list[Rule] = "rdfs", graphs: tuple[str, ...] | None = None, target: str | None = None, axioms: bool = False) -> QuadTable:
    """What the rules add to the facts, in the target graph (default urn:entailment:<regime>)."""
    rs = REGIMES[regime] if isinstance(regime, str) else regime
    name = regime if isinstance(regime, str) else "rules"
    own = written(encoded(data, graphs), "facts")
    owl = name.startswith("owl2")
    base = written(own.unionByName(list_facts(own)).distinct(), "facts") if owl else own
    facts, delta = base, base
    preds, classes = vocabulary(rs)
    present = occurring(facts, preds, classes)
    while True:
        fresh = occurring(delta, preds, classes)
        present |= fresh
        made = []
        for r in rs:
            if not all(can_match(b, present) for b in r.body):
                continue
            for i, b in enumerate(r.body):
                if can_match(b, fresh):
                    made.append(apply(r, [delta if j == i else facts for j in range(len(r.body))]))
        if owl and any(p == f"<{OWL}intersectionOf>" for p, _ in occurring(facts, {f"<{OWL}intersectionOf>"}, set())):
            made.append(intersections(facts))
        if owl:
            made.append(equality(facts))
        if not made:
            break
        new = written(reduce(DataFrame.unionByName, made).distinct().join(facts, ["s", "p", "o"], "left_anti"), "facts")
        if new.isEmpty():
            break
        facts, delta = written(facts.unionByName(new), "facts"), new
    if axioms:
        extra = reduce(DataFrame.unionByName, [apply(r, [facts] * len(r.body)) for r in RDFS_AXIOMS])
        facts = facts.unionByName(extra).distinct()
    added = facts.where(~F.col("p").startswith("<urn:q:")).join(own, ["s", "p", "o"], "left_anti")
    return decoded(added.distinct(), target or f"urn:entailment:{name}")


#: Literals longer than this are known by their digest where only their equality counts.
LONG, DIGEST = 64, "urn:q:digest"


def digested(data: QuadTable) -> QuadTable:
    """Long literals as digests of their canonical text: rules ask only whether two are the same, and which terms are literals."""
    o = F.col("o")
    short = struct(LITERAL, F.sha2(canonical(Value(o, TERM)), 256), DIGEST)
    return QuadTable(data.quads.withColumn("o", F.when((o["k"] == LITERAL) & (F.length(o["v"]) > LONG), short).otherwise(o)))


def spelled(found: DataFrame, data: QuadTable) -> DataFrame:
    """Clashes with the texts of their digests."""
    text = canonical(Value(F.col("o"), TERM))
    long = data.quads.where(F.col("g").isNull() & (F.col("o.k") == LITERAL) & (F.length("o.v") > LONG)).select(F.concat(F.lit('"'), F.sha2(text, 256), F.lit(f'"^^<{DIGEST}>')).alias("digest"), text.alias("text"))
    met = long.join(F.broadcast(found.where(F.col("with").endswith(f"^^<{DIGEST}>")).select(F.col("with").alias("digest")).distinct()), "digest", "left_semi").distinct()
    return found.join(met, F.col("with") == F.col("digest"), "left").select("rule", "subject", F.coalesce("text", "with").alias("with"))


def inconsistencies(data: QuadTable, regime: str = "owl2-rl") -> DataFrame:
    """[rule, subject, with]: facts, given or inferred, that contradict each other."""
    whole, data = data, digested(data)
    own = written(encoded(data), "facts")
    inferred = encoded(materialize(data, regime, target="urn:q:tmp"), ("urn:q:tmp",))
    facts = written(own.unionByName(inferred).unionByName(list_facts(own)).distinct(), "facts")
    preds, classes = vocabulary(RL_CHECKS)
    there = occurring(facts, preds, classes)
    checks = [r for r in RL_CHECKS if all(can_match(b, there) for b in r.body)]
    found = [apply(r, [facts] * len(r.body)).select(F.lit(r.name).alias("rule"), F.col("s").alias("subject"), F.col("o").alias("with")) for r in checks]
    # Only where the two name an object of any predicate can it be a literal.
    found = [spelled(x, whole) if r.name in ("eq-diff1", "prp-asyp", "prp-pdw") else x for x, r in zip(found, checks, strict=True)]
    return reduce(DataFrame.unionByName, found).distinct() if found else data.spark.createDataFrame([], "rule string, subject string, with string")
