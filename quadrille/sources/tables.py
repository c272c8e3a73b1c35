"""The mapping of the supplied tables to virtual RDF: one class a table, urn:d: subjects, urn:v: predicates, urn:c: classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.sources.dataset import ClassMap, MappedTables, Property
from quadrille.terms import DATETIME, DBL, DEC, INT, STR, Type

C, V, D = "urn:c:", "urn:v:", "urn:d:"


def to(table: str) -> Type:
    return Type("iri", prefix=f"{D}{table}/")


def money(c: str) -> Property:
    return Property(f"cast({c} as decimal(18,2))", DEC)


def turns(df: DataFrame) -> DataFrame:
    """conversations with the key of each turn and of the one after it."""
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return df.withColumn("key", F.concat_ws("-", "conv_id", "turn")).withColumn("next_key", F.when(after.isNotNull(), F.concat_ws("-", "conv_id", after)))


#: table: (class, key, properties as name: column with its type). A line item's key is a hash of its whole row: order and line number repeat.
MAPPING: dict[str, tuple[str, str, dict[str, Property]]] = {
    "region": ("Region", "r_regionkey", {"name": Property("r_name", STR)}),
    "nation": ("Nation", "n_nationkey", {"name": Property("n_name", STR), "region": Property("n_regionkey", to("region"))}),
    "customer": ("Customer", "c_custkey", {"name": Property("c_name", STR), "nation": Property("c_nationkey", to("nation")), "balance": money("c_acctbal"), "segment": Property("c_mktsegment", STR)}),
    "supplier": ("Supplier", "s_suppkey", {"name": Property("s_name", STR), "nation": Property("s_nationkey", to("nation")), "balance": money("s_acctbal")}),
    "part": ("Part", "p_partkey", {"name": Property("p_name", STR), "brand": Property("p_brand", STR), "kind": Property("p_type", STR), "size": Property("p_size", INT), "retail": money("p_retailprice")}),
    "orders": ("Order", "o_orderkey", {"customer": Property("o_custkey", to("customer")), "status": Property("o_orderstatus", STR), "total": money("o_totalprice"), "date": Property("o_orderdate", DATETIME), "priority": Property("o_orderpriority", STR)}),
    "lineitem": (
        "LineItem",
        "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)",
        {
            "order": Property("l_orderkey", to("orders")),
            "part": Property("l_partkey", to("part")),
            "supplier": Property("l_suppkey", to("supplier")),
            "line": Property("l_linenumber", INT),
            "quantity": money("l_quantity"),
            "price": money("l_extendedprice"),
            "discount": money("l_discount"),
            "tax": money("l_tax"),
            "flag": Property("l_returnflag", STR),
            "state": Property("l_linestatus", STR),
            "shipped": Property("l_shipdate", DATETIME),
        },
    ),
    "events": ("Event", "event_id", {"at": Property("ts", DATETIME), "user": Property("user_id", to("user")), "event": Property("event_type", STR), "value": Property("value", DBL), "props": Property("props", STR)}),
    "documents": ("Document", "doc_id", {"text": Property("text", STR), "lang": Property("lang", STR), "source": Property("source", STR), "chars": Property("n_chars", INT)}),
    "labels": ("Labelled", "doc_id", {"quality": Property("quality", INT), "toxic": Property("toxic", INT)}),
    "pages": ("Page", "page_id", {"url": Property("url", STR), "html": Property("html", STR)}),
    "benchmark": ("Item", "item_id", {"text": Property("text", STR)}),
    "conversations": ("Turn", "key", {"conversation": Property("conv_id", to("conversation")), "number": Property("turn", INT), "role": Property("role", STR), "text": Property("text", STR), "next": Property("next_key", to("turn"))}),
}
PREFIXES = {"labels": "documents", "conversations": "turn"}


def dataset(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None, graphs: dict[str, str] | None = None) -> MappedTables:
    """The tables under a folder as RDF; graphs names the graph of a table (else the default graph)."""

    def reader(name: str):  # noqa: ANN202
        kept: list[DataFrame] = []

        def read() -> DataFrame:
            if not kept:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                kept.append(turns(df) if name == "conversations" else df)
            return kept[0]

        return read

    classes = []
    for name, (cls, key, props) in MAPPING.items():
        if only is None or name in only:
            classes.append(ClassMap(name, reader(name), C + cls, f"{D}{PREFIXES.get(name, name)}/", key, {V + p: x for p, x in props.items()}, (graphs or {}).get(name)))
    return MappedTables(spark, classes)
