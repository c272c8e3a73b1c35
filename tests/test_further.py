"""Registered queries beside SELECT, against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quadrille.plans import further

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", ["from_named_graph", "optional_then_join", "quoted_triple", "update_insert_data", "graph_clear", "nquads_round_trip", "turtle_round_trip", "trig_round_trip", "rdf_xml_round_trip", "json_ld_round_trip", "results_json", "results_xml", "results_csv", "results_tsv", "shacl_length", "shacl_sparql", "geo_eh_contains"])
def test_against_sql(spark, tables, name):
    make, sql = further.FURTHER[name]
    got, want = make(spark, SF), tables.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())
