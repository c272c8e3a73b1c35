"""Geometry: matrices and relations on hand-worked cases, measures, joins."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import geo
from quadrille.plans import operations
from quadrille.plans.compiler import query
from quadrille.sources.rdf import from_text

A = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
INNER = "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))"
EDGE = "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"
OVER = "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"
NEXT = "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))"
FAR = "POLYGON((10 10, 11 10, 11 11, 10 11, 10 10))"
HOLE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
CASES = [
    ("sfContains", A, INNER, True), ("sfWithin", INNER, A, True), ("sfOverlaps", A, OVER, True), ("sfTouches", A, NEXT, True), ("sfDisjoint", A, FAR, True), ("sfIntersects", A, FAR, False),
    ("sfEquals", A, "POLYGON((4 4, 0 4, 0 0, 4 0, 4 4))", True), ("sfContains", A, "POINT(2 2)", True), ("sfTouches", A, "POINT(4 2)", True), ("sfContains", A, "POINT(4 2)", False), ("sfWithin", "POINT(2 2)", HOLE, False),
    ("sfCrosses", "LINESTRING(-1 2, 5 2)", A, True), ("sfWithin", "LINESTRING(1 1, 2 2)", A, True), ("sfCrosses", "LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", True), ("sfTouches", "LINESTRING(0 0, 1 1)", "LINESTRING(1 1, 2 0)", True),
    ("sfOverlaps", "LINESTRING(0 0, 2 0)", "LINESTRING(1 0, 3 0)", True), ("sfEquals", "POINT(1 1)", "POINT(1 1)", True), ("rcc8ntpp", INNER, A, True), ("rcc8tpp", EDGE, A, True), ("rcc8tppi", A, EDGE, True), ("rcc8ec", A, NEXT, True),
    ("rcc8po", A, OVER, True), ("rcc8dc", A, FAR, True), ("rcc8eq", A, A, True), ("ehInside", INNER, A, True), ("ehContains", A, INNER, True), ("ehCovers", A, EDGE, True), ("ehCoveredBy", EDGE, A, True), ("ehMeet", A, NEXT, True), ("sfWithin", INNER, HOLE, False),
    ("sfIntersects", "MULTIPOINT(9 9, 2 2)", A, True), ("sfContains", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5)))", "POINT(6 6)", True), ("sfContains", "bad", A, None),
]


@pytest.mark.parametrize(("name", "a", "b", "expected"), CASES)
def test_relation(name, a, b, expected):
    assert geo.related(name, a, b) is expected


def test_matrix_and_measures():
    p = geo.parse_wkt
    assert geo.relate(p(A), p(INNER)) == "212FF1FF2" and geo.relate(p(A), p(NEXT)) == "FF2F11212"
    assert geo.area(p(HOLE)) == 12 and geo.distance(p(A), p(FAR)) == pytest.approx(72**0.5) and geo.distance(p(A), p("POINT(2 2)")) == 0
    assert geo.area(geo.buffer(p("POINT(0 0)"), 1)) == pytest.approx(3.1365, abs=1e-3)
    assert geo.area(geo.intersection(p(A), p(OVER))) == 4 and geo.to_wkt(geo.envelope(p("LINESTRING(1 2, 3 0)"))) == "POLYGON ((1 0, 3 0, 3 2, 1 2, 1 0))"
    there = geo.transform(p("POINT(5 52)"), "http://www.opengis.net/def/crs/EPSG/0/3857")
    assert geo.transform(there, geo.CRS84).points[0] == pytest.approx((5, 52))
    assert geo.parse_wkt('<gml:Point srsName="urn:x"><gml:pos>1 2</gml:pos></gml:Point>').points == [(1.0, 2.0)]
    assert geo.parse_wkt("<http://crs> POINT(1 2)").srid == "http://crs"


def test_functions_in_queries(spark):
    d = from_text(spark, f'@prefix : <urn:> . @prefix geo: <http://www.opengis.net/ont/geosparql#> . :a geo:asWKT "{A}"^^geo:wktLiteral . :b geo:asWKT "{INNER}"^^geo:wktLiteral . :c geo:asWKT "{FAR}"^^geo:wktLiteral .')
    got = query(d, "SELECT (STR(?x) AS ?a) (STR(?y) AS ?b) { ?x geo:asWKT ?g . ?y geo:asWKT ?h FILTER(?x != ?y && geof:sfContains(?g, ?h)) }").collect()
    assert [tuple(r) for r in got] == [("urn:a", "urn:b")]
    for unit, size in {"": 1, ", <http://www.opengis.net/def/uom/OGC/1.0/kilometre>": 1000, ", <http://www.opengis.net/def/uom/OGC/1.0/millimetre>": 0.001, ", <urn:other>": 1}.items():
        far = query(d, f"SELECT (geof:distance(?g, ?h{unit}) AS ?r) {{ <urn:a> geo:asWKT ?g . <urn:c> geo:asWKT ?h }}").first()["r"]
        assert far == pytest.approx(72**0.5 / size)


def test_spatial_join_is_the_same_without_a_grid(spark):
    shapes = [(i, f"POLYGON(({x} {y}, {x + 1.5} {y}, {x + 1.5} {y + 1.5}, {x} {y + 1.5}, {x} {y}))") for i, (x, y) in enumerate((i * 0.9 % 7, i * 1.7 % 5) for i in range(30))]
    a = spark.createDataFrame(shapes, "i int, g string")
    b = spark.createDataFrame([(j, f"POINT({j * 0.37 % 8} {j * 0.71 % 6})") for j in range(40)] + [(99, None)], "j int, h string")
    got = sorted((r["i"], r["j"]) for r in geo.spatial_join(a, b, "g", "h", "sfContains", 2.0).collect())
    want = sorted((i, j) for i, g in shapes for j in range(40) if geo.related("sfContains", g, f"POINT({j * 0.37 % 8} {j * 0.71 % 6})"))
    assert got == want and len(want) > 10
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 1.0, 1.0)], "id int, x double, y double")
    assert [r["id"] for r in geo.nearest(pts, 0, 0, 2).collect()] == [1, 3]
    assert pts.where(geo.within_box(F.col("x"), F.col("y"), 0, 0, 2, 2)).count() == 2


def test_registered_join_takes_the_squares_of_all_rows(spark, tmp_path):
    rows = [(i, [i * 0.3719 % 1 / 10, i * 0.7123 % 1 / 10, 0.0]) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = [(i, v[0] * 10, v[1] * 10) for i, v in rows]
    want = sorted((i, j) for i, x, y in at for j, u, v in at if abs(x - u) < 0.25 and abs(y - v) < 0.25)
    got = operations.queries()["geo_join_grid"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want and {i for i, _ in want} == set(range(45)) and len(want) > 90


def test_registered_statistics_take_all_tables(spark):
    sf = "/root/testdata/sf0.001"
    quads = operations.dataset(spark, sf).as_quads().quads.select("s", "p", "o")
    stats = operations.queries()["void_stats_all"](spark, sf).collect()[0]
    uses = {(r["kind"], r["name"]): r["uses"] for r in operations.queries()["usage_counts_all"](spark, sf).collect()}
    assert stats["triples"] == quads.count() == sum(n for (kind, _), n in uses.items() if kind == "predicate")
    for table, name in (("nation", "Nation"), ("customer", "Customer"), ("documents", "Document"), ("pages", "Page")):
        assert uses["class", f"urn:c:{name}"] == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_relations_of_points_in_the_middle_of_lines_and_faces():
    square, line = geo.parse_wkt("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), geo.parse_wkt("LINESTRING(0 0, 2 0)")
    assert geo.relate(square, geo.parse_wkt("POINT(1 1)")) == geo.relate(square, geo.parse_wkt("POINT(1 0.9)")) == "0F2FF1FF2"
    assert geo.relate(line, geo.parse_wkt("POINT(1 0)")) == geo.relate(line, geo.parse_wkt("POINT(0.7 0)")) == "0F1FF0FF2"
    assert geo.relate(square, geo.parse_wkt("LINESTRING(0.5 1, 1.5 1)")) == "102FF1FF2"


def test_join_of_rectangles_and_points_is_that_of_their_segments(spark):
    """Also within EPS of an edge or a corner, for points in a and for shapes that are no rectangles along the axes."""
    square = ["POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((0 2, 2 2, 2 0, 0 0, 0 2))", "POLYGON((1 0, 2 1, 1 2, 0 1, 1 0))", "LINESTRING(0 0, 2 2)", "POINT(1 1)", HOLE, "MULTIPOINT(1 1, 2 2)"]
    at = (0.0, 5e-10, 2e-9, 1.0, 2 - 2e-9, 2 - 5e-10, 2.0, 3.0)
    texts = [*square, *[f"POINT({x!r} {y!r})" for x in at for y in at]]
    assert {geo.kind_of(geo.parse_wkt(t)) for t in square[:2]} == {"box"} and [geo.kind_of(geo.parse_wkt(t)) for t in square[2:]] == ["other", "other", "point", "other", "other"]
    a, b = (spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{i} int, {g} string") for i, g in (("i", "g"), ("j", "h")))
    meet = lambda x, y: all(x[k] <= y[k + 2] and y[k] <= x[k + 2] for k in (0, 1))
    found = [geo.parse_wkt(t) for t in texts]
    near = [(i, j, geo.relate(g, h)) for i, g in enumerate(found) for j, h in enumerate(found) if meet(g.bbox(), h.bbox())]
    for name in ("sfContains", "sfWithin", "sfTouches", "ehContains", "rcc8ntppi", "sfIntersects"):
        want = sorted((i, j) for i, j, m in near if geo.RELATIONS[name](m, found[i].dimension, found[j].dimension))
        assert sorted((r["i"], r["j"]) for r in geo.spatial_join(a, b, "g", "h", name, 0.7).select("i", "j").collect()) == want and want


def test_rectangles_and_points_are_not_compared_in_python(spark, monkeypatch):
    """One full cell: its pairs are dealt over tasks, none of them goes through segments."""
    monkeypatch.setattr(geo, "relation", lambda name, a, b: F.raise_error(F.concat(a, b)).cast("boolean"))
    rows = spark.range(5000).selectExpr("id", "1 + id / 100000.0D as x")
    a = rows.selectExpr("id as i", "format_string('POLYGON((%s 0, %s 0, %s 1, %s 1, %s 0))', x - 1, x, x, x - 1, x - 1) as g")
    b = rows.selectExpr("id as j", "format_string('POINT(%s 0.5)', x - 0.5) as h")
    joined = geo.spatial_join(a, b, "g", "h", "sfContains", 4.0)
    assert joined.count() == 5000 * 5000
    assert max(r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 5000 * 5000
