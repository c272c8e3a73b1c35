"""GeoSPARQL's functions by their IRIs; importing this registers them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.scalar import REGISTRY, boolean
from quadrille.operators import geo, geo3d
from quadrille.terms import BOOL, DBL, GEO, GEOF, IRI_T, Type, Value, lexical

WKT = Type("lit", GEO + "wktLiteral")
UOM = "http://www.opengis.net/def/uom/OGC/1.0/"
#: Metres of each unit of length.
METRES = {"metre": 1.0, "kilometre": 1000.0, "centimetre": 0.01, "millimetre": 0.001}


def predicate(name: str):  # noqa: ANN201
    return lambda a, b: boolean(geo.relation(name, lexical(a), lexical(b)))


def in_unit(value: Column, unit: Value | None = None) -> Column:
    """A planar length in a unit; other units leave it as it is in its reference system."""
    if unit is None:
        return value
    metres = F.lit(1.0)
    for name, size in METRES.items():
        metres = F.when(lexical(unit) == UOM + name, size).otherwise(metres)
    return value / metres


def shape(f):  # noqa: ANN001, ANN201
    return lambda *vs: Value(geo.shaped(f, *map(lexical, vs)), WKT)


REGISTRY.update({GEOF + name: predicate(name) for name in geo.RELATIONS})
REGISTRY.update(
    {
        GEOF + "relate": lambda a, b, p: boolean(geo.column(lambda x, y, q: geo.fits(geo.relate(geo.parse_wkt(x), geo.parse_wkt(y)), q) if geo.parse_wkt(x) and geo.parse_wkt(y) else None, lexical(a), lexical(b), lexical(p), kind="boolean")),
        GEOF + "distance": lambda a, b, *unit: Value(in_unit(geo.measured(geo.distance, lexical(a), lexical(b)), *unit), DBL),
        GEOF + "area": lambda a, *unit: Value(geo.measured(geo.area, lexical(a)), DBL),
        GEOF + "convexHull": shape(geo.convex_hull),
        GEOF + "envelope": shape(geo.envelope),
        GEOF + "boundary": shape(geo.boundary),
        GEOF + "intersection": shape(geo.intersection),
        GEOF + "buffer": lambda a, r, *unit: Value(geo.column(lambda w, x: geo.to_wkt(geo.buffer(geo.parse_wkt(w), float(x))) if geo.parse_wkt(w) else None, lexical(a), lexical(r), kind="string"), WKT),
        GEOF + "transform": lambda a, crs: Value(geo.column(lambda w, c: geo.to_wkt(geo.transform(geo.parse_wkt(w), c)) if geo.parse_wkt(w) else None, lexical(a), lexical(crs), kind="string"), WKT),
        GEOF + "getSRID": lambda a: Value(geo.column(lambda w: g.srid if (g := geo.parse_wkt(w)) else None, lexical(a), kind="string"), IRI_T),
    }
)

GEO3D = "urn:geo3d:"


def solid(f, kind: str, *types):  # noqa: ANN001, ANN201
    """A function of 3D geometries by their texts; null where one can't be read."""

    def run(*ws):  # noqa: ANN202
        shapes = [geo3d.parse(w) for w in ws[: len(ws) - len(types)]]
        return None if any(s is None for s in shapes) else f(*shapes, *[t(w) for t, w in zip(types, ws[len(shapes) :], strict=True)])

    out = {"double": DBL, "boolean": BOOL, "string": WKT}[kind]
    return lambda *vs: Value(geo.column(run, *map(lexical, vs), kind=kind), out)


FUNCTIONS_3D = {
    "distance3d": solid(geo3d.distance, "double"),
    "volume": solid(geo3d.volume, "double"),
    "area3d": solid(geo3d.area, "double"),
    "zMin": solid(lambda g: (geo3d.z_range(g) or (None,))[0], "double"),
    "zMax": solid(lambda g: (geo3d.z_range(g) or (None, None))[1], "double"),
    "height": solid(geo3d.height, "double"),
    "boundingBox3d": solid(geo3d.bounding_box, "string"),
    "centroid3d": solid(geo3d.centroid, "string"),
    "footprint2d": solid(geo3d.footprint, "string"),
    "extrude": solid(geo3d.extrude, "string", float),
    "sf3dIntersects": solid(geo3d.intersects, "boolean"),
    "sf3dDisjoint": solid(lambda g, h: not geo3d.intersects(g, h), "boolean"),
    "sf3dContains": solid(geo3d.contains, "boolean"),
    "sf3dWithin": solid(lambda g, h: geo3d.contains(h, g), "boolean"),
}


def register_3d(namespace: str) -> None:
    """Puts the 3D functions under a namespace of the caller's own as well."""
    REGISTRY.update({namespace + name: f for name, f in FUNCTIONS_3D.items()})


register_3d(GEO3D)
