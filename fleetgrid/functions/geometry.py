"""Geometries as ``struct<type, coordinates>`` columns, GeoJSON text and a small WKT reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WKT names and their GeoJSON names.
GEOJSON_TYPES = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}


def coordinate(lon: Column, lat: Column) -> Column:
    """``[lon, lat]`` as doubles; null when either side is not a number."""
    x, y = lon.try_cast("double"), lat.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.array(x, y))


def _geometry(kind: str, coordinates: Column) -> Column:
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.when(coordinates.isNotNull(), shape)


def point(xy: Column) -> Column:
    return _geometry("Point", xy)


def line(points: Column) -> Column:
    return _geometry("LineString", points)


def polygon(ring: Column) -> Column:
    """Polygon with one exterior ring."""
    return _geometry("Polygon", F.when(ring.isNotNull(), F.array(ring)))


def x_of(geometry: Column) -> Column:
    """Longitude of a point."""
    return geometry["coordinates"][0]


def as_geojson(geometry: Column) -> Column:
    return F.to_json(geometry)


_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_XY = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_LIST = rf"{_XY}(?:,{_XY})"

# The whole text of each type: two ordinates a point, two points a line, four points a ring.
WKT_FORMS = {
    "POINT": rf"(?i)^\s*POINT\s*\({_XY}\)\s*$",
    "LINESTRING": rf"(?i)^\s*LINESTRING\s*\({_LIST}+\)\s*$",
    "POLYGON": rf"(?i)^\s*POLYGON\s*\(\s*\({_LIST}{{3,}}\)\s*(?:,\s*\({_LIST}{{3,}}\)\s*)*\)\s*$",
}


def parse_wkt(text: Column) -> Column:
    """WKT point, line or polygon as ``struct<type, rings>``; null for any other text.

    ``rings`` always has three levels (ring, point, ordinate), so one column holds all three types.
    The form of the whole text is checked first, and every ordinate must be finite.
    """
    kind = F.lit(None).cast("string")
    for name, form in WKT_FORMS.items():
        kind = F.when(text.rlike(form), GEOJSON_TYPES[name]).otherwise(kind)
    body = F.regexp_extract(text, r"\(([^A-Za-z]*(?:[eE][+-]?[0-9][^A-Za-z]*)*)\)\s*$", 1)
    rings = F.transform(
        F.split(F.regexp_replace(body, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\("),
        lambda ring: F.transform(
            F.split(ring, ","),
            lambda xy: F.transform(F.split(F.trim(xy), r"\s+"), lambda v: v.try_cast("double")),
        ),
    )
    infinite = F.exists(
        rings, lambda ring: F.exists(ring, lambda xy: F.exists(xy, lambda v: F.abs(v) == float("inf")))
    )
    shape = F.struct(kind.alias("type"), rings.alias("rings"))
    return F.when(kind.isNotNull(), F.when(~infinite, shape))


def shape_geojson(shape: Column) -> Column:
    """GeoJSON text of a parsed WKT column."""
    kind, rings = shape["type"], shape["rings"]

    def written(coordinates: Column) -> Column:
        return F.to_json(F.struct(kind.alias("type"), coordinates.alias("coordinates")))

    return (
        F.when(kind == "Point", written(rings[0][0]))
        .when(kind == "LineString", written(rings[0]))
        .when(kind == "Polygon", written(rings))
    )
