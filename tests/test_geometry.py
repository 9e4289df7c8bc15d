from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from fleetgrid.functions.geometry import (
    as_geojson,
    line,
    parse_wkt,
    point,
    polygon,
    shape_geojson,
    x_of,
)
from fleetgrid.functions.hexgrid import KM_PER_DEGREE_LAT, HexGrid


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def xy(lon, lat):
    return F.array(F.lit(lon), F.lit(lat))


def test_geometries_as_geojson(spark):
    assert json.loads(value(spark, as_geojson(point(xy(-71.25, 46.875))))) == {
        "type": "Point",
        "coordinates": [-71.25, 46.875],
    }
    two = F.array(xy(1.0, 2.0), xy(3.0, 4.0))
    assert json.loads(value(spark, as_geojson(line(two)))) == {
        "type": "LineString",
        "coordinates": [[1.0, 2.0], [3.0, 4.0]],
    }
    assert json.loads(value(spark, as_geojson(polygon(two))))["coordinates"] == [
        [[1.0, 2.0], [3.0, 4.0]]
    ]
    assert value(spark, x_of(point(xy(5.125, 51.75)))) == 5.125
    assert value(spark, point(F.lit(None).cast("array<double>"))) is None


@pytest.mark.parametrize(
    ("wkt", "wanted"),
    [
        ("POINT(0 0)", {"type": "Point", "coordinates": [0.0, 0.0]}),
        (" point ( 5.125  51.75 )", {"type": "Point", "coordinates": [5.125, 51.75]}),
        (
            "LineString (5.5 -51.25 ,.5 7.,-1e1 +2)",
            {"type": "LineString", "coordinates": [[5.5, -51.25], [0.5, 7.0], [-10.0, 2.0]]},
        ),
        (
            "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
            {
                "type": "Polygon",
                "coordinates": [
                    [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]],
                    [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]],
                ],
            },
        ),
        ("POINT(1e-3 -2.5E2)", {"type": "Point", "coordinates": [0.001, -250.0]}),
    ],
)
def test_wkt(spark, wkt, wanted):
    assert json.loads(value(spark, shape_geojson(parse_wkt(F.lit(wkt))))) == wanted


@pytest.mark.parametrize("wkt", ["", "POINT", "CIRCLE(0 0)", "POINT EMPTY", None])
def test_empty_or_missing_text_is_no_geometry(spark, wkt):
    text = F.lit(wkt).cast("string")
    assert value(spark, parse_wkt(text)) is None
    assert value(spark, shape_geojson(parse_wkt(text))) is None


def test_cell_centres_map_to_their_own_cell(spark):
    grid = HexGrid()
    cells = spark.sql(
        "SELECT q, r FROM range(-40, 41) AS a(q), (SELECT explode(sequence(-40, 40)) AS r)"
    )
    lon, lat = grid.centre(F.col("q"), F.col("r"))
    centres = cells.select(F.col("q").alias("q2"), F.col("r").alias("r2"), lon.alias("lon"), lat.alias("lat"))
    again = grid.with_cells(centres, F.col("lon"), F.col("lat"))
    assert again.count() == 81 * 81
    assert again.filter("q != q2 OR r != r2").count() == 0


def test_points_lie_within_one_edge_of_their_centre(spark):
    grid = HexGrid()
    points = spark.range(20000).select(
        (F.rand(1) * 0.8 - 79.8).alias("lon"), (F.rand(2) * 0.5 + 43.4).alias("lat")
    )
    lon, lat = grid.centre(F.col("q"), F.col("r"))
    far = F.hypot((F.col("lon") - lon) * grid.km_per_lon, (F.col("lat") - lat) * KM_PER_DEGREE_LAT)
    placed = grid.with_cells(points, F.col("lon"), F.col("lat"))
    assert placed.select(F.max(far)).first()[0] <= grid.edge_km + 1e-9


def test_ring_is_a_closed_regular_hexagon(spark):
    grid = HexGrid()
    ring = value(spark, grid.ring(F.lit(3), F.lit(-2)))
    assert len(ring) == 7 and ring[0] == ring[6]
    for a, b in zip(ring, ring[1:]):
        length = math.hypot((a[0] - b[0]) * grid.km_per_lon, (a[1] - b[1]) * KM_PER_DEGREE_LAT)
        assert length == pytest.approx(grid.edge_km)


def test_grid_parameters(spark):
    grid = HexGrid(origin_lon=2.35, origin_lat=48.85, edge_km=1.0)
    placed = grid.with_cells(spark.range(1), F.lit(2.35), F.lit(48.85))
    assert placed.select(grid.cell_id(F.col("q"), F.col("r"))).first()[0] == "0_0"


@pytest.mark.parametrize(
    "text",
    [
        "POINT(a b)",
        "POINT(1)",
        "POINT(1 2 3)",
        "POINT(1 2, 3 4)",
        "POINT 1 2",
        "POINT(1 2) x",
        "POINT(1e999 2)",
        "LINESTRING(1 2)",
        "LINESTRING(1 2, 3)",
        "POLYGON((0 0",
        "POLYGON(0 0, 1 1, 1 0, 0 0)",
        "POLYGON((0 0, 1 1, 0 0))",
        "CIRCLE(1 2)",
        "POINT EMPTY",
        "",
    ],
)
def test_other_text_is_no_geometry(spark, text):
    assert value(spark, shape_geojson(parse_wkt(F.lit(text)))) is None
