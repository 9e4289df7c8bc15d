"""The questions a live fleet map asks, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrid.functions.geometry import coordinate, line, point, polygon
from fleetgrid.functions.hexgrid import HexGrid
from fleetgrid.functions.simplify import simplify
from fleetgrid.operators.latest import latest_per_key
from fleetgrid.operators.lines import ordered_lines
from fleetgrid.operators.longlines import simplify_points
from fleetgrid.operators.lookback import TIME, at_hour, look_back
from fleetgrid.operators.mapprep import marker_kind
from fleetgrid.operators.numbering import (
    GROUP_ROWS,
    number_in_groups,
    tie_columns,
)

# Look-back periods and the simplification tolerance in degrees.
LOCATIONS_SPAN = timedelta(seconds=60)
PATHS_SPAN = timedelta(seconds=300)
SPEEDS_SPAN = timedelta(days=90)
ROUTE_TOLERANCE = 0.0001

# Label directions, and the length of the name prefix that shares them.
LABEL_DIRECTIONS = 4
LABEL_PREFIX = 10


def current_locations(
    positions: DataFrame,
    span: timedelta = LOCATIONS_SPAN,
    as_of: datetime | None = None,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Newest stored row per vehicle within ``span``, with its point as ``geometry``."""
    newest = latest_per_key(look_back(positions, span, as_of), "id", TIME, tie_break)
    return newest.withColumn("geometry", point(coordinate(F.col("lon"), F.col("lat"))))


def _newest_first(df: DataFrame) -> list[str]:
    return [TIME, *tie_columns(df, ["id", TIME])]


def current_paths(
    positions: DataFrame,
    span: timedelta = PATHS_SPAN,
    as_of: datetime | None = None,
    tie_break: Sequence[str] | None = None,
    line_points: int = GROUP_ROWS,
) -> DataFrame:
    """Path, mean speed and last heading per vehicle with more than one point within ``span``.

    ``part`` is 0 unless a path has more than ``line_points`` points.
    """
    rows = look_back(positions, span, as_of)
    order = [TIME, *tie_break] if tie_break else _newest_first(rows)
    paths = ordered_lines(
        rows,
        "id",
        order,
        coordinate(F.col("lon"), F.col("lat")),
        [
            F.avg(F.col("speedKmHr").try_cast("double")).alias("avgSpeedKmHr"),
            F.max_by("heading", F.struct(*order)).alias("lastHeading"),
        ],
        line_points,
    ).filter(F.col("n_points") > 1)
    return paths.select(
        "id",
        "part",
        "parts",
        "start",
        "n_points",
        "avgSpeedKmHr",
        "lastHeading",
        line(F.col("points")).alias("geometry"),
    )


def vehicle_markers(
    positions: DataFrame,
    span: timedelta = PATHS_SPAN,
    as_of: datetime | None = None,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Last point of each current path with its marker kind; builds no path for it."""
    rows = look_back(positions, span, as_of)
    order = [TIME, *tie_break] if tie_break else _newest_first(rows)
    xy = coordinate(F.col("lon"), F.col("lat"))
    return (
        rows.groupBy("id")
        .agg(
            F.max_by(xy, F.when(xy.isNotNull(), F.struct(*order))).alias("_last"),
            F.avg(F.col("speedKmHr").try_cast("double")).alias("avgSpeedKmHr"),
            F.max_by("heading", F.struct(*order)).alias("lastHeading"),
            F.count(xy).alias("n_points"),
        )
        .filter(F.col("n_points") > 1)
        .select(
            "id",
            F.col("_last")[0].alias("lon"),
            F.col("_last")[1].alias("lat"),
            "avgSpeedKmHr",
            "lastHeading",
            marker_kind(F.col("lastHeading")).alias("marker"),
        )
    )


def avg_speeds(
    positions: DataFrame,
    span: timedelta = SPEEDS_SPAN,
    as_of: datetime | None = None,
    grid: HexGrid = HexGrid(),
) -> DataFrame:
    """Mean speed and number of observations per hexagon and hour of day."""
    rows = look_back(positions, span, as_of).select(
        F.col("lon").try_cast("double").alias("_lon"),
        F.col("lat").try_cast("double").alias("_lat"),
        F.hour(TIME).alias("hour_of_day"),
        F.col("speedKmHr").try_cast("float").alias("_speed"),
    )
    located = rows.filter(F.col("_lon").isNotNull() & F.col("_lat").isNotNull())
    return (
        grid.with_cells(located, F.col("_lon"), F.col("_lat"))
        .groupBy("q", "r", "hour_of_day")
        .agg(F.avg("_speed").alias("speed"), F.count(F.lit(1)).alias("num_observations"))
        .withColumn("hex_id", grid.cell_id(F.col("q"), F.col("r")))
    )


def avg_speeds_hour(
    positions: DataFrame,
    span: timedelta = SPEEDS_SPAN,
    as_of: datetime | None = None,
    grid: HexGrid = HexGrid(),
) -> DataFrame:
    """Speed map of the hour of day of ``as_of``; the hour test moves below the aggregate."""
    cells = at_hour(avg_speeds(positions, span, as_of, grid), as_of)
    return cells.withColumn("geometry", polygon(grid.ring(F.col("q"), F.col("r"))))


def build_stops(stops_file: DataFrame) -> DataFrame:
    """Stops table from the schedule's stops file."""
    return stops_file.select(
        "stop_id",
        "stop_code",
        "stop_name",
        "stop_desc",
        "zone_id",
        "stop_url",
        "location_type",
        "parent_station",
        "stop_timezone",
        "wheelchair_boarding",
        point(coordinate(F.col("stop_lon"), F.col("stop_lat"))).alias("coords"),
    )


def stops(stops_table: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Stops with the label direction 0-3 that keeps like-named stops apart."""
    named = stops_table.select(
        "stop_id",
        "stop_name",
        F.col("coords").alias("geometry"),
        F.substring(F.lower("stop_name"), 1, LABEL_PREFIX).alias("_prefix"),
        F.length("stop_name").alias("_length"),
    )
    numbered = number_in_groups(
        named, ["_prefix"], ["_length", "stop_id", "stop_name"], "_no", group_rows
    )
    return numbered.select(
        "stop_id",
        "stop_name",
        (F.col("_no") % LABEL_DIRECTIONS).cast("int").alias("label_direction"),
        "geometry",
    )


def build_routes(
    shapes_file: DataFrame,
    tie_break: Sequence[str] = (),
    line_points: int = GROUP_ROWS,
) -> DataFrame:
    """Line per shape from the schedule's shapes file, points in sequence order."""
    lines = ordered_lines(
        shapes_file,
        "shape_id",
        ["shape_pt_sequence", *tie_break],
        coordinate(F.col("shape_pt_lon"), F.col("shape_pt_lat")),
        line_points=line_points,
    )
    return lines.select("shape_id", "part", "parts", "start", "n_points", "points")


def routes(
    routes_table: DataFrame,
    tolerance: float = ROUTE_TOLERANCE,
    line_points: int = GROUP_ROWS,
) -> DataFrame:
    """Simplified route lines.

    A line's rows have ``part, parts, start`` at every size; ``start`` counts simplified points.
    Lines held in one row are simplified in Arrow batches. Lines stored in several parts go through
    rounds of Spark jobs, since the parts cannot be simplified one by one.
    """
    whole = routes_table.filter(F.col("parts") == 1)
    short = whole.select(
        "shape_id", "part", "parts", "start", line(simplify(tolerance)(F.col("points"))).alias("geometry")
    )
    split = routes_table.filter(F.col("parts") > 1)
    if split.isEmpty():
        return short
    numbered = split.select(
        "shape_id", "start", F.posexplode("points").alias("_at", "_xy")
    ).filter((F.col("start") == 0) | (F.col("_at") > 0))
    kept = simplify_points(
        numbered.select(
            "shape_id",
            (F.col("start") + F.col("_at")).alias("pos"),
            F.col("_xy")[0].alias("x"),
            F.col("_xy")[1].alias("y"),
        ),
        "shape_id",
        tolerance,
    )
    long = ordered_lines(kept, "shape_id", ["pos"], F.array("x", "y"), line_points=line_points)
    return short.unionByName(
        long.select("shape_id", "part", "parts", "start", line(F.col("points")).alias("geometry"))
    )
