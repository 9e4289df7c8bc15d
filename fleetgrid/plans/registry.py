"""Every query by name, over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrid.functions.geometry import (
    as_geojson,
    coordinate,
    parse_wkt,
    point,
    polygon,
    shape_geojson,
    x_of,
)
from fleetgrid.functions.hexgrid import HexGrid
from fleetgrid.operators import dedup, features, mapprep
from fleetgrid.operators.typing import infer_types, typed_view
from fleetgrid.plans import queries as q
from fleetgrid.plans import tableviews as tables
from fleetgrid.schema import STOPS_FILE
from fleetgrid.session import work_folder
from fleetgrid.sources import archive, catalogue, feed, files, snapshot
from fleetgrid.sources.positions import PositionLog
from fleetgrid.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}

# The benchmark events cover 30 days, so the minutes of a live map become days here.
DAY = timedelta(days=1)
GRID = HexGrid()


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def _text_geometry(df: DataFrame) -> DataFrame:
    return df.withColumn("geometry", as_geojson(F.col("geometry")))


# --- vehicle positions ---


@query
def current_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Newest position per vehicle."""
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    return _text_geometry(q.current_locations(rows, DAY, as_of, ["event_id"]))


def _location_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    found = q.current_locations(rows, DAY, as_of, ["event_id"])
    shown = [
        "id",
        "routeTag",
        "dirTag",
        "heading",
        "predictable",
        "secsSinceReport",
        "speedKmHr",
        "fetched_at",
        "api_timestamp",
    ]
    return features.to_features(found, properties=shown)


@query
def current_locations_features(spark: SparkSession, folder: str) -> DataFrame:
    """Newest position per vehicle as GeoJSON features."""
    return _location_features(spark, folder)


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    return q.current_paths(rows, DAY, as_of, ["event_id"])


@query
def current_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path, mean speed and last heading per vehicle."""
    return _rounded(_text_geometry(_paths(spark, folder)), 6, "avgSpeedKmHr")


@query
def current_paths_line(spark: SparkSession, folder: str) -> DataFrame:
    """Points of each path in order, one per row."""
    points = _paths(spark, folder).select(
        "id", "start", F.posexplode("geometry.coordinates").alias("at", "xy")
    )
    return points.select(
        "id",
        (F.col("start") + F.col("at")).alias("position"),
        F.col("xy")[0].alias("lon"),
        F.col("xy")[1].alias("lat"),
    )


@query
def bound_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and vehicles of a route within a look-back, as SQL text with parameters."""
    rows = tables.positions(spark, folder)
    rows.createOrReplaceTempView("bound_positions")
    return spark.sql(
        "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_vehicles FROM bound_positions"
        " WHERE api_timestamp >= ? - (? * INTERVAL '1' SECOND) AND routeTag = ?",
        args=[tables.newest_time(rows), 7 * 86400, "click"],
    )


@query
def current_paths_features(spark: SparkSession, folder: str) -> DataFrame:
    """Current paths as GeoJSON features, one per part of a path."""
    found = _rounded(_paths(spark, folder), 6, "avgSpeedKmHr")
    return features.to_features(found, properties=["id", "part", "avgSpeedKmHr", "lastHeading"])


@query
def markers(spark: SparkSession, folder: str) -> DataFrame:
    """Last point of each path with marker kind and speed band."""
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    found = q.vehicle_markers(rows, DAY, as_of, ["event_id"])
    scaled = found.withColumns(mapprep.speed_scale(F.col("avgSpeedKmHr")))
    return _rounded(scaled, 6, "avgSpeedKmHr", "speed_clamped", "speed_place")


@query
def typed_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Feed text as numbers; every 17th speed is no number."""
    rows = tables.positions(spark, folder).withColumn(
        "speedKmHr", F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("speedKmHr"))
    )
    return typed_view(rows)


@query
def rejected_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and rejected values per route."""
    rows = tables.positions(spark, folder).withColumn(
        "speedKmHr", F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("speedKmHr"))
    )
    return (
        typed_view(rows)
        .groupBy("routeTag")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rejected").alias("n_rejected"))
    )


# --- speed map ---


@query
def avg_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """Mean speed per hexagon and hour of day."""
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    return _rounded(q.avg_speeds(rows, as_of=as_of), 6, "speed")


def _cells(found: DataFrame) -> DataFrame:
    """Cells with their corners rounded, so that both engines print the same digits."""
    ring = F.transform(
        F.col("geometry.coordinates")[0], lambda xy: F.transform(xy, lambda v: F.round(v, 6))
    )
    return found.withColumn("geometry", polygon(ring))


@query
def avg_speeds_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Mean speed per hexagon in the current hour of day."""
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    found = _cells(q.avg_speeds_hour(rows, as_of=as_of))
    return _text_geometry(_rounded(found, 6, "speed"))


@query
def hex_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of every occupied hexagon."""
    rows = tables.positions(spark, folder)
    placed = GRID.with_cells(rows, F.col("lon").cast("double"), F.col("lat").cast("double"))
    cells = placed.select("q", "r").distinct()
    corners = cells.select("q", "r", F.posexplode(GRID.ring(F.col("q"), F.col("r"))))
    return corners.select(
        "q",
        "r",
        F.col("pos").alias("corner"),
        F.round(F.col("col")[0], 9).alias("lon"),
        F.round(F.col("col")[1], 9).alias("lat"),
    )


def _hour_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    found = q.avg_speeds_hour(rows, as_of=as_of).select(
        F.col("hex_id").alias("hexId"),
        F.col("hour_of_day").alias("hourOfDay"),
        F.col("num_observations").alias("numObservations"),
        point(
            F.array(*[F.round(c, 4) for c in GRID.centre(F.col("q"), F.col("r"))])
        ).alias("geometry"),
    )
    return features.to_features(found)


@query
def feature_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Centres of the speed map's cells of one hour as documents."""
    return features.feature_documents(_hour_features(spark, folder), 100_000).select("geojson")


def _speed_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    found = _rounded(_cells(q.avg_speeds_hour(rows, as_of=as_of)), 6, "speed").select(
        F.col("hex_id").alias("hexId"),
        F.col("hour_of_day").alias("hourOfDay"),
        "speed",
        F.col("num_observations").alias("numObservations"),
        "geometry",
    )
    return features.to_features(found)


@query
def avg_speeds_features(spark: SparkSession, folder: str) -> DataFrame:
    """Speed map of the current hour as polygon features."""
    return _speed_features(spark, folder)


@query
def feature_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The speed map's features in documents of fifty."""
    return features.feature_documents(_speed_features(spark, folder), 50)


@query
def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features taken back out of documents."""
    documents = features.feature_documents(_speed_features(spark, folder), 50)
    return features.to_features(documents.select("geojson"))


@query
def avg_speeds_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of the current hour's polygon features, read back from their text."""
    rows = tables.positions(spark, folder)
    as_of = tables.newest_time(rows)
    found = q.avg_speeds_hour(rows, as_of=as_of).select(
        F.col("hex_id").alias("hexId"), F.col("hour_of_day").alias("hourOfDay"), "geometry"
    )
    text = features.to_features(found)
    shape = "struct<type: string, coordinates: array<array<array<double>>>>"
    parsed = F.from_json(
        "feature",
        f"struct<type: string, geometry: {shape}, properties: struct<hexId: string, hourOfDay: int>>",
    )
    ring = F.col("f.geometry.coordinates")[0]
    return text.select(parsed.alias("f")).select(
        F.col("f.properties.hexId").alias("hex_id"),
        F.col("f.properties.hourOfDay").alias("hour_of_day"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.size(ring).alias("n_corners"),
        (ring[0] == ring[6]).alias("closed"),
        F.round(ring[0][0], 9).alias("first_lon"),
        F.round(ring[0][1], 9).alias("first_lat"),
    )


# --- stops and routes ---


@query
def build_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops table."""
    found = q.build_stops(tables.stops_file(spark, folder))
    return found.withColumn("coords", as_geojson(F.col("coords")))


def _stops(spark: SparkSession, folder: str) -> DataFrame:
    return q.stops(q.build_stops(tables.stops_file(spark, folder)))


@query
def stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops with label direction."""
    return _text_geometry(_stops(spark, folder))


@query
def stops_features(spark: SparkSession, folder: str) -> DataFrame:
    """Stops as GeoJSON features."""
    found = _stops(spark, folder).select(
        "stop_id",
        F.col("stop_name").alias("stopName"),
        F.col("label_direction").alias("labelDirection"),
        "geometry",
    )
    return features.to_features(found)


@query
def stop_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label rows; every ninth stop has no name."""
    unnamed = tables.stops_file(spark, folder).withColumn(
        "stop_name",
        F.when(F.col("stop_id").cast("bigint") % 9 > 0, F.col("stop_name")),
    )
    return mapprep.stop_labels(q.stops(q.build_stops(unnamed))).drop("geometry")


def _routes_table(spark: SparkSession, folder: str) -> DataFrame:
    return q.build_routes(tables.shapes_file(spark, folder), ["tie_1", "tie_2"])


@query
def build_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Line per shape."""
    return _routes_table(spark, folder).select(
        "shape_id", "part", "parts", "start", "n_points", F.to_json("points").alias("points")
    )


@query
def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Simplified line per shape."""
    return _text_geometry(q.routes(_routes_table(spark, folder)))


@query
def routes_features(spark: SparkSession, folder: str) -> DataFrame:
    """Simplified lines as GeoJSON features, one per part of a line."""
    return features.to_features(q.routes(_routes_table(spark, folder)), properties=["shape_id", "part"])


@query
def routes_coarse(spark: SparkSession, folder: str) -> DataFrame:
    """Routes at a tolerance that takes out many points."""
    return _text_geometry(q.routes(_routes_table(spark, folder), tolerance=0.005))


# --- GeoJSON and geometry ---


@query
def to_features(spark: SparkSession, folder: str) -> DataFrame:
    """Any rows as features; rows without geometry (every fifth customer) are dropped."""
    rows = tables.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        F.expr(
            "CASE WHEN c_custkey % 5 > 0 THEN concat('{\"type\":\"Point\",\"coordinates\":[-79.',"
            " cast(1000 + c_custkey % 7919 AS string), ',43.', cast(1000 + c_custkey % 997 AS string),"
            " ']}') END"
        ).alias("geometry"),
    )
    return features.to_features(rows)


@query
def point_xy(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinates of points."""
    rows = tables.positions(spark, folder)
    shape = point(coordinate(F.col("lon"), F.col("lat")))
    return rows.select(
        "event_id", x_of(shape).alias("x"), shape["coordinates"][1].alias("y")
    )


@query
def wkt_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """WKT points, lines and polygons as GeoJSON; other text gives null."""
    a = (
        "concat('-79.', cast(1000 + o_orderkey % 9000 AS string),"
        " ' 43.', cast(1001 + o_custkey % 899 AS string))"
    )
    wkt = F.expr(
        f"CASE o_orderkey % 4 WHEN 0 THEN concat('POINT(', {a}, ')')"
        f" WHEN 1 THEN concat('LINESTRING (', {a}, ', -79.5 43.5)')"
        f" WHEN 2 THEN concat('POLYGON((', {a}, ', -79.5 43.5, -79.25 43.75, ', {a}, '))')"
        " ELSE 'GEOMETRYCOLLECTION EMPTY' END"
    )
    shapes = tables.table(spark, folder, "orders").select("o_orderkey", parse_wkt(wkt).alias("shape"))
    return shapes.select(
        "o_orderkey",
        shape_geojson(F.col("shape")).alias("geometry"),
        F.size(F.col("shape.rings")[0]).alias("n"),
    )


# --- map preparation ---


@query
def mercator(spark: SparkSession, folder: str) -> DataFrame:
    """Positions on the Mercator plane."""
    rows = tables.positions(spark, folder).select(
        "event_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")
    )
    return _rounded(mapprep.mercator(rows), 9, "mx", "my").select("event_id", "mx", "my")


def _stop_points(spark: SparkSession, folder: str) -> DataFrame:
    placed = tables.stops_file(spark, folder).select(
        "stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")
    )
    return mapprep.mercator(placed)


@query
def extent(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of all stops on the plane."""
    found = mapprep.extent(_stop_points(spark, folder))
    return _rounded(found, 9, "min_x", "max_x", "min_y", "max_y")


@query
def canvas_stops(spark: SparkSession, folder: str) -> DataFrame:
    """All stops in canvas pixels after the fit."""
    placed = _stop_points(spark, folder)
    shown = mapprep.to_canvas(placed, mapprep.fit(mapprep.extent(placed)))
    return _rounded(shown, 6, "px", "py").select("stop_id", "px", "py")


@query
def lod_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops shown at zoom 2.5: every sixth in id order."""
    placed = tables.stops_file(spark, folder).select("stop_id", "stop_name")
    return mapprep.thin_stops(placed, 2.5)


@query
def lod_stops_moving(spark: SparkSession, folder: str) -> DataFrame:
    """Stops shown at zoom 1.5 while the view moves: every 36th in id order."""
    placed = tables.stops_file(spark, folder).select("stop_id", "stop_name")
    return mapprep.thin_stops(placed, 1.5, moving=True)


@query
def speed_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Speed of every position on the colour scale; every 19th speed is missing."""
    rows = tables.positions(spark, folder)
    speed = F.when(F.col("event_id") % 19 > 0, F.col("speedKmHr").cast("double"))
    scaled = rows.select("event_id", *[c.alias(n) for n, c in mapprep.speed_scale(speed).items()])
    return _rounded(scaled, 6, "speed_place")


@query
def speed_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Positions per speed band."""
    rows = tables.positions(spark, folder).withColumn("speed", F.col("speedKmHr").cast("double"))
    return mapprep.band_counts(rows, "speed")


@query
def drawable_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Polygons of positions with two, three or four vertices; those under three are dropped."""
    rows = tables.positions(spark, folder).select(
        "event_id",
        F.col("lon").cast("double").alias("x"),
        F.col("lat").cast("double").alias("y"),
    )
    x, y = F.col("x"), F.col("y")
    third = F.when(F.col("event_id") % 3 > 0, x + 0.5)
    fourth = F.when(F.col("event_id") % 2 > 0, y + 0.5)
    ring = F.array(F.array(x, y), F.array(x + 0.25, y), F.array(third, y), F.array(x, fourth))
    kept = mapprep.drawable_rings(rows.withColumn("ring", ring))
    return kept.select("event_id", F.size("ring").alias("n_vertices"))


# --- ingest ---


@query
def feed_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Payload JSON to one row per vehicle."""
    payloads = feed.payloads_from_text(tables.payload_text(spark, folder))
    rows = feed.parse_payloads(payloads)
    return rows.withColumns(
        {
            "fetched_at": F.col("fetched_at").cast("timestamp_ntz"),
            "api_timestamp": F.col("api_timestamp").cast("timestamp_ntz"),
        }
    )


@query
def feed_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """Cursor after all payloads."""
    return feed.next_cursor(tables.payload_text(spark, folder))


@query
def raw_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads landed as received, read back with their text, order and fetch times."""
    landing = work_folder(spark, "landing")
    feed.land_payloads(tables.payload_text(spark, folder).withColumnRenamed("event_id", "sequence"), landing)
    payloads = feed.read_payloads(spark, landing, landed=True)
    return payloads.select(
        F.col(feed.PLACE).alias("sequence"),
        F.md5("value").alias("value_md5"),
        F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
        F.coalesce(F.size("vehicle"), F.lit(0)).alias("n_vehicles"),
    )


@query
def dedup_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of inserting the daily batches one by one."""
    return dedup.replay(tables.daily_log(spark, folder))


@query
def dedup_consecutive(spark: SparkSession, folder: str) -> DataFrame:
    """The daily batches without rows at the position that the vehicle's batch before had."""
    return dedup.consecutive(tables.daily_log(spark, folder))


@query
def insert_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Received, inserted and skipped rows per daily batch."""
    return dedup.insert_counts(tables.daily_log(spark, folder))


@query
def anti_join_new_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of the second half of the month that the first half does not hold."""
    log = tables.daily_log(spark, folder)
    first, last = log.agg(F.min("batch_id"), F.max("batch_id")).first()
    middle = F.lit(first + (last - first) / 2).cast("date")
    batch, stored = log.filter(F.col("batch_id") >= middle), log.filter(F.col("batch_id") < middle)
    return dedup.new_positions(batch.drop("batch_id"), stored)


def _ingested(spark: SparkSession, folder: str, one_run: bool) -> DataFrame:
    """Every event as a landed payload, ingested in two halves by one run or two, read back."""
    events = tables.table(spark, folder, "events")
    payloads = events.select("ts", "event_id", tables.coarse_payload().alias("value"))
    span = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(span[0] + (span[1] - span[0]) / 2)
    landing, store = work_folder(spark, "landing"), work_folder(spark, "positions")
    # Payloads land in time order: the second half meets positions the first one stored.
    for n, some in enumerate((payloads.filter(F.col("ts") < middle), payloads.filter(F.col("ts") >= middle))):
        target = landing if one_run else f"{landing}_{n}"
        fetched = F.expr("cast(ts + INTERVAL 5 SECONDS AS timestamp)").alias("fetched_at")
        feed.land_payloads(some.select("value", fetched, F.col("event_id").alias("sequence")), target)
        offsets = f"{store}_offsets" if one_run else f"{store}_offsets_{n}"
        start_ingest(spark, target, store, offsets, period=None, landed=True).awaitTermination()
    stored = PositionLog(spark, store).positions()
    return stored.withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("fetched_at", "api_timestamp")}
    )


@query
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The whole feed through the stream, stopped and started again half-way."""
    return _ingested(spark, folder, one_run=True)


@query
def ingest_restart(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the checkpoint lost half-way: nothing stored goes, nothing known is stored again."""
    return _ingested(spark, folder, one_run=False)


def _damaged(texts: DataFrame) -> DataFrame:
    """Every third payload cut off, every fifth without its time."""
    cut = F.expr("substring(value, 1, length(value) - 5)")
    timeless = F.expr("replace(value, 'lastTime', 'noTime')")
    value = F.when(F.expr("event_id % 3 = 0"), cut).when(F.expr("event_id % 5 = 0"), timeless).otherwise(F.col("value"))
    return texts.withColumn("value", value)


@query
def bad_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged payloads among others in feed files of many lines: those that the stream kept, by their text."""
    landing, store = work_folder(spark, "landing"), work_folder(spark, "positions")
    _damaged(tables.payload_text(spark, folder)).select("value").write.text(landing)
    start_ingest(spark, landing, store, f"{store}_offsets", period=None).awaitTermination()
    kept = spark.read.parquet(PositionLog(spark, store).rejected_path)
    return kept.select(F.md5("value").alias("value_md5"), F.length("value").cast("long").alias("n_chars"))


@query
def indented_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads written over several lines, many to a file: one row per payload found by its braces."""
    landing = work_folder(spark, "landing")
    text = F.replace(F.replace(F.col("value"), F.lit("},{"), F.lit("},\n {")), F.lit('"last'), F.lit('\n"last'))
    tables.payload_text(spark, folder).select(F.concat(text, F.lit("\n")).alias("value")).write.text(landing)
    payloads = feed.read_payloads(spark, landing)
    return payloads.select(
        F.md5(F.replace(F.replace("value", F.lit("\n "), F.lit("")), F.lit("\n"), F.lit(""))).alias("value_md5"),
        F.coalesce(F.size("vehicle"), F.lit(0)).alias("n_vehicles"),
        "malformed",
    )


@query
def bad_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every third payload cut off, every fifth without its time: kept, with their fetch times."""
    texts = _damaged(tables.payload_text(spark, folder))
    landing, store = work_folder(spark, "landing"), work_folder(spark, "positions")
    feed.land_payloads(texts.withColumnRenamed("event_id", "sequence"), landing)
    start_ingest(spark, landing, store, f"{store}_offsets", period=None, landed=True).awaitTermination()
    kept = spark.read.parquet(PositionLog(spark, store).rejected_path)
    return kept.select(
        F.col("source_place").alias("event_id"),
        F.length("value").cast("long").alias("n_chars"),
        F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
    )


@query
def locations_as_of_past(spark: SparkSession, folder: str) -> DataFrame:
    """Newest position per vehicle at a moment in the middle of the log: later rows don't count."""
    rows = tables.positions(spark, folder)
    oldest, newest = rows.agg(F.min("api_timestamp"), F.max("api_timestamp")).first()
    as_of = (oldest + (newest - oldest) / 2).replace(minute=0, second=0, microsecond=0)
    return _text_geometry(q.current_locations(rows, DAY, as_of, ["event_id"]))


# --- schedule load, snapshots ---


@query
def archive_resource(spark: SparkSession, folder: str) -> DataFrame:
    """First resource outside the datastore in catalogue documents made from orders."""
    resource = (
        "named_struct('id', concat('r', cast(o_orderkey * 10 + {0} AS string)),"
        " 'url', concat('http://data/', cast(o_custkey AS string), '/{0}.zip'),"
        " 'datastore_active', (o_orderkey + {0} * o_custkey) % 3 > 0)"
    )
    listed = ", ".join(resource.format(i) for i in range(3))
    documents = tables.table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        f"to_json(named_struct('result', named_struct('resources', array({listed})))) AS value",
    )
    return catalogue.archive_resource(catalogue.catalogue_from_text(documents))


def _stop_archives(spark: SparkSession, folder: str) -> archive.Unpacked:
    return archive.unpack(tables.zipped(tables.stops_file(spark, folder), "stops.txt"))


@query
def archive_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops file read back from zip archives with its declared types."""
    return archive.read_member(_stop_archives(spark, folder), "stops.txt", STOPS_FILE)


@query
def archive_stops_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Stops file read back from zip archives, types found from all rows."""
    found = archive.read_member_inferred(_stop_archives(spark, folder), "stops.txt")
    return found


@query
def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members over all archives with their table names and columns."""
    listed = archive.list_members(_stop_archives(spark, folder))
    return listed.select("member", "table_name", F.array_join("columns", ",").alias("columns")).distinct()


@query
def archive_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Archives loaded into schedule tables, and lines built from the shapes table, whose rows lie in two members."""
    loaded = work_folder(spark, "schedule")
    shapes = tables.shapes_file(spark, folder)
    odd = F.col("shape_pt_sequence") % 2 > 0
    archives = tables.zipped(shapes.filter(odd), "shapes.txt").union(tables.zipped(shapes.filter(~odd), "gtfs/shapes.txt"))
    archive.load_archives(archives, loaded)
    shapes = spark.read.parquet(f"{loaded}/{archive.table_name('shapes.txt')}")
    found = q.build_routes(shapes, ["shape_pt_lon", "shape_pt_lat"])
    return found.select("shape_id", "part", "parts", "start", "n_points", F.to_json("points").alias("points"))


@query
def inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-column typing: one late text value keeps ``mixed`` text."""
    text = tables.table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey AS string) AS order_no",
        "cast(cast(o_totalprice AS decimal(12,2)) AS string) AS price",
        "CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS even",
        "CASE WHEN o_orderkey % 997 = 3 THEN concat('t_', o_orderkey) ELSE cast(o_orderkey AS string) END"
        " AS mixed",
    )
    return infer_types(text)


@query
def replaced_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stops table written, replaced by the stops with a parent, and read."""
    built = q.build_stops(tables.stops_file(spark, folder)).drop("coords")
    target = work_folder(spark, "stops")
    files.replace_files(built, target)
    files.replace_files(built.filter(F.col("parent_station").isNotNull()), target)
    return spark.read.parquet(target)


@query
def snapshot_copy(spark: SparkSession, folder: str) -> DataFrame:
    """Daily copy of the positions, checked and read back."""
    rows = tables.positions(spark, folder)
    base, day = work_folder(spark, "snapshots"), date(2024, 2, 1)
    snapshot.take_snapshot(rows, base, day)
    return snapshot.read_snapshot(rows, base, day)


@query
def missing_table(spark: SparkSession, folder: str) -> DataFrame:
    """Positions together with a table that does not exist, which counts as empty."""
    rows = tables.positions(spark, folder)
    absent = files.read_table_or_empty(spark, "positions_not_there", rows.schema)
    return rows.unionByName(absent)
