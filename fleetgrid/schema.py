"""Explicit schemas of the feed, the position log and the schedule tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the vehicle feed. The feed sends every value as text.
FEED_FIELDS = (
    "id",
    "routeTag",
    "dirTag",
    "lat",
    "lon",
    "secsSinceReport",
    "predictable",
    "heading",
    "speedKmHr",
)

VEHICLE = T.StructType([T.StructField(name, T.StringType()) for name in FEED_FIELDS])

PAYLOAD = T.StructType(
    [
        T.StructField("vehicle", T.ArrayType(VEHICLE)),
        T.StructField("lastTime", T.StructType([T.StructField("time", T.StringType())])),
    ]
)

POSITIONS = T.StructType(
    [
        *VEHICLE.fields,
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("api_timestamp", T.TimestampType()),
    ]
)

# A payload as received.
LANDED = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("sequence", T.LongType()),
    ]
)

# What the insert rule compares, with the run and batch that stored it.
POSITION_KEYS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# The stored log adds its partition columns.
STORED_POSITIONS = T.StructType(
    [
        *POSITIONS.fields,
        T.StructField("event_date", T.DateType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# Numeric readings inside the feed and the types they carry.
FEED_NUMBERS = {
    "lat": "double",
    "lon": "double",
    "heading": "int",
    "speedKmHr": "double",
    "secsSinceReport": "int",
    "predictable": "boolean",
}

def _columns(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


# Schedule columns the queries read. Identifiers stay text.
STOPS_FILE = T.StructType(
    _columns(
        T.StringType(),
        "stop_id stop_code stop_name stop_desc zone_id stop_url parent_station stop_timezone",
    )
    + _columns(T.IntegerType(), "location_type wheelchair_boarding")
    + _columns(T.DoubleType(), "stop_lat stop_lon")
)

SHAPES_FILE = T.StructType(
    _columns(T.StringType(), "shape_id")
    + _columns(T.DoubleType(), "shape_pt_lat shape_pt_lon")
    + _columns(T.IntegerType(), "shape_pt_sequence")
)

# Members with declared types.
SCHEDULE_FILES = {"stops.txt": STOPS_FILE, "shapes.txt": SHAPES_FILE}

LINE = T.ArrayType(T.ArrayType(T.DoubleType()))
