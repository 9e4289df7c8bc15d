"""Feed and schedule tables derived from the benchmark tables.

Positions come from ``events``, stops from ``part``, shapes from ``lineitem``. Coordinates are built as
text, so that every engine reads the same digits.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Feed fields of one event, as SQL; the oracle uses the same arithmetic in its own dialect.
VEHICLE_FIELDS = {
    "id": "concat('veh-', cast(user_id AS string))",
    "routeTag": "event_type",
    "dirTag": "CASE WHEN event_id % 5 > 0 THEN concat(event_type, '_', cast(event_id % 2 AS string)) END",
    "lat": "concat('43.', lpad(cast(6000 + (event_id * 37) % 2000 AS string), 4, '0'))",
    "lon": "concat('-79.', lpad(cast(2000 + (event_id * 91) % 4000 AS string), 4, '0'))",
    "secsSinceReport": "get_json_object(props, '$.k')",
    "predictable": "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END",
    "heading": "cast((event_id * 13) % 360 AS string)",
    "speedKmHr": "cast(cast(value AS decimal(10,2)) AS string)",
}


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """The position log; ``event_id`` decides ties."""
    return table(spark, folder, "events").selectExpr(
        *[f"{sql} AS {name}" for name, sql in VEHICLE_FIELDS.items()],
        "ts + INTERVAL 5 SECONDS AS fetched_at",
        "ts AS api_timestamp",
        "event_id",
    )


def newest_time(rows: DataFrame) -> datetime:
    """Time of the newest position: the moment the benchmark queries look back from."""
    return rows.agg(F.max("api_timestamp")).first()[0]


COARSE_FIELDS = {
    "id": VEHICLE_FIELDS["id"],
    "lat": f"substring({VEHICLE_FIELDS['lat']}, 1, 4)",
    "lon": f"substring({VEHICLE_FIELDS['lon']}, 1, 5)",
    "routeTag": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END",
    "heading": "cast(event_id % 4 * 90 AS string)",
}


def daily_log(spark: SparkSession, folder: str) -> DataFrame:
    """A day is a batch; coordinates are cut short so that positions repeat, and every 13th event
    has no latitude."""
    fields = {**COARSE_FIELDS, "lat": f"CASE WHEN event_id % 13 > 0 THEN {COARSE_FIELDS['lat']} END"}
    return table(spark, folder, "events").selectExpr(
        *[f"{sql} AS {name}" for name, sql in fields.items()], "cast(ts AS date) AS batch_id"
    )


def coarse_payload() -> Column:
    """One payload per event, with coarse coordinates and the event's time."""
    vehicle = F.struct(*[F.expr(sql).alias(name) for name, sql in COARSE_FIELDS.items()])
    millis = F.expr("cast(unix_millis(cast(ts AS timestamp)) AS string)")
    return F.to_json(
        F.struct(F.array(vehicle).alias("vehicle"), F.struct(millis.alias("time")).alias("lastTime"))
    )


def payload_text(spark: SparkSession, folder: str) -> DataFrame:
    """Payload JSON: one payload per event, with the event's vehicle and a second vehicle without
    ``dirTag``; every seventh payload has no vehicle at all."""
    first = F.struct(*[F.expr(sql).alias(name) for name, sql in VEHICLE_FIELDS.items()])
    second = F.struct(
        F.expr("concat('veh-', cast(user_id + 1000000 AS string))").alias("id"),
        *[F.expr(VEHICLE_FIELDS[c]).alias(c) for c in ("routeTag", "lat", "lon")],
    )
    vehicles = F.concat(
        F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]")
    )
    time = F.concat(
        F.lit('"lastTime":{"time":"'),
        F.expr("cast(unix_millis(cast(ts AS timestamp)) AS string)"),
        F.lit('"}}'),
    )
    listed = F.when(
        F.expr("event_id % 7 > 0"), F.concat(F.lit('{"vehicle":'), vehicles, F.lit(","), time)
    ).otherwise(F.concat(F.lit("{"), time))
    return table(spark, folder, "events").select(
        listed.alias("value"),
        F.expr("cast(ts + INTERVAL 5 SECONDS AS timestamp)").alias("fetched_at"),
        "event_id",
    )


def stops_file(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "cast(p_partkey AS string) AS stop_id",
        "concat('c', cast(p_partkey % 1000 AS string)) AS stop_code",
        "p_name AS stop_name",
        "p_type AS stop_desc",
        "p_brand AS zone_id",
        "cast(NULL AS string) AS stop_url",
        "p_size % 2 AS location_type",
        "CASE WHEN p_size > 25 THEN cast(p_partkey % 100 AS string) END AS parent_station",
        "'America/Toronto' AS stop_timezone",
        "p_size % 3 AS wheelchair_boarding",
        "cast(concat('43.', lpad(cast(6000 + (p_partkey * 37) % 2000 AS string), 4, '0')) AS double)"
        " AS stop_lat",
        "cast(concat('-79.', lpad(cast(2000 + (p_partkey * 91) % 4000 AS string), 4, '0')) AS double)"
        " AS stop_lon",
    )


def shapes_file(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence numbers repeat inside a shape; ``tie_1, tie_2`` decide."""
    return table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey AS string) AS shape_id",
        "cast(concat('43.', lpad(cast(6000 + (l_partkey * 7) % 200 AS string), 4, '0')) AS double)"
        " AS shape_pt_lat",
        "cast(concat('-79.', lpad(cast(2000 + (l_suppkey * 3) % 40 AS string), 4, '0')) AS double)"
        " AS shape_pt_lon",
        "l_linenumber AS shape_pt_sequence",
        "l_partkey AS tie_1",
        "l_suppkey AS tie_2",
    )


def zipped(rows: DataFrame, member: str) -> DataFrame:
    """Zip archives of the rows as a CSV member, written by Spark tasks, with a folder, a second member
    and an empty one beside it."""
    import io
    import zipfile

    import pyarrow as pa
    import pyarrow.csv as pacsv

    def pack(batches):
        for i, batch in enumerate(batches):
            csv, packed = io.BytesIO(), io.BytesIO()
            pacsv.write_csv(batch, csv)
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as target:
                target.writestr("extra/", "")
                target.writestr(member, csv.getvalue())
                target.writestr("agency.txt", "agency_id,agency_name\n1,Transit\n")
                target.writestr("empty.txt", "")
            yield pa.RecordBatch.from_pydict(
                {"path": [f"archive-{i}.zip"], "content": [packed.getvalue()]}
            )

    return rows.mapInArrow(pack, "path string, content binary")
