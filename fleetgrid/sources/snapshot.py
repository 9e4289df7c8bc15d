"""Daily copies of the position log."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fleetgrid.sources.files import is_complete, remove


def content_of(rows: DataFrame) -> dict[str, Column]:
    """Aggregates that tell two tables apart whatever the order of their rows: their number and a sum of row hashes."""
    hashed = F.xxhash64(*[F.col(f"`{name}`") for name in rows.columns])
    # The second sum tells apart rows that swap parts of a first one.
    twice = F.xxhash64(hashed, F.lit(1))
    return {
        "n": F.count(F.lit(1)),
        "checksum": F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).cast("string"),
        "second": F.coalesce(F.sum(twice.cast("decimal(38,0)")), F.lit(0)).cast("string"),
    }


def take_snapshot(positions: DataFrame, base: str, day: date) -> bool:
    """Copy the log to the folder of ``day`` and check the copy; False when that day has one.

    The rows are summed up by the write itself, so what is compared is what was written. A copy that was cut off
    is written again.
    """
    target = f"{base}/snapshot_date={day.isoformat()}"
    spark = positions.sparkSession
    if is_complete(spark, target):
        return False
    written = Observation()
    rows = positions.observe(written, *[value.alias(name) for name, value in content_of(positions).items()])
    rows.write.mode("overwrite").parquet(target)
    content = written.get or {"n": 0, "checksum": "0", "second": "0"}
    try:
        verify_snapshot(positions, base, day, content)
    except ValueError:
        # Without its mark of completeness the copy counts as cut off.
        remove(spark, f"{target}/_SUCCESS")
        raise
    return True


def read_snapshot(positions: DataFrame, base: str, day: date) -> DataFrame:
    return positions.sparkSession.read.parquet(f"{base}/snapshot_date={day.isoformat()}")


def verify_snapshot(positions: DataFrame, base: str, day: date, content: dict[str, Any]) -> None:
    """Raise unless the copy can be read, has the log's columns and the rows that ``content`` sums up."""
    copy = read_snapshot(positions, base, day)
    got = [(f.name, f.dataType) for f in copy.schema.fields]
    wanted = [(f.name, f.dataType) for f in positions.schema.fields]
    if got != wanted:
        raise ValueError(f"snapshot of {day} has columns {copy.columns}")
    found = copy.agg(*[value.alias(name) for name, value in content_of(copy).items()]).first().asDict()
    if found["n"] != content["n"]:
        raise ValueError(f"snapshot of {day} holds {found['n']} rows, {content['n']} were written")
    if found != dict(content):
        raise ValueError(f"snapshot of {day} holds other values than were written")
