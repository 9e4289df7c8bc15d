"""Time filters against a fixed or the current moment."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = "api_timestamp"
DATE = "event_date"


def moment(spark: SparkSession, as_of: datetime | None) -> datetime:
    """``as_of`` or the current time as local time of the session zone, without a zone."""
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    if as_of is None:
        return datetime.now(zone).replace(tzinfo=None)
    return as_of.astimezone(zone).replace(tzinfo=None) if as_of.tzinfo else as_of


def now_or(spark: SparkSession, as_of: datetime | None) -> Column:
    """``as_of`` as local time of the session zone, else the session's current local time.

    A moment without a zone is in the session zone; one with a zone is converted to it.
    """
    if as_of is None:
        return F.localtimestamp()
    return F.lit(moment(spark, as_of).isoformat(sep=" ")).cast("timestamp_ntz")


def look_back(
    df: DataFrame, span: timedelta, as_of: datetime | None = None, time: str = TIME
) -> DataFrame:
    """Rows no older than ``span`` before ``as_of``, and with a given ``as_of`` none after it.

    The bounds have the type of the time column and fold to literals, so they reach the file scan. A
    log with its ``event_date`` partition column is cut to the dates in question as well.
    """
    kind = df.schema[time].dataType.simpleString()
    seconds = F.lit(span.total_seconds()).cast("decimal(18,6)")
    zero = F.lit(0)
    now = now_or(df.sparkSession, as_of)
    bound = now - F.make_dt_interval(zero, zero, zero, seconds)
    recent = df.filter(F.col(time) >= bound.cast(kind))
    if as_of is not None:
        recent = recent.filter(F.col(time) <= now.cast(kind))
    if DATE in df.columns:
        recent = recent.filter(F.col(DATE) >= bound.cast("date"))
        if as_of is not None:
            recent = recent.filter(F.col(DATE) <= now.cast("date"))
    return recent


def at_hour(df: DataFrame, as_of: datetime | None = None, hour: str = "hour_of_day") -> DataFrame:
    """Rows of the hour of day of ``as_of``."""
    return df.filter(F.col(hour) == F.hour(now_or(df.sparkSession, as_of)))
