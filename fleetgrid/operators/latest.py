"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgrid.operators.lookback import TIME
from fleetgrid.operators.numbering import tie_columns


def latest_per_key(
    df: DataFrame, key: str = "id", time: str = TIME, tie_break: Sequence[str] | None = None
) -> DataFrame:
    """One row per key, the newest; equal times are decided by ``tie_break``, then all columns.

    Spark ranks within each input partition first (``WindowGroupLimit``), so at most one row per key
    and task is shuffled.
    """
    ties = [*(tie_break or ()), *tie_columns(df, [key, time, *(tie_break or ())])]
    newest = Window.partitionBy(key).orderBy(F.desc(time), *[F.desc_nulls_last(c) for c in ties])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
