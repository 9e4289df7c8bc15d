"""Insert rule of the position log.

A row is stored when no row stored by an earlier batch has the same ``(id, lat, lon)``, compared as
text; within a batch only exact copies go. A row with a null among the three always counts as new.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgrid.session import BROADCAST_ROWS

POSITION_KEY = ("id", "lat", "lon")


def unknown_positions(
    rows: DataFrame, stored: DataFrame, batch: DataFrame, batch_rows: int | None = None
) -> DataFrame:
    """Rows at positions that ``stored`` does not hold; ``batch`` is what the rows come from.

    The stored side is the whole history. A batch known to have few rows is broadcast to cut it to the
    positions asked for, so the history is scanned but not shuffled. Otherwise copies of a stored
    position combine before the shuffle. Either way each known position is left once.
    """
    key = list(POSITION_KEY)
    known = stored.select(*key).dropna()
    if batch_rows is not None and batch_rows <= BROADCAST_ROWS:
        asked = batch.select(*key).dropna().distinct()
        known = known.join(F.broadcast(asked), key, "left_semi")
    return rows.join(known.distinct(), key, "left_anti").select(*rows.columns)


def new_positions(
    batch: DataFrame, stored: DataFrame, batch_rows: int | None = None
) -> DataFrame:
    """Distinct rows of ``batch`` at positions that ``stored`` does not hold yet."""
    return unknown_positions(batch.distinct(), stored, batch, batch_rows)


def keep_first_batch(rows: DataFrame, log: DataFrame, batch: str) -> DataFrame:
    """Rows whose batch is the first one in ``log`` at their position, or whose key has a null.

    First batches combine before the shuffle. The batch is part of the join key, so the rows of a hot
    position spread over its batches; the join is the last step, so adaptive execution can split what
    one batch still holds.
    """
    theirs = {c: f"_first_{c}" for c in POSITION_KEY}
    first = (
        log.dropna(subset=list(POSITION_KEY))
        .groupBy(*[F.col(c).alias(name) for c, name in theirs.items()])
        .agg(F.min(batch).alias("_first"))
    )
    match = [F.col(c) == F.col(name) for c, name in {**theirs, batch: "_first"}.items()]
    joined = rows.join(first, reduce(and_, match), "left")
    unknown = reduce(or_, [F.col(c).isNull() for c in POSITION_KEY])
    return joined.filter(F.col("_first").isNotNull() | unknown).select(*rows.columns)


def replay(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Outcome of inserting a whole log batch by batch, in one pass."""
    return keep_first_batch(log.distinct(), log, batch)


def consecutive(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Distinct rows of a log whose vehicle was elsewhere in the last earlier batch that located it.

    Another rule than the one above, and no default: a vehicle that comes back to an earlier position is
    stored again, one that stays where it is isn't. A batch that doesn't locate the vehicle is passed over; a row with a
    null key always counts as new.
    """
    key = list(POSITION_KEY)
    places = log.dropna(subset=key).select(*key, batch).distinct()
    before = F.lag(batch).over(Window.partitionBy("id").orderBy(batch))
    reports = places.select("id", batch).distinct().select(F.col("id").alias("_id"), F.col(batch).alias("_now"), before.alias("_before"))
    # The batch is part of both join keys, so a hot vehicle spreads over its batches.
    now = places.join(reports, (F.col("id") == F.col("_id")) & (F.col(batch) == F.col("_now"))).select(*key, "_now", "_before")
    held = places.select(*[F.col(c).alias(f"_held_{c}") for c in key], F.col(batch).alias("_held"))
    stayed = [*[F.col(c) == F.col(f"_held_{c}") for c in key], F.col("_before") == F.col("_held")]
    known = now.join(held, reduce(and_, stayed), "left_semi")
    known = known.select(*[F.col(c).alias(f"_known_{c}") for c in key], F.col("_now").alias("_known"))
    match = [*[F.col(c) == F.col(f"_known_{c}") for c in key], F.col(batch) == F.col("_known")]
    return log.distinct().join(known, reduce(and_, match), "left_anti")


def insert_counts(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows received, inserted and skipped per batch."""
    received = log.groupBy(batch).agg(F.count(F.lit(1)).alias("received"))
    inserted = replay(log, batch).groupBy(batch).agg(F.count(F.lit(1)).alias("_kept"))
    kept = F.coalesce("_kept", F.lit(0)).cast("long")
    return received.join(inserted, batch, "left").select(
        batch, "received", kept.alias("inserted"), (F.col("received") - kept).alias("skipped")
    )
