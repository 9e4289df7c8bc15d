"""Row numbers that hold for groups of any size, and the search for oversize groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrid.session import BROADCAST_ROWS, broadcast_if_small, durable

# A group up to this many rows is handled by one task; larger ones take the spread-out way.
GROUP_ROWS = 1_000_000


def tie_columns(df: DataFrame, used: Sequence[str]) -> list[str]:
    """Remaining columns that can be sorted: ordering by them leaves only exact copies tied."""
    taken = {name.lower() for name in used}
    unsortable = ("map", "variant")
    return [
        field.name
        for field in df.schema.fields
        if field.name.lower() not in taken and field.dataType.typeName() not in unsortable
    ]


def oversize_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    A table of that size or less needs only its row count. Otherwise one pass over the key columns
    decides; counts combine before the shuffle, so a hot key is no hot spot.
    """
    if df.count() <= limit:
        return None
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    return large if large.take(1) else None


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on the keys with null equal to null; the keys of ``left`` stay."""
    theirs = {key: f"_right_{key}" for key in keys}
    match = reduce(and_, [F.col(key).eqNullSafe(F.col(theirs[key])) for key in keys])
    return left.join(right.withColumnsRenamed(theirs), match, how).drop(*theirs.values())


def divide_by_size(
    df: DataFrame, keys: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit``, and rows of larger groups (None when there are none)."""
    large = oversize_groups(df, keys, limit)
    if large is None:
        return df, None
    large = durable(large)
    count = large.count()
    found = broadcast_if_small(large, count)
    hot = join_groups(df, found, keys, "left_semi")
    if count > BROADCAST_ROWS:
        # This join shuffles; a checkpoint fixes the order of its rows for the salt below.
        hot = durable(hot)
    return join_groups(df, found, keys, "left_anti"), hot


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column | str],
    partition_by: Sequence[str] = (),
    name: str = "row_no",
) -> DataFrame:
    """Number rows from 0 in the given order, per group or overall, without a one-task group.

    Rows are range-partitioned by group and order, so a hot group spreads over many tasks; the salt
    splits exact ties too. The sorted rows are checkpointed: the counts below and the rows they are
    added to then come from one and the same placement, also after an executor is lost. ``df`` must be
    a scan with filters, projections and broadcast joins, or durable, so that the salt is the same when
    a task runs again.
    """
    keys = list(partition_by)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    sort = [*[F.col(k) for k in keys], *order, F.col("_salt")]
    placed = durable(
        df.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .drop("_salt")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # One row per group and partition: a group's rows are adjacent, so this is tiny against df.
    blocks = placed.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part")
    before = F.sum("_rows").over(earlier) - F.col("_rows") - F.col("_first")
    starts = durable(blocks.select("_part", *keys, before.alias("_shift")))
    return join_groups(placed, broadcast_if_small(starts), ["_part", *keys]).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(name)
    )


def number_in_groups(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[Column | str],
    name: str = "row_no",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """0-based row number per group: a window for usual groups, ``number_rows`` for oversize ones.

    Without keys the table is the one group.
    """
    if not partition_by and df.count() > group_rows:
        return number_rows(df, order_by, (), name)
    if not partition_by:
        alone = Window.partitionBy(F.lit(0)).orderBy(*order_by)
        return df.withColumn(name, (F.row_number().over(alone) - 1).cast("long"))
    usual, large = divide_by_size(df, partition_by, group_rows)
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    numbered = usual.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    if large is None:
        return numbered
    return numbered.unionByName(number_rows(large, order_by, partition_by, name))
