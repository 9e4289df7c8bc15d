"""Ordered points to lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrid.operators.numbering import (
    GROUP_ROWS,
    divide_by_size,
    join_groups,
    number_rows,
)


def ordered_lines(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    xy: Column,
    extra: Sequence[Column] = (),
    line_points: int = GROUP_ROWS,
) -> DataFrame:
    """One line per key: ``key, part, parts, start, points, n_points`` and the ``extra`` aggregates.

    A key with more than ``line_points`` points comes as ``parts`` rows, numbered by ``part``. Each part
    starts with the last point of the part before it, so the parts joined in order are the whole line;
    ``start`` is the position of a part's first point. ``n_points`` and the extra aggregates always
    describe the whole line. Rows without coordinates add no point but count in the extra aggregates.
    """
    usual, large = divide_by_size(df, [key], line_points)
    sort_keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order_by)]
    place = F.when(xy.isNotNull(), F.struct(*sort_keys, xy.alias("_xy")))
    listed = F.sort_array(F.collect_list(place))
    # Rows go to their key's task first: lists do not get smaller by combining before a shuffle.
    lines = (
        usual.repartition(key)
        .groupBy(key)
        .agg(
            F.transform(listed, lambda p: p["_xy"]).alias("points"),
            F.count(xy).alias("n_points"),
            *extra,
        )
        .withColumns(
            {
                "part": F.lit(0).cast("long"),
                "parts": F.lit(1).cast("long"),
                "start": F.lit(0).cast("long"),
            }
        )
    )
    if large is None:
        return lines
    split = _lines_in_parts(large, key, order_by, xy, extra, line_points)
    return lines.unionByName(split.select(*lines.columns))


def _lines_in_parts(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    xy: Column,
    extra: Sequence[Column],
    line_points: int,
) -> DataFrame:
    whole = df.groupBy(key).agg(F.count(xy).alias("n_points"), *extra)
    located = df.select(key, *order_by, xy.alias("_xy")).filter(F.col("_xy").isNotNull())
    points = number_rows(located, [*order_by, "_xy"], [key], "_pos").select(key, "_pos", "_xy")
    part = F.floor(F.col("_pos") / line_points)
    # The first point of a part also closes the part before it.
    shared = (F.col("_pos") % line_points == 0) & (F.col("_pos") > 0)
    parts = (
        points.withColumn(
            "part", F.explode(F.when(shared, F.array(part - 1, part)).otherwise(F.array(part)))
        )
        .repartition(key, "part")
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_xy"))).alias("_list"))
        # A last part of one point alone is already closed by the part before it.
        .filter((F.size("_list") > 1) | (F.col("part") == 0))
        .select(key, "part", F.transform("_list", lambda p: p["_xy"]).alias("points"))
    )
    needed = F.greatest(F.lit(1), F.ceil((F.col("n_points") - 1) / line_points))
    # A key without any located row has no part, but stays as an empty line.
    return join_groups(whole, parts, [key], "left").withColumns(
        {
            "part": F.coalesce("part", F.lit(0)).cast("long"),
            "parts": needed.cast("long"),
            "start": (F.coalesce("part", F.lit(0)) * line_points).cast("long"),
            "points": F.coalesce("points", F.array()),
        }
    )
