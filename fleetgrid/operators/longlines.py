"""Simplification of lines that are too long for one row: Douglas-Peucker as rounds of Spark jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrid.functions.simplify import kept_mask, segment_distance_column
from fleetgrid.session import broadcast_if_small, durable


# Interior points up to which one task closes a whole segment.
SEGMENT_POINTS = 200_000


def simplify_points(points: DataFrame, key: str, tolerance: float, segment_points: int = SEGMENT_POINTS) -> DataFrame:
    """Kept rows of ``key, pos, x, y``, where ``pos`` numbers each line's points from 0.

    A segment of up to ``segment_points`` points is closed by one call of the function for whole lines. Every round
    finds the farthest point of every larger segment with one combining aggregate, so a segment of any
    length needs no task of its own, and hands each point to its new segment. There are as many rounds as it
    takes to cut the longest line into segments of that size, not as many as its shape is deep.
    """
    ends = durable(
        points.groupBy(key).agg(
            F.min_by(F.struct("pos", "x", "y"), "pos").alias("a"),
            F.max_by(F.struct("pos", "x", "y"), "pos").alias("b"),
        )
    )
    kept = [ends.select(key, F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))]
    opened = durable(
        points.join(broadcast_if_small(ends), key).filter(
            (F.col("pos") > F.col("a.pos")) & (F.col("pos") < F.col("b.pos"))
        )
    )
    while True:
        far = segment_distance_column(
            *[F.col(c) for c in ("x", "y", "a.x", "a.y", "b.x", "b.y")]
        )
        segments = durable(
            opened.withColumn("far", far)
            .groupBy(key, F.col("a.pos").alias("start"))
            # The first of equally far points wins.
            .agg(
                F.count(F.lit(1)).alias("held"),
                F.max("far").alias("far"),
                F.max_by(F.struct("pos", "x", "y"), F.struct("far", -F.col("pos"))).alias("m"),
            )
            .filter(F.col("far") > tolerance)
            .select(key, "start", "m", (F.col("held") <= segment_points).alias("fits"))
        )
        fitting, larger = (row or 0 for row in segments.agg(F.count_if("fits"), F.count_if(~F.col("fits"))).first())
        if fitting:
            kept.append(closed_at_once(opened, broadcast_if_small(segments.filter("fits"), fitting), key, tolerance))
        if not larger:
            break
        splits = segments.filter("NOT fits").drop("fits")
        kept.append(splits.select(key, F.col("m").alias("p")))
        left = F.col("pos") < F.col("m.pos")
        opened = durable(
            opened.withColumn("start", F.col("a.pos"))
            .join(broadcast_if_small(splits, larger), [key, "start"])
            .filter(F.col("pos") != F.col("m.pos"))
            .select(
                key,
                "pos",
                "x",
                "y",
                F.when(left, F.col("a")).otherwise(F.col("m")).alias("a"),
                F.when(left, F.col("m")).otherwise(F.col("b")).alias("b"),
            )
        )
    return reduce(DataFrame.unionByName, kept).select(key, "p.pos", "p.x", "p.y")


def closed_at_once(opened: DataFrame, segments: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Kept interior points ``key, p`` of segments, each simplified as a line of its own."""
    mine = opened.withColumn("start", F.col("a.pos")).join(segments.select(key, "start"), [key, "start"])
    inner = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    lines = mine.groupBy(key, "start").agg(F.concat(F.array(F.any_value("a")), inner, F.array(F.any_value("b"))).alias("line"))
    drawn = lines.withColumn("keep", kept_mask(tolerance)(F.transform("line", lambda p: F.array(p["x"], p["y"]))))
    both = F.slice(F.arrays_zip("line", "keep"), F.lit(2), F.size("line") - 2)
    return drawn.select(key, F.inline(F.filter(both, lambda one: one["keep"]))).select(key, F.col("line").alias("p"))
