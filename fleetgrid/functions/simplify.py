"""Douglas-Peucker simplification of line columns.

A line keeps its end points. The farthest interior point (distance to the segment, first one on a
tie) is kept when it lies farther than the tolerance, and both halves are treated the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgrid.schema import LINE


def segment_distance(px, py, ax, ay, bx, by):
    """Distance of points to segments, for numpy arrays."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    safe = np.where(length2 == 0.0, 1.0, length2)
    t = ((px - ax) * dx + (py - ay) * dy) / safe
    off = np.abs(((ay - py) * dx - (ax - px) * dy) / safe) * np.sqrt(length2)
    to_a = np.sqrt((px - ax) ** 2 + (py - ay) ** 2)
    to_b = np.sqrt((px - bx) ** 2 + (py - by) ** 2)
    return np.where((length2 == 0.0) | (t <= 0.0), to_a, np.where(t >= 1.0, to_b, off))


def segment_distance_column(px, py, ax, ay, bx, by) -> Column:
    """The same distance as a Spark expression."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    safe = F.when(length2 == 0.0, F.lit(1.0)).otherwise(length2)
    t = ((px - ax) * dx + (py - ay) * dy) / safe
    off = F.abs(((ay - py) * dx - (ax - px) * dy) / safe) * F.sqrt(length2)
    to_a = F.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))
    to_b = F.sqrt((px - bx) * (px - bx) + (py - by) * (py - by))
    return F.when((length2 == 0.0) | (t <= 0.0), to_a).when(t >= 1.0, to_b).otherwise(off)


def kept_points(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of kept points for many lines at once; line ``i`` is ``offsets[i]:offsets[i + 1]``.

    All open segments of all lines are split together, level by level, so short lines cost no Python
    call each and long ones need no recursion.
    """
    keep = np.zeros(len(x), dtype=bool)
    first, last = offsets[:-1], offsets[1:] - 1
    filled = last >= first
    keep[first[filled]] = True
    keep[last[filled]] = True
    a, b = first[last - first > 1], last[last - first > 1]
    while len(a):
        inner = b - a - 1
        starts = np.concatenate(([0], np.cumsum(inner)[:-1]))
        at = np.arange(inner.sum()) - np.repeat(starts - a - 1, inner)
        ra, rb = np.repeat(a, inner), np.repeat(b, inner)
        far = segment_distance(x[at], y[at], x[ra], y[ra], x[rb], y[rb])
        farthest = np.maximum.reduceat(far, starts)
        at_max = np.where(far == np.repeat(farthest, inner), at, len(x))
        mid = np.minimum.reduceat(at_max, starts)
        split = farthest > tolerance
        a, b, mid = a[split], b[split], mid[split]
        keep[mid] = True
        a, b = np.concatenate((a, mid)), np.concatenate((mid, b))
        a, b = a[b - a > 1], b[b - a > 1]
    return keep


def kept_mask(tolerance: float) -> Callable[[Column], Column]:
    """A column function that says of each point of ``array<array<double>>`` lines whether it stays."""

    @F.arrow_udf("array<boolean>")
    def run(lines: pa.Array) -> pa.Array:
        lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
        counts = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        xy = lines.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        keep = kept_points(xy[:, 0], xy[:, 1], offsets, tolerance)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keep))

    return run


def simplify(tolerance: float) -> Callable[[Column], Column]:
    """A column function that simplifies ``array<array<double>>`` lines; null stays null."""

    @F.arrow_udf(LINE)
    def run(lines: pa.Array) -> pa.Array:
        lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
        counts = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        points = lines.flatten()
        xy = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        keep = kept_points(xy[:, 0], xy[:, 1], offsets, tolerance)
        kept_before = np.concatenate(([0], np.cumsum(keep)))[offsets].astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(kept_before), points.filter(pa.array(keep)), mask=lines.is_null()
        )

    return run
