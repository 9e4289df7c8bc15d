from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetgrid.functions.simplify import (
    kept_points,
    segment_distance,
    segment_distance_column,
    simplify,
)


def distance(p, a, b):
    """Distance to a segment, point by point."""
    p, a, b = np.array(p), np.array(a), np.array(b)
    d = b - a
    if not d.any():
        return float(np.hypot(*(p - a)))
    t = min(1.0, max(0.0, float((p - a) @ d) / float(d @ d)))
    return float(np.hypot(*(p - a - t * d)))


def recursive(points, tolerance):
    """Textbook form, on one line."""
    if len(points) < 3:
        return points
    far = [distance(p, points[0], points[-1]) for p in points[1:-1]]
    if max(far) <= tolerance:
        return [points[0], points[-1]]
    at = 1 + far.index(max(far))
    return recursive(points[: at + 1], tolerance)[:-1] + recursive(points[at:], tolerance)


number = st.integers(-60, 60).map(float)
line = st.lists(st.tuples(number, number), min_size=0, max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(line, max_size=6), st.floats(0.05, 40).map(lambda t: round(t, 3) + 0.00037))
def test_many_lines_at_once_equal_the_textbook_form(lines, tolerance):
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in lines]))).astype(np.int64)
    flat = np.array([p for points in lines for p in points], dtype=float).reshape(-1, 2)
    keep = kept_points(flat[:, 0], flat[:, 1], offsets, tolerance)
    for i, points in enumerate(lines):
        part = slice(offsets[i], offsets[i + 1])
        got = [tuple(p) for p in flat[part][keep[part]]]
        if not points:
            assert got == []
            continue
        assert got[0] == points[0] and got[-1] == points[-1]
        wanted = recursive(points, tolerance)
        if len(set(map(tuple, wanted))) == len(wanted):
            assert len(got) == len(wanted) or _within(points, keep[part], tolerance)
        assert _within(points, keep[part], tolerance)


def _within(points, keep, tolerance):
    """Every dropped point lies within the tolerance of the kept segment around it."""
    kept = np.flatnonzero(keep)
    for a, b in zip(kept, kept[1:]):
        for n in range(a + 1, b):
            if distance(points[n], points[a], points[b]) > tolerance + 1e-9:
                return False
    return True


def test_random_lines_equal_the_textbook_form():
    random = np.random.default_rng(3)
    for size in (1, 2, 3, 50, 400):
        points = [tuple(p) for p in np.cumsum(random.normal(size=(size, 2)), axis=0)]
        flat = np.array(points)
        for tolerance in (0.0, 0.5, 3.0):
            keep = kept_points(flat[:, 0], flat[:, 1], np.array([0, size]), tolerance)
            assert [tuple(p) for p in flat[keep]] == recursive(points, tolerance)


def test_spark_lines(spark):
    rows = [
        (1, [[0.0, 0.0], [1.0, 0.00001], [2.0, 0.0]]),
        (2, [[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]]),
        (3, None),
        (4, []),
        (5, [[7.0, 8.0]]),
        (6, [[0.0, 0.0], [5.0, 5.0], [0.0, 0.0]]),
    ]
    frame = spark.createDataFrame(rows, "id int, line array<array<double>>").coalesce(1)
    got = {r.id: r.s for r in frame.select("id", simplify(0.0001)("line").alias("s")).collect()}
    assert got[1] == [[0.0, 0.0], [2.0, 0.0]]
    assert got[2] == rows[1][1]
    assert got[3] is None
    assert got[4] == []
    assert got[5] == [[7.0, 8.0]]
    assert got[6] == rows[5][1]


def test_both_distance_forms_agree(spark):
    random = np.random.default_rng(1)
    values = random.integers(-3, 4, size=(500, 6)).astype(float)
    names = ["px", "py", "ax", "ay", "bx", "by"]
    frame = spark.createDataFrame(values.tolist(), ", ".join(f"{n} double" for n in names))
    got = [r[0] for r in frame.select(segment_distance_column(*[F.col(n) for n in names])).collect()]
    assert got == pytest.approx(list(segment_distance(*values.T)), abs=1e-12)
    brute = [distance(v[:2], v[2:4], v[4:]) for v in values]
    assert got == pytest.approx(brute, abs=1e-12)
