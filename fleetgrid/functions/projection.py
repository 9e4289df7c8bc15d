"""Mercator plane and the fit of an extent into a canvas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mercator_x(lon: Column) -> Column:
    return F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """Plane ordinate; grows downwards, as on a canvas."""
    return -F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
