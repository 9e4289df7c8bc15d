"""Pointy-top hexagon grid on a local plane around one city.

Cells are addressed by axial coordinates ``q, r``. The plane is flat, so a grid fits one metropolitan
area; take a new origin for another city. Cell ids are not those of any global hexagon index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kilometres per degree on the local plane.
KM_PER_DEGREE_LON_AT_EQUATOR = 111.32
KM_PER_DEGREE_LAT = 110.574

SQRT3 = math.sqrt(3.0)


def _nearest(value: Column) -> Column:
    return F.floor(value + 0.5)


@dataclass(frozen=True)
class HexGrid:
    """Grid with its origin and edge length in kilometres."""

    origin_lon: float = -79.38
    origin_lat: float = 43.65
    edge_km: float = 0.46

    @property
    def km_per_lon(self) -> float:
        return KM_PER_DEGREE_LON_AT_EQUATOR * math.cos(math.radians(self.origin_lat))

    def with_cells(self, df: DataFrame, lon: Column, lat: Column) -> DataFrame:
        """Add the axial coordinates ``q, r`` of the cell that holds each point.

        The steps are separate projections, so that each intermediate value is computed once per row.
        """
        x, y, qf, rf, sf = (F.col(c) for c in ("_x", "_y", "_qf", "_rf", "_sf"))
        q, r, s = F.col("_q"), F.col("_r"), F.col("_s")
        dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
        # The coordinate with the largest rounding error follows from the other two.
        q_worst = (dq > dr) & (dq > ds)
        return (
            df.withColumns(
                {
                    "_x": (lon - self.origin_lon) * self.km_per_lon,
                    "_y": (lat - self.origin_lat) * KM_PER_DEGREE_LAT,
                }
            )
            .withColumns(
                {
                    "_qf": (x * (SQRT3 / 3) - y / 3) / self.edge_km,
                    "_rf": y * (2 / 3) / self.edge_km,
                }
            )
            .withColumn("_sf", -qf - rf)
            .withColumns({"_q": _nearest(qf), "_r": _nearest(rf), "_s": _nearest(sf)})
            .withColumns(
                {
                    "q": F.when(q_worst, -r - s).otherwise(q),
                    "r": F.when(~q_worst & (dr > ds), -q - s).otherwise(r),
                }
            )
            .drop("_x", "_y", "_qf", "_rf", "_sf", "_q", "_r", "_s")
        )

    def cell_id(self, q: Column, r: Column) -> Column:
        return F.concat_ws("_", q.cast("string"), r.cast("string"))

    def _to_lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x / self.km_per_lon + self.origin_lon, y / KM_PER_DEGREE_LAT + self.origin_lat

    def centre(self, q: Column, r: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a cell centre."""
        return self._to_lonlat((q + r / 2) * (self.edge_km * SQRT3), r * (self.edge_km * 1.5))

    def ring(self, q: Column, r: Column) -> Column:
        """Closed boundary: six corners, the first one repeated at the end."""
        x0, y0 = (q + r / 2) * (self.edge_km * SQRT3), r * (self.edge_km * 1.5)
        corners = []
        for k in (0, 1, 2, 3, 4, 5, 0):
            angle = math.radians(60 * k - 30)
            lon, lat = self._to_lonlat(
                x0 + self.edge_km * math.cos(angle), y0 + self.edge_km * math.sin(angle)
            )
            corners.append(F.array(lon, lat))
        return F.array(*corners)
