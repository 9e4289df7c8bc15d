"""Tables a map draws from: canvas coordinates, thinning by zoom, speed bands, markers, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrid.functions.projection import mercator_x, mercator_y
from fleetgrid.operators.numbering import number_in_groups

# Breaks of the speed scale, km/h.
SPEED_BREAKS = (0, 5, 15, 30, 50)

# Zoom below which every k-th stop is shown (None: no stop), and the factor while the
# view moves below its own zoom limit.
STRIDE_BY_ZOOM = ((1.25, None), (2.0, 12), (3.0, 6), (5.0, 3))
MOVING_ZOOM = 4.0
MOVING_FACTOR = 3


@dataclass(frozen=True)
class Canvas:
    """Drawing area with margins, in pixels."""

    width: float = 1000.0
    height: float = 800.0
    top: float = 100.0
    right: float = 100.0
    bottom: float = 100.0
    left: float = 100.0


def mercator(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add Mercator plane coordinates ``mx, my``."""
    return df.withColumns({"mx": mercator_x(F.col(lon)), "my": mercator_y(F.col(lat))})


def extent(df: DataFrame) -> DataFrame:
    """One row with the bounds of ``mx, my``; each task hands on one row."""
    return df.agg(
        F.min("mx").alias("min_x"),
        F.max("mx").alias("max_x"),
        F.min("my").alias("min_y"),
        F.max("my").alias("max_y"),
    )


def fit(bounds: DataFrame, canvas: Canvas = Canvas()) -> DataFrame:
    """One row ``scale, shift_x, shift_y`` that centres the bounds inside the margins."""
    wide = F.lit(canvas.width - canvas.left - canvas.right)
    high = F.lit(canvas.height - canvas.top - canvas.bottom)
    span_x = F.col("max_x") - F.col("min_x")
    span_y = F.col("max_y") - F.col("min_y")
    scale = F.coalesce(
        F.least(wide / F.nullif(span_x, F.lit(0.0)), high / F.nullif(span_y, F.lit(0.0))),
        F.lit(1.0),
    )
    middle_x = (F.col("min_x") + F.col("max_x")) / 2
    middle_y = (F.col("min_y") + F.col("max_y")) / 2
    return bounds.select(
        scale.alias("scale"),
        (canvas.left + wide / 2 - scale * middle_x).alias("shift_x"),
        (canvas.top + high / 2 - scale * middle_y).alias("shift_y"),
    )


def to_canvas(df: DataFrame, view: DataFrame) -> DataFrame:
    """Add canvas coordinates ``px, py``; the one-row ``view`` comes in as a scalar subquery."""
    got = view.select(F.struct("scale", "shift_x", "shift_y")).scalar()
    return (
        df.withColumn("_view", got)
        .withColumns(
            {
                "px": F.col("mx") * F.col("_view.scale") + F.col("_view.shift_x"),
                "py": F.col("my") * F.col("_view.scale") + F.col("_view.shift_y"),
            }
        )
        .drop("_view")
    )


def stop_stride(zoom: float, moving: bool = False) -> int | None:
    """Show every k-th stop; None shows none."""
    stride = next((k for limit, k in STRIDE_BY_ZOOM if zoom < limit), 1)
    if stride and moving and zoom < MOVING_ZOOM:
        stride *= MOVING_FACTOR
    return stride


def thin_stops(
    stops: DataFrame, zoom: float, moving: bool = False, order: str = "stop_id"
) -> DataFrame:
    """Every k-th stop in id order for a zoom level; ``stop_no`` is the 0-based position."""
    stride = stop_stride(zoom, moving)
    if stride is None:
        return stops.limit(0).withColumn("stop_no", F.lit(0).cast("long"))
    numbered = number_in_groups(stops, [], [order], "stop_no")
    return numbered.filter(F.col("stop_no") % stride == 0)


def speed_scale(speed: Column) -> dict[str, Column]:
    """Clamped speed, its band between two breaks, and the position 0..1 inside the band."""
    low, high = SPEED_BREAKS[0], SPEED_BREAKS[-1]
    known = F.coalesce(speed.cast("double"), F.lit(0.0))
    clamped = F.least(F.greatest(known, F.lit(float(low))), F.lit(float(high)))
    band = sum((clamped >= b).cast("int") for b in SPEED_BREAKS[1:-1])
    place = F.when(F.lit(False), F.lit(0.0))
    for i, (a, b) in enumerate(zip(SPEED_BREAKS, SPEED_BREAKS[1:])):
        place = place.when(band == i, (clamped - a) / (b - a))
    return {"speed_clamped": clamped, "speed_band": band, "speed_place": place}


def band_counts(df: DataFrame, speed: str) -> DataFrame:
    """Rows per speed band."""
    banded = df.select(speed_scale(F.col(speed))["speed_band"].alias("speed_band"))
    return banded.groupBy("speed_band").agg(F.count(F.lit(1)).alias("n"))


def marker_kind(heading: Column) -> Column:
    return F.when(heading.isNull(), "dot").otherwise("arrow")


def stop_labels(stops: DataFrame) -> DataFrame:
    """Label text and direction with the defaults a map uses."""
    return stops.withColumns(
        {
            "stop_name": F.coalesce("stop_name", F.lit("")),
            "label_direction": F.coalesce("label_direction", F.lit(0)),
        }
    )


def drawable_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Polygons with at least three usable vertices; unusable vertices are taken out."""
    usable = F.filter(ring, lambda p: F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    return df.withColumn(ring, usable).filter(F.size(ring) >= 3)
