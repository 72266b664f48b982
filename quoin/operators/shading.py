"""Shading by neighbours: obstruction angle per azimuth, and the fence that reproduces it.

Bin k of N looks along azimuth 2*pi*k/N from the building's centre; its value is the largest
atan(height / distance) over the neighbour edges the ray meets, 0 when it meets none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 48
_GRAZE = 1e-9
_ENDLESS = 1e18


def _looks(edges: DataFrame, bins: int) -> DataFrame:
    """(building_id, bin, elevation) per neighbour and candidate ray; NULL where the ray misses.

    Rays are cut with the neighbour's box in the box's own axes, where its sides are two pairs of
    parallel lines.  Candidate rays are those within the angle the box's circumscribed circle covers.
    Written in small steps that are each used once or materialised: as one expression the generated
    method would be larger than the JVM is willing to compile, and run many times slower.
    """
    step = 2 * math.pi / bins
    box = {name: F.col(f"box.{name}") for name in ("cx", "cy", "ux", "uy", "hu", "hv")}
    rays = edges.select(
        F.col("src").alias("building_id"), "height",
        (box["cx"] - F.col("own_x")).alias("_mx"), (box["cy"] - F.col("own_y")).alias("_my"),
        *[box[n].alias(f"_{n}") for n in ("ux", "uy", "hu", "hv")],
    )
    rays = rays.withColumns({"_d": F.hypot("_mx", "_my"), "_r": F.hypot("_hu", "_hv")})
    # Standing inside the circle: half a turn to either side is everything.
    half = F.when(F.col("_d") > F.col("_r"), F.asin(F.try_divide("_r", "_d"))).otherwise(F.lit(math.pi - step / 2))
    rays = rays.withColumns({"_mid": F.atan2("_my", "_mx"), "_half": half}).drop("_d", "_r")
    rays = rays.withColumns(
        {
            "_first": F.ceil((F.col("_mid") - F.col("_half")) / step - _GRAZE),
            "_last": F.floor((F.col("_mid") + F.col("_half")) / step + _GRAZE),
        }
    ).drop("_mid", "_half")
    candidates = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))
    rays = rays.withColumn("ray", F.explode(candidates)).drop("_first", "_last")
    azimuth = F.col("ray") * step
    mx, my, ux, uy = (F.col(c) for c in ("_mx", "_my", "_ux", "_uy"))
    rays = rays.withColumns({"_c": F.cos(azimuth), "_s": F.sin(azimuth)})
    # Along and across the box: distance to its middle and slope of the ray.
    rays = rays.select(
        "building_id", "height", "ray", "_hu", "_hv",
        (mx * ux + my * uy).alias("_u"), (my * ux - mx * uy).alias("_v"),
        (F.col("_c") * ux + F.col("_s") * uy).alias("_du"), (F.col("_s") * ux - F.col("_c") * uy).alias("_dv"),
    )

    def inverse(slope: str) -> Column:
        return F.when(F.abs(slope) < _GRAZE, F.lit(0.0)).otherwise(F.lit(1.0) / F.col(slope))

    def reach(middle: str, half: str, inverted: str) -> Column:
        # A ray along a pair of sides is between them all the way or nowhere.
        between = F.when(F.abs(middle) <= F.col(half) + _GRAZE, F.lit(_ENDLESS)).otherwise(F.lit(-1.0))
        return F.when(F.col(inverted) == 0, between).otherwise(F.abs(F.col(half) * F.col(inverted)))

    rays = rays.withColumns({"_iu": inverse("_du"), "_iv": inverse("_dv")}).drop("_du", "_dv")
    rays = rays.select(
        "building_id", "height", "ray",
        (F.col("_u") * F.col("_iu")).alias("_u"), reach("_u", "_hu", "_iu").alias("_wu"),
        (F.col("_v") * F.col("_iv")).alias("_v"), reach("_v", "_hv", "_iv").alias("_wv"),
    )
    rays = rays.select(
        "building_id", "height", "ray",
        F.greatest(F.col("_u") - F.col("_wu"), F.col("_v") - F.col("_wv")).alias("_in"),
        F.least(F.col("_u") + F.col("_wu"), F.col("_v") + F.col("_wv")).alias("_out"),
    )
    # From inside the box the nearest side is the one the ray leaves through.
    distance = F.when(F.col("_in") > 0, F.col("_in")).otherwise(F.col("_out"))
    met = (F.col("_out") > 0) & (F.col("_in") <= F.col("_out") + _GRAZE)
    return rays.select(
        "building_id",
        F.pmod("ray", F.lit(bins)).cast("int").alias("bin"),
        F.when(met, F.atan2("height", distance)).alias("elevation"),
    )


def obstructions(edges: DataFrame, bins: int = BINS) -> DataFrame:
    """(building_id, bin, elevation) of every bin an individual neighbour obstructs.

    ``edges`` has src, own_x, own_y, box (of the neighbour) and height.
    """
    rows = _looks(edges, bins)
    # A generator instead of a filter, which would be pushed down and repeat the whole computation.
    seen = F.when(F.col("elevation").isNotNull(), F.array("elevation"))
    return rows.select("building_id", "bin", F.explode(seen).alias("elevation"))


def shading_mask(buildings: DataFrame, edges: DataFrame, bins: int = BINS) -> DataFrame:
    """(building_id, mask): one array of ``bins`` elevations per building.

    A single shuffle by building: per-bin maxima are partially aggregated first, so a building with
    very many neighbours costs each task one row.
    """
    rows = _looks(edges, bins)
    tops = [F.max(F.when(F.col("bin") == k, F.col("elevation"))).alias(f"m{k}") for k in range(bins)]
    peaks = rows.groupBy("building_id").agg(*tops)
    values = [F.coalesce(f"m{k}", F.lit(0.0)) for k in range(bins)]
    return (
        buildings.select("building_id")
        .join(peaks, "building_id", "left")
        .select("building_id", F.array(*values).alias("mask"))
    )


def mask_bins(masks: DataFrame) -> DataFrame:
    """Long form: (building_id, bin, elevation)."""
    return masks.select("building_id", F.posexplode("mask").alias("bin", "elevation"))


def shading_fence(masks: DataFrame, radius: float, bins: int = BINS) -> DataFrame:
    """Segments of a closed ring of fences around the origin.

    Segment k is tangent to the circle at azimuth 2*pi*k/N; neighbouring segments share end points:
    (building_id, bin, azimuth, x0, y0, x1, y1, fence_height, fence_width).
    """
    if bins < 3:
        raise ValueError("a closed ring needs at least three segments")
    half = radius * math.tan(math.pi / bins)
    azimuth = F.col("bin") * (2 * math.pi / bins)
    rows = mask_bins(masks).withColumns(
        {"azimuth": azimuth, "_c": F.cos(azimuth), "_s": F.sin(azimuth)}
    )
    c, s = F.col("_c"), F.col("_s")
    return rows.select(
        "building_id",
        "bin",
        "azimuth",
        (c * radius + s * half).alias("x0"),
        (s * radius - c * half).alias("y0"),
        (c * radius - s * half).alias("x1"),
        (s * radius + c * half).alias("y1"),
        (F.tan("elevation") * radius).alias("fence_height"),
        F.lit(2 * half).alias("fence_width"),
    )


def fence_polygons(
    fences: DataFrame, centres: DataFrame, floor_height: float, thickness: float = 2.0
) -> DataFrame:
    """Quads of a fence around each building's centre: (building_id, bin, quad, floors).

    ``centres`` has building_id, x, y.  Heights a hair below a whole number of floors count as that number.
    """
    ux, uy = F.cos("azimuth") * thickness, F.sin("azimuth") * thickness
    x0, y0 = F.col("x0") + F.col("x"), F.col("y0") + F.col("y")
    x1, y1 = F.col("x1") + F.col("x"), F.col("y1") + F.col("y")

    def vertex(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    quad = F.array(
        vertex(x0, y0), vertex(x1, y1), vertex(x1 + ux, y1 + uy), vertex(x0 + ux, y0 + uy), vertex(x0, y0)
    )
    return fences.join(centres.select("building_id", "x", "y"), "building_id").select(
        "building_id", "bin", quad.alias("quad"), F.floor(F.col("fence_height") / floor_height + _GRAZE).alias("floors")
    )
