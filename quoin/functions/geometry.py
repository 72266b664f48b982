"""Planar geometry on ``array<array<array<struct<x,y>>>>`` columns (polygons > rings > vertices).

Rings are closed (first vertex repeated last); the first ring of a polygon is its shell, the others
are holes.  Everything here is built-in expressions; measures over many vertices are in ``arrow``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY_TOLERANCE = 1e-9  # metres


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it.

    Expressions are trees: a costly argument used inside a lambda would otherwise be evaluated again
    for every element.
    """
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def shell(geom: Column) -> Column:
    """Exterior ring of the first polygon."""
    return F.get(F.get(geom, F.lit(0)), F.lit(0))


def _ring_area(ring: Column) -> Column:
    """Sum of trapezoids: needs no common origin to stay accurate for large coordinates."""
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    trapezoids = F.zip_with(
        F.slice(ring, F.lit(1), count),
        F.slice(ring, F.lit(2), count),
        lambda p, q: (p["x"] + q["x"]) * (q["y"] - p["y"]),
    )
    return F.abs(F.aggregate(trapezoids, F.lit(0.0), lambda s, t: s + t)) / 2


def _polygon_area(poly: Column) -> Column:
    holes = F.transform(F.slice(poly, F.lit(2), F.size(poly)), _ring_area)
    return _ring_area(poly[0]) - F.aggregate(holes, F.lit(0.0), lambda s, h: s + h)


def largest_part(geom: Column) -> Column:
    """The polygon with the largest area; the first of equals."""
    ranked = F.transform(
        geom, lambda poly, i: F.struct(_polygon_area(poly).alias("a"), (-i).alias("i"), poly.alias("p"))
    )
    return F.when(F.size(geom) == 1, geom[0]).otherwise(F.array_max(ranked)["p"])


# --- rectangles -----------------------------------------------------------------------------


def rectangle_ring(cx: Column, cy: Column, width: Column, depth: Column, angle: Column) -> Column:
    """Closed ring of a rotated rectangle given by centre, sides and angle."""
    frame = F.struct(
        cx.alias("x"), cy.alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"),
        (width / 2).alias("w"), (depth / 2).alias("d"),
    )

    def ring(f: Column) -> Column:
        ux, uy, vx, vy = f["w"] * f["c"], f["w"] * f["s"], f["d"] * f["s"], f["d"] * f["c"]
        x, y = f["x"], f["y"]
        first = point(x - ux + vx, y - uy - vy)
        return F.array(
            first, point(x + ux + vx, y + uy - vy), point(x + ux - vx, y + uy + vy), point(x - ux - vx, y - uy + vy), first
        )

    return bound(frame, ring)


def _edge(rect: Column, i: int) -> tuple[Column, Column]:
    return rect[i + 1]["x"] - rect[i]["x"], rect[i + 1]["y"] - rect[i]["y"]


def _length(vector: tuple[Column, Column]) -> Column:
    return F.sqrt(vector[0] * vector[0] + vector[1] * vector[1])


def rectangle_edges(rect: Column) -> tuple[Column, Column]:
    """(short, long), rounded to a micrometre so that equal inputs compare equal."""
    d1, d2 = F.round(_length(_edge(rect, 0)), 6), F.round(_length(_edge(rect, 1)), 6)
    return F.least(d1, d2), F.greatest(d1, d2)


def rectangle_angle(rect: Column) -> Column:
    """Direction of the long edge in [0, pi); squares report theirs in [0, pi/2)."""
    e1, e2 = _edge(rect, 0), _edge(rect, 1)
    d1, d2 = F.round(_length(e1), 6), F.round(_length(e2), 6)
    along = F.when(d1 > d2, F.atan2(e1[1], e1[0])).otherwise(F.atan2(e2[1], e2[0]))
    turn = F.when(d1 == d2, F.lit(math.pi / 2)).otherwise(F.lit(math.pi))
    folded = F.pmod(along, turn)
    return F.when(turn - folded < 1e-9, F.lit(0.0)).otherwise(folded)


def with_oriented_box(df: DataFrame, rect_col: str = "rect", target: str = "box") -> DataFrame:
    """Adds struct(cx, cy, ux, uy, hu, hv): centre, unit vector of the first edge, half extents.

    Built in steps, so that each step is computed once and the formulas do not nest.
    """
    rect = F.col(rect_col)
    (ax, ay), (bx, by) = _edge(rect, 0), _edge(rect, 1)
    df = df.withColumns({"_ax": ax, "_ay": ay, "_bx": bx, "_by": by})
    df = df.withColumns(
        {"_a": _length((F.col("_ax"), F.col("_ay"))), "_b": _length((F.col("_bx"), F.col("_by")))}
    )
    ux = F.coalesce(F.try_divide("_ax", "_a"), F.try_divide("_by", "_b"), F.lit(1.0))
    uy = F.coalesce(F.try_divide("_ay", "_a"), F.try_divide(-F.col("_bx"), "_b"), F.lit(0.0))
    df = df.withColumn(
        target,
        F.struct(
            ((rect[0]["x"] + rect[2]["x"]) / 2).alias("cx"),
            ((rect[0]["y"] + rect[2]["y"]) / 2).alias("cy"),
            ux.alias("ux"),
            uy.alias("uy"),
            (F.col("_a") / 2).alias("hu"),
            (F.col("_b") / 2).alias("hv"),
        ),
    )
    return df.drop("_ax", "_ay", "_bx", "_by", "_a", "_b")


def boxes_intersect(a: Column, b: Column, tolerance: float = _EMPTY_TOLERANCE) -> Column:
    """Separating-axis test for two oriented boxes; touching counts as intersecting."""
    tx, ty = b["cx"] - a["cx"], b["cy"] - a["cy"]
    cos = F.abs(a["ux"] * b["ux"] + a["uy"] * b["uy"])
    sin = F.abs(a["ux"] * b["uy"] - a["uy"] * b["ux"])
    gaps = (
        F.abs(tx * a["ux"] + ty * a["uy"]) - (a["hu"] + b["hu"] * cos + b["hv"] * sin),
        F.abs(ty * a["ux"] - tx * a["uy"]) - (a["hv"] + b["hu"] * sin + b["hv"] * cos),
        F.abs(tx * b["ux"] + ty * b["uy"]) - (b["hu"] + a["hu"] * cos + a["hv"] * sin),
        F.abs(ty * b["ux"] - tx * b["uy"]) - (b["hv"] + a["hu"] * sin + a["hv"] * cos),
    )
    return F.greatest(*gaps) <= tolerance


# --- text forms -----------------------------------------------------------------------------


def coordinate_text(value: Column) -> Column:
    """At most six decimals, trailing zeros dropped, never in exponent form."""
    fixed = F.round(value, 6).cast("decimal(24,6)").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def _ring_text(ring: Column) -> Column:
    vertices = F.transform(
        ring, lambda p: F.concat(coordinate_text(p["x"]), F.lit(" "), coordinate_text(p["y"]))
    )
    return F.concat(F.lit("("), F.array_join(vertices, ", "), F.lit(")"))


def _polygon_text(poly: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(poly, _ring_text), ", "), F.lit(")"))


def ring_to_wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON ("), _ring_text(ring), F.lit(")"))


def geometry_to_wkt(geom: Column) -> Column:
    parts = F.transform(geom, _polygon_text)
    return (
        F.when(F.size(geom) == 0, F.lit("POLYGON EMPTY"))
        .when(F.size(geom) == 1, F.concat(F.lit("POLYGON "), parts[0]))
        .otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")")))
    )


def geometry_from_wkt(text: Column) -> Column:
    """Polygons and multipolygons; NULL for anything else, for empty and for malformed text."""
    body = F.regexp_extract(text, r"(?is)^\s*(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", 1)

    def vertex(pair: Column) -> Column:
        parts = F.split(F.trim(pair), r"\s+")
        return point(
            F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
        )

    def ring(chunk: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(chunk, r"[()]", ""), ","), vertex)

    parsed = F.transform(
        F.split(body, r"\)\s*\)\s*,\s*\(\s*\("),
        lambda poly: F.transform(F.split(poly, r"\)\s*,\s*\("), ring),
    )
    return bound(parsed, lambda g: F.when(is_valid(g), g))


def is_valid(geom: Column) -> Column:
    """Every ring is closed, has at least four vertices, and no coordinate is missing."""

    def ring_ok(ring: Column) -> Column:
        complete = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        closed = ring[0] == F.element_at(ring, -1)
        return F.when(F.size(ring) >= 4, complete & closed).otherwise(F.lit(False))

    polys_ok = F.forall(geom, lambda poly: (F.size(poly) > 0) & F.forall(poly, ring_ok))
    return F.coalesce((F.size(geom) > 0) & polys_ok, F.lit(False))


def exterior_from_wkt(text: Column) -> Column:
    """Exterior ring of the polygon, or of the largest part of a multipolygon."""
    return bound(
        geometry_from_wkt(text), lambda g: F.when(g.isNotNull(), F.get(largest_part(g), F.lit(0)))
    )


def geometry_from_geojson(kind: Column, coordinates: Column) -> Column:
    """``coordinates`` is the JSON text of a GeoJSON geometry; non-polygons give NULL."""

    def rings(poly: Column) -> Column:
        return F.transform(poly, lambda ring: F.transform(ring, lambda c: point(F.get(c, F.lit(0)), F.get(c, F.lit(1)))))

    single = F.from_json(F.when(kind == "Polygon", coordinates), "array<array<array<double>>>")
    many = F.from_json(
        F.when(kind == "MultiPolygon", coordinates), "array<array<array<array<double>>>>"
    )
    return F.when(kind == "Polygon", F.array(rings(single))).when(
        kind == "MultiPolygon", F.transform(many, rings)
    )


def geometry_to_geojson(geom: Column) -> Column:
    """GeoJSON geometry object text."""
    coords = F.transform(
        geom,
        lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))),
    )
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.when(F.size(geom) == 1, single).otherwise(many)
