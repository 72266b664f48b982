"""Neighbouring buildings: a distance join on grid cells, and what is gathered from it.

The edge table (src, dst, ...) is the primary form; lists per building are built from it, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.geometry import boxes_intersect, with_oriented_box
from quoin.operators.skew import salted_join
from quoin.session import durable

# Points of one cell handled by one task; denser cells are split.
CELL_ROWS = 4096


def within_distance(
    points: DataFrame,
    radius: float,
    payload: Column | None = None,
    own: Column | None = None,
    tolerance: float = 0.0,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """All ordered pairs of distinct points at most ``radius`` apart: (src, dst, distance).

    ``points`` has building_id, x, y.  ``payload`` (of the neighbour) and ``own`` (of the building)
    ride along as structs, so no second join is needed.  An equi-join on grid cells of the size of
    the radius: each source is copied to the 3 x 3 cells around it, the exact test follows.
    Coincident points are neighbours; only a point itself is left out.
    """
    reach = radius + tolerance
    if reach > 0:
        # A hair wider than the reach, so rounding cannot put two points two cells apart.
        cell = reach * (1 + 1e-9)
        spot = {"cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)}
        steps = [-1, 0, 1]
    else:
        spot = {"cell_x": F.col("x"), "cell_y": F.col("y")}
        steps = [0]
    base = points.withColumns(spot)
    carried = [payload.alias("neighbor")] if payload is not None else []
    mine = [own.alias("own")] if own is not None else []
    homes = base.select(
        F.col("building_id").alias("dst"), F.col("x").alias("dst_x"), F.col("y").alias("dst_y"),
        "cell_x", "cell_y", *carried,
    )
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])
    sources = (
        base.select(
            F.col("building_id").alias("src"), F.col("x").alias("src_x"), F.col("y").alias("src_y"),
            "cell_x", "cell_y", *mine, F.explode(around).alias("_step"),
        )
        .withColumn("cell_x", F.col("cell_x") + F.col("_step.i"))
        .withColumn("cell_y", F.col("cell_y") + F.col("_step.j"))
        .drop("_step")
    )
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    squared = dx * dx + dy * dy
    # The homes of a partition are hashed: few rows, as cells denser than ``cell_rows`` are split.  So the sources, nine
    # times as many, need not be sorted.
    pairs = salted_join(homes.hint("shuffle_hash"), sources, ("cell_x", "cell_y"), "dst", cell_rows)
    near = pairs.where((F.col("src") != F.col("dst")) & (squared <= reach * reach))
    out = [c for c in ("own", "neighbor") if c in near.columns]
    return near.select("src", "dst", F.sqrt(squared).alias("distance"), *out)


def drop_touching(edges: DataFrame, own_box: str = "own.box", neighbor_box: str = "neighbor.box") -> DataFrame:
    """Remove pairs whose rectangles intersect or touch."""
    return edges.where(~boxes_intersect(F.col(own_box), F.col(neighbor_box)))


def neighbor_edges(
    buildings: DataFrame,
    radius: float,
    default_height: float,
    floor_height: float,
    remove_touching: bool = True,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Edge table with everything later steps need.

    ``buildings`` has building_id, rect (four corners) and height_m.  Columns: src, dst, distance,
    own_x, own_y (centre of src), rect, box, height, floors (of dst).  A missing neighbour height becomes
    ``default_height``; floors are whole floors of ``floor_height``.

    Where touching pairs are removed, buildings with the same box (eager: one counting job looks for them) stand for
    one another in the pair step, as they touch, and the edges found are given to each of them afterwards.  So a spot
    with very many of them costs the edges it has, not the square of its buildings.
    """
    boxed = with_oriented_box(buildings.select("building_id", "rect", "height_m"))
    if not remove_touching:
        return _finished(_flat(_pairs(boxed, radius, tolerance)), default_height, floor_height)
    copies = boxed.where(F.col("box.cx").isNotNull()).groupBy("box").agg(F.min("building_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("box", "_first")
    if copies.isEmpty():
        return _finished(_flat(drop_touching(_pairs(boxed, radius, tolerance))), default_height, floor_height)
    marked = durable(boxed.join(copies, "box", "left"))
    ones = marked.where(F.col("_first").isNull() | (F.col("_first") == F.col("building_id")))
    edges = durable(_flat(drop_touching(_pairs(ones.select(*boxed.columns), radius, tolerance))))
    members = marked.where(F.col("_first").isNotNull()).select("_first", F.col("building_id").alias("_member"), "rect", F.col("height_m").alias("height"))
    for end in ("dst", "src"):
        # Members of a box have it in common, but not their rectangle's corners or their height.
        own = ["rect", "height"] if end == "dst" else []
        mine = members.select(F.col("_first").alias(end), "_member", *own)
        each = salted_join(mine, edges.drop(*own), (end,), "_member", CELL_ROWS).withColumn(end, F.col("_member"))
        alone = edges.join(mine.select(end).distinct(), end, "left_anti")
        edges = alone.unionByName(each.select(*edges.columns))
    return _finished(edges, default_height, floor_height)


def _pairs(boxed: DataFrame, radius: float, tolerance: float) -> DataFrame:
    """Pairs of buildings in reach, each with its own box and the neighbour's box, rect and height."""
    points = boxed.withColumns({"x": F.col("box.cx"), "y": F.col("box.cy")})
    payload = F.struct("box", "rect", F.col("height_m").alias("height"))
    return within_distance(points, radius, payload, F.struct("box"), tolerance)


def _flat(edges: DataFrame) -> DataFrame:
    return edges.select(
        "src", "dst", "distance",
        F.col("own.box.cx").alias("own_x"), F.col("own.box.cy").alias("own_y"),
        F.col("neighbor.rect").alias("rect"), F.col("neighbor.box").alias("box"), F.col("neighbor.height").alias("height"),
    )


def _finished(edges: DataFrame, default_height: float, floor_height: float) -> DataFrame:
    filled = F.coalesce(F.nanvl("height", F.lit(None).cast("double")), F.lit(float(default_height)))
    return edges.withColumn("height", filled).withColumn("floors", (F.col("height") / floor_height).cast("int"))


def gather_neighbors(edges: DataFrame) -> DataFrame:
    """Neighbour lists: (building_id, neighbors), sorted by neighbour id, always one row per building.

    A list is as long as there are buildings within the radius, so its size follows the density of the stock
    and not its size; whatever needs no list should start from the edge table.
    """
    item = F.struct(F.col("dst").alias("building_id"), "rect", "height", "floors")
    return edges.groupBy(F.col("src").alias("building_id")).agg(F.array_sort(F.collect_list(item)).alias("neighbors"))


def attach_neighbors(buildings: DataFrame, lists: DataFrame) -> DataFrame:
    """Left join of neighbour lists; a building without neighbours gets an empty list."""
    empty = F.from_json(F.lit("[]"), lists.schema["neighbors"].dataType.json())
    return buildings.join(lists, "building_id", "left").withColumn("neighbors", F.coalesce("neighbors", empty))
