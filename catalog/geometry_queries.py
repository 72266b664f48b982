"""Projection, planar geometry, rectangles, text forms and shading."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import views as V
from catalog.registry import query, r6
from catalog.views import CONFIG, oracle
from quoin.functions import geometry as G
from quoin.functions.arrow import area, geometry_from_wkb, geometry_to_wkb, measures
from quoin.functions.projection import transformer
from quoin.operators import footprints as FP
from quoin.operators import neighbors, shading
from quoin.plans.features import shaded_feature_table
from quoin.sources.footprints import parse_features, wkb_type
from quoin.sources.locations import locations

# --- projection -----------------------------------------------------------------------------

_LON = "cx / 6378137.0 * 180 / pi()"
_LAT = "(2 * atan(exp(cy / 6378137.0)) - pi() / 2) * 180 / pi()"


@query(oracle(f"SELECT building_id, round({_LON}, 9) AS lon, round({_LAT}, 9) AS lat FROM buildings", "buildings"))
def mercator_to_degrees(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = transformer(3857, 4326)(F.col("cx"), F.col("cy"))
    return V.buildings(spark, sf).select("building_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(oracle(f"""
SELECT building_id, round(lon * pi() / 180 * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137.0, 4) AS y
FROM (SELECT building_id, {_LON} AS lon, {_LAT} AS lat FROM buildings)""", "buildings"))
def degrees_to_mercator(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = transformer(3857, 4326)(F.col("cx"), F.col("cy"))
    degrees = V.buildings(spark, sf).select("building_id", lon.alias("lon"), lat.alias("lat"))
    x, y = transformer(4326, 3857)(F.col("lon"), F.col("lat"))
    return degrees.select("building_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


# UTM by the series in the third flattening n, written for zone 31 (central meridian 3 degrees).
_UTM = f"""
SELECT building_id, round(500000 + 0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS x,
  round(0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) AS y
FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS r,
    n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4
  FROM (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM (SELECT building_id, (lon - 3) * pi() / 180 AS lam, lat * pi() / 180 AS phi, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e
    FROM (SELECT building_id, CAST(1 AS DOUBLE) / 298.257223563 AS f, {_LON} AS lon, {_LAT} AS lat FROM buildings))))"""


@query(oracle(_UTM, "buildings"))
def degrees_to_utm(spark: SparkSession, sf: str) -> DataFrame:
    """Zone 31 north, millimetres."""
    x, y = transformer(3857, 32631)(F.col("cx"), F.col("cy"))
    return V.buildings(spark, sf).select("building_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(oracle("SELECT building_id, cx AS x, cy AS y FROM buildings", "buildings"))
def utm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Mercator metres to UTM and back."""
    x, y = transformer(3857, 32631)(F.col("cx"), F.col("cy"))
    there = V.buildings(spark, sf).select("building_id", x.alias("x"), y.alias("y"))
    x, y = transformer(32631, 3857)(F.col("x"), F.col("y"))
    return there.select("building_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


# --- shape ----------------------------------------------------------------------------------


@query(oracle(f"SELECT building_id, round({_LON}, 8) AS lon, round({_LAT}, 8) AS lat FROM buildings", "buildings"))
def centroid_lat_lon(spark: SparkSession, sf: str) -> DataFrame:
    df = FP.add_lat_lon(V.footprints(spark, sf), 3857)
    return df.select("building_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(oracle("SELECT building_id, round(w * d, 4) AS footprint_area FROM buildings", "buildings"))
def footprint_area(spark: SparkSession, sf: str) -> DataFrame:
    return V.footprints(spark, sf).select("building_id", F.round(area(F.col("geom")), 4).alias("footprint_area"))


@query(oracle("SELECT building_id, round(cx, 6) AS x, round(cy, 6) AS y FROM buildings", "buildings"))
def footprint_centroid(spark: SparkSession, sf: str) -> DataFrame:
    df = V.footprints(spark, sf).select("building_id", measures(F.col("geom")).alias("c"))
    return df.select("building_id", r6("c.x", "x"), r6("c.y", "y"))


def _court(df: DataFrame) -> DataFrame:
    """A building with a courtyard (half size, shifted along its length) and a detached annex."""
    ring = lambda *c: G.rectangle_ring(*c)
    ux, uy = F.cos("theta"), F.sin("theta")
    body = ring(F.col("cx"), F.col("cy"), F.col("w"), F.col("d"), F.col("theta"))
    court = ring(F.col("cx") + ux * F.col("w") / 8, F.col("cy") + uy * F.col("w") / 8, F.col("w") / 2, F.col("d") / 2, F.col("theta"))
    annex = ring(F.col("cx") + ux * F.col("w") * 2, F.col("cy") + uy * F.col("w") * 2, F.col("w") / 3, F.col("d"), F.col("theta"))
    return df.withColumn("geom", F.array(F.array(body, court), F.array(annex)))


@query(oracle("""
SELECT building_id, round(a, 4) AS area, round(cx + cos(theta) * s / a, 6) AS x, round(cy + sin(theta) * s / a, 6) AS y FROM (
  SELECT *, w * d * 3 / 4 + w * d / 3 AS a, -(w * d / 4) * (w / 8) + (w * d / 3) * (2 * w) AS s FROM buildings)""", "buildings"))
def courtyard_and_annex(spark: SparkSession, sf: str) -> DataFrame:
    """Holes subtract, parts add: area and centroid of a multipolygon with a hole."""
    df = _court(V.buildings(spark, sf)).select("building_id", measures(F.col("geom")).alias("c"))
    return df.select("building_id", F.round("c.area", 4).alias("area"), r6("c.x", "x"), r6("c.y", "y"))


def _notched(df: DataFrame) -> DataFrame:
    """L-shape with one slanted side: six vertices, so the rectangle really has to be searched."""
    ux, uy = F.cos("theta"), F.sin("theta")
    w, d = F.col("w"), F.col("d")
    shape = [(0.0, 0.0), (1.0, 0.0), (1.1, 0.4), (0.6, 0.5), (0.5, 1.0), (0.0, 0.9)]
    points = [
        G.point(F.col("cx") + w * (p * 1.0) * ux - d * (q * 1.0) * uy, F.col("cy") + w * (p * 1.0) * uy + d * (q * 1.0) * ux)
        for p, q in [*shape, shape[0]]
    ]
    return df.withColumn("geom", F.array(F.array(F.array(*points))))


_NOTCH = """verts AS (SELECT b.building_id, i, w * p * cos(theta) - d * q * sin(theta) AS x, w * p * sin(theta) + d * q * cos(theta) AS y
  FROM buildings b, (VALUES (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.1, 0.4), (3, 0.6, 0.5), (4, 0.5, 1.0), (5, 0.0, 0.9)) AS s(i, p, q)),
dirs AS (SELECT a.building_id, a.i * 10 + b.i AS dir, atan2(b.y - a.y, b.x - a.x) AS phi FROM verts a JOIN verts b ON a.building_id = b.building_id AND a.i < b.i),
ext AS (SELECT v.building_id, dir, max(x * cos(phi) + y * sin(phi)) - min(x * cos(phi) + y * sin(phi)) AS e1, max(y * cos(phi) - x * sin(phi)) - min(y * cos(phi) - x * sin(phi)) AS e2
  FROM verts v JOIN dirs USING (building_id) GROUP BY 1, 2)"""


@query(oracle("SELECT * FROM buildings", "buildings").replace("SELECT * FROM buildings", "").rstrip() + ", " + _NOTCH + """
SELECT building_id, round(min(e1 * e2), 3) AS rect_area FROM ext GROUP BY 1""")
def minimum_rectangle_area(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest rectangle around a non-convex six-vertex shape."""
    df = FP.add_rectangles(_notched(V.buildings(spark, sf)), "geom")
    return df.select("building_id", F.round(F.col("short_edge") * F.col("long_edge"), 3).alias("rect_area"))


@query(oracle("""SELECT building_id, w * d AS footprint_area, CAST(1.0 AS DOUBLE) AS rect_fill_ratio, short_edge, long_edge,
  round(long_edge_angle, 6) AS long_edge_angle, round(long_edge / short_edge, 6) AS aspect_ratio FROM shaped""", "shaped"))
def rectangle_features(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangle found by the search, features compared with the known shape."""
    df = FP.add_rectangles(V.footprints(spark, sf), "geom")
    return df.select(
        "building_id", F.round("footprint_area", 4).alias("footprint_area"), r6("rect_fill_ratio"), "short_edge", "long_edge",
        r6("long_edge_angle"), r6("aspect_ratio"),
    )


# Rings of 5 to 60 vertices with uneven radii; rings of even ids have a vertex in the middle of every side.
_RING = """SELECT building_id, CAST(building_id AS INT) AS id,
  CASE WHEN CAST(building_id AS INT) % 2 = 0 THEN 3 + CAST(building_id AS INT) % 28 ELSE 5 + CAST(building_id AS INT) % 56 END AS n FROM buildings"""
_VERTEX = "(6 + (id * 31 + ({j}) * ({j}) * 17) % 13)"


@query(oracle("SELECT 1", "buildings").rsplit("SELECT 1", 1)[0].rstrip() + f""", rings AS ({_RING}), corner AS (
  SELECT building_id, id, n, j, {_VERTEX.format(j="j")} * cos(2 * pi() * j / n) AS x, {_VERTEX.format(j="j")} * sin(2 * pi() * j / n) AS y
  FROM rings, range(60) AS t(j) WHERE j < n
), vertex AS (
  SELECT building_id, 2 * j AS k, x, y FROM corner UNION ALL
  SELECT a.building_id, 2 * a.j + 1, (a.x + b.x) / 2, (a.y + b.y) / 2 FROM corner a JOIN corner b ON a.building_id = b.building_id AND b.j = (a.j + 1) % a.n WHERE a.id % 2 = 0
), direction AS (
  SELECT a.building_id, a.k AS i, b.k AS j, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ux, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS uy
  FROM vertex a JOIN vertex b ON a.building_id = b.building_id AND a.k < b.k AND (a.x <> b.x OR a.y <> b.y)
), extent AS (
  SELECT d.building_id, max(x * ux + y * uy) - min(x * ux + y * uy) AS e1, max(y * ux - x * uy) - min(y * ux - x * uy) AS e2
  FROM direction d JOIN vertex v ON v.building_id = d.building_id GROUP BY d.building_id, i, j
), best AS (
  SELECT building_id, greatest(e1, e2) AS l, least(e1, e2) AS s, row_number() OVER (PARTITION BY building_id ORDER BY round(e1 * e2, 6), round(greatest(e1, e2), 6) DESC) AS rn FROM extent
)
SELECT b.building_id, count(*) AS n_vertices, round(any_value(l), 3) AS long_edge, round(any_value(s), 3) AS short_edge FROM best b JOIN vertex v ON v.building_id = b.building_id WHERE rn = 1 GROUP BY 1""")
def ring_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest rectangles of rings with 5 to 60 vertices, compared with all directions between two vertices."""
    V.buildings(spark, sf).createOrReplaceTempView("ring_buildings")
    rings = spark.sql(_RING.replace("FROM buildings", "FROM ring_buildings"))

    def vertex(j):
        radius = 6 + (F.col("id") * 31 + j * j * 17) % 13
        turn = 2 * math.pi * j / F.col("n")
        return radius * F.cos(turn), radius * F.sin(turn)

    def point(k):  # vertices have even numbers, the middles of sides odd ones
        (ax, ay), (bx, by) = (vertex(f(k / 2).cast("bigint") % F.col("n")) for f in (F.floor, F.ceil))
        return F.struct(((ax + bx) / 2).alias("x"), ((ay + by) / 2).alias("y"))

    step = F.when(F.col("id") % 2 == 0, 1).otherwise(2)
    points = F.transform(F.sequence(F.lit(0), 2 * F.col("n") - step, step), point)
    shapes = rings.withColumn("points", points).withColumn("geom", F.array(F.array(F.concat("points", F.slice("points", 1, 1)))))
    found = FP.add_rectangles(shapes, "geom")
    return found.select("building_id", F.size("points").cast("bigint").alias("n_vertices"), F.round("long_edge", 3).alias("long_edge"), F.round("short_edge", 3).alias("short_edge"))


@query(oracle("""
SELECT building_id, CAST(pos AS INT) AS pos, round(cx + sx * w / 2 * cos(theta) - sy * d / 2 * sin(theta), 6) AS lon, round(cy + sx * w / 2 * sin(theta) + sy * d / 2 * cos(theta), 6) AS lat
FROM buildings, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) AS s(pos, sx, sy)""", "buildings"))
def exterior_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    df = FP.exterior_coordinates(V.footprints(spark, sf))
    long = df.select("building_id", F.posexplode(F.arrays_zip("lons", "lats")).alias("pos", "v"))
    return long.select("building_id", "pos", r6("v.lons", "lon"), r6("v.lats", "lat"))


# --- text and binary forms ------------------------------------------------------------------


def _number(expression: str) -> str:
    return f"rtrim(rtrim(CAST(CAST(round({expression}, 6) AS DECIMAL(24,6)) AS VARCHAR), '0'), '.')"


@query(oracle(f"""
SELECT building_id, 'POLYGON ((' || string_agg({_number('vx')} || ' ' || {_number('vy')}, ', ' ORDER BY k) || '))' AS wkt FROM (
  SELECT building_id, k, vx, vy FROM corners UNION ALL SELECT building_id, 4, vx, vy FROM corners WHERE k = 0) GROUP BY 1""", "corners"))
def geometry_as_wkt(spark: SparkSession, sf: str) -> DataFrame:
    df = V.cleaned(spark, sf).withColumn("geom", F.array(F.array(F.concat("rect", F.slice("rect", 1, 1)))))
    return df.select("building_id", G.geometry_to_wkt(F.col("geom")).alias("wkt"))


@query(oracle("""
SELECT building_id, CAST(5 AS INT) AS n_vertices, round(w * d, 3) AS area FROM buildings WHERE typology <> 'School'
UNION ALL SELECT building_id, NULL, NULL FROM buildings WHERE typology = 'School'""", "buildings"))
def wkt_exterior_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Text back to the exterior ring: of the larger part for multipolygons, NULL for other text."""
    df = V.footprints(spark, sf)
    annex = G.rectangle_ring(F.col("cx") + 500, F.col("cy"), F.col("w") / 2, F.col("d") / 2, F.col("theta"))
    use = F.col("typology")
    text = (
        F.when(use == "School", F.lit("POINT (1 2)"))
        .when(use == "Office", G.geometry_to_wkt(F.array(F.array(annex), F.col("geom")[0])))
        .otherwise(G.geometry_to_wkt(F.col("geom")))
    )
    ring = df.select("building_id", G.exterior_from_wkt(text).alias("ring"))
    return ring.select(
        "building_id",
        F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n_vertices"),
        F.round(area(F.when(F.col("ring").isNotNull(), F.array(F.array("ring")))), 3).alias("area"),
    )


@query(oracle("""SELECT building_id, CASE WHEN typology = 'Office' THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type,
  round(w * d * (CASE WHEN typology = 'Office' THEN 13.0 / 12 ELSE 1 END), 3) AS area FROM buildings""", "buildings"))
def geojson_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints written as GeoJSON features and parsed again."""
    plain = V.footprints(spark, sf)
    df = _court(plain).withColumn("geom", F.when(F.col("typology") == "Office", F.col("geom")).otherwise(
        F.array(F.array(F.col("geom")[0][0]))))
    text = F.concat(
        F.lit('{"type":"Feature","properties":{"building_id":"'), F.col("building_id"), F.lit('"},"geometry":'),
        G.geometry_to_geojson(F.col("geom")), F.lit("}"),
    )
    parsed = parse_features(df.select(text.alias("value")), T.StructType([T.StructField("building_id", T.StringType())]))
    return parsed.select("building_id", "geom_type", F.round(area(F.col("geom")), 3).alias("area"))


@query(oracle("""SELECT building_id, CASE WHEN typology = 'Office' THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type,
  round(w * d * (CASE WHEN typology = 'Office' THEN 13.0 / 12 ELSE 1 END), 3) AS area FROM buildings""", "buildings"))
def wkb_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints written as well-known binary and read again."""
    df = _court(V.buildings(spark, sf)).withColumn(
        "geom", F.when(F.col("typology") == "Office", F.col("geom")).otherwise(F.array(F.array(F.col("geom")[0][0]))))
    blobs = df.select("building_id", geometry_to_wkb(F.col("geom")).alias("blob"))
    back = blobs.select("building_id", wkb_type(F.col("blob")).alias("geom_type"), geometry_from_wkb(F.col("blob")).alias("geom"))
    return back.select("building_id", "geom_type", F.round(area(F.col("geom")), 3).alias("area"))


@query(oracle(f"""SELECT building_id, round(CASE WHEN typology IN ('School', 'Hotel') THEN {_LAT} ELSE cy / 10000 END, 6) AS lat,
  round(CASE WHEN typology IN ('School', 'Hotel') THEN {_LON} ELSE cx / 10000 END, 6) AS lon FROM buildings""", "buildings"))
def building_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Given coordinates where both are there, else the centroid in degrees; hotels have half a position."""
    lat = F.when(~F.col("typology").isin("School"), F.col("cy") / 10000)
    lon = F.when(~F.col("typology").isin("School", "Hotel"), F.col("cx") / 10000)
    df = V.footprints(spark, sf).select("building_id", "geom", lat.alias("lat"), lon.alias("lon"))
    return locations(df, srid=3857).select("building_id", r6("lat"), r6("lon"))


# --- local plane ----------------------------------------------------------------------------


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = transformer(3857, 4326)(F.col("cx"), F.col("cy"))
    return V.cleaned(spark, sf).withColumns({"lon": lon, "lat": lat})


_OFFSETS = f"""SELECT p.*, (lon - lon0) * 111320.0 * cos(lat0 * pi() / 180) AS ox, (lat - lat0) * 110540.0 AS oy
  FROM (SELECT *, {_LON} AS lon, {_LAT} AS lat FROM cleaned) p, (SELECT avg({_LON}) AS lon0, avg({_LAT}) AS lat0 FROM cleaned)"""


@query(oracle(f"SELECT building_id, round(ox, 4) + 0.0 AS offset_x, round(oy, 4) + 0.0 AS offset_y FROM ({_OFFSETS})", "cleaned"))
def local_offsets(spark: SparkSession, sf: str) -> DataFrame:
    df = FP.local_offsets(_placed(spark, sf).select("building_id", "lat", "lon"))
    return df.select("building_id", F.round("offset_x", 4).alias("offset_x"), F.round("offset_y", 4).alias("offset_y"))


@query(oracle(f"""
SELECT building_id, CAST(k AS INT) AS pos, height_m AS height,
  round(vx - avg(vx) OVER (PARTITION BY building_id) + ox, 3) + 0.0 AS x, round(vy - avg(vy) OVER (PARTITION BY building_id) + oy, 3) + 0.0 AS y FROM (
  SELECT o.*, k, round(cx + sx * w / 2 * cos(theta) - sy * d / 2 * sin(theta), 6) AS vx, round(cy + sx * w / 2 * sin(theta) + sy * d / 2 * cos(theta), 6) AS vy
  FROM ({_OFFSETS}) o, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) AS s(k, sx, sy))""", "cleaned"))
def map_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the listed vertices counts the closing vertex twice."""
    from quoin.operators.specs import closed_wkt

    df = _placed(spark, sf).withColumn("rotated_rectangle", closed_wkt(F.col("rect")))
    shapes = FP.map_polygons(df, "rotated_rectangle", "height_m")
    long = shapes.select("building_id", "height", F.posexplode("polygon").alias("pos", "p"))
    return long.select("building_id", "pos", "height", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


# --- shading --------------------------------------------------------------------------------


def _edges_of(df: DataFrame) -> DataFrame:
    return neighbors.neighbor_edges(df, CONFIG.neighbor_threshold, CONFIG.default_height, CONFIG.f2f_height)


_MASK = """corner2 AS (SELECT building_id, k, vx, vy FROM corners),
sides AS (SELECT n.src, n.dst, n.b_height, p.vx - n.ax AS px, p.vy - n.ay AS py, q.vx - p.vx AS ex, q.vy - p.vy AS ey
  FROM apart n JOIN corner2 p ON p.building_id = n.dst JOIN corner2 q ON q.building_id = n.dst AND q.k = (p.k + 1) % 4),
hits AS (SELECT src, bin, b_height, (px * ey - py * ex) / den AS t, (px * dy - py * dx) / den AS s
  FROM (SELECT *, dx * ey - dy * ex AS den FROM (SELECT *, cos(2 * pi() * bin / 48) AS dx, sin(2 * pi() * bin / 48) AS dy
    FROM sides, (SELECT unnest(range(48)) AS bin))) WHERE den <> 0),
mask AS (SELECT c.building_id, CAST(bins.bin AS INT) AS bin, coalesce(m.elevation, 0.0) AS elevation
  FROM cleaned c CROSS JOIN (SELECT unnest(range(48)) AS bin) bins
  LEFT JOIN (SELECT src, bin, max(atan(b_height / t)) AS elevation FROM hits WHERE t > 0 AND s BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY 1, 2) m
  ON m.src = c.building_id AND m.bin = bins.bin)"""


def _mask_oracle(body: str) -> str:
    return oracle("", "corners", "apart").rstrip() + ",\n" + _MASK + "\n" + body


@query(_mask_oracle("SELECT building_id, bin, round(elevation, 6) AS elevation FROM mask"))
def shading_mask(spark: SparkSession, sf: str) -> DataFrame:
    df = V.stored(spark, sf)
    masks = shading.shading_mask(df, _edges_of(df))
    return shading.mask_bins(masks).select("building_id", "bin", r6("elevation"))


@query(_mask_oracle("""
SELECT building_id, bin, round(a, 6) AS azimuth, round(100 * cos(a) + h * sin(a), 6) + 0.0 AS x0, round(100 * sin(a) - h * cos(a), 6) + 0.0 AS y0,
  round(100 * cos(a) - h * sin(a), 6) + 0.0 AS x1, round(100 * sin(a) + h * cos(a), 6) + 0.0 AS y1, round(100 * tan(elevation), 4) AS fence_height, round(2 * h, 6) AS fence_width
FROM (SELECT *, 2 * pi() * bin / 48 AS a, 100 * tan(pi() / 48) AS h FROM mask)"""))
def shading_fence(spark: SparkSession, sf: str) -> DataFrame:
    df = V.stored(spark, sf)
    masks = shading.shading_mask(df, _edges_of(df))
    fence = shading.shading_fence(masks, 100.0)
    return fence.select(
        "building_id", "bin", *[r6(c) for c in ("azimuth", "x0", "y0", "x1", "y1")],
        F.round("fence_height", 4).alias("fence_height"), r6("fence_width"),
    )


@query(_mask_oracle("""
SELECT m.building_id, bin, CAST(floor(100 * tan(elevation) / 3.0 + 1e-9) AS BIGINT) AS floors,
  round(cx + 102 * cos(a) - h * sin(a), 4) AS x2, round(cy + 102 * sin(a) + h * cos(a), 4) AS y2,
  round(cx + 102 * cos(a) + h * sin(a), 4) AS x3, round(cy + 102 * sin(a) - h * cos(a), 4) AS y3
FROM (SELECT *, 2 * pi() * bin / 48 AS a, 100 * tan(pi() / 48) AS h FROM mask) m JOIN cleaned c ON c.building_id = m.building_id"""))
def fence_polygons(spark: SparkSession, sf: str) -> DataFrame:
    from quoin.plans.preprocess import rectangle_centres

    df = V.stored(spark, sf)
    fence = shading.shading_fence(shading.shading_mask(df, _edges_of(df)), 100.0)
    quads = shading.fence_polygons(fence, rectangle_centres(df), CONFIG.f2f_height)
    corner = [F.col("quad")[i] for i in (2, 3)]
    return quads.select(
        "building_id", "bin", "floors",
        F.round(corner[0]["x"], 4).alias("x2"), F.round(corner[0]["y"], 4).alias("y2"),
        F.round(corner[1]["x"], 4).alias("x3"), F.round(corner[1]["y"], 4).alias("y3"),
    )


_BINS = ", ".join(f"max(CASE WHEN bin = {k} THEN round(elevation, 6) END) AS \"feature.geometry.shading_mask_{k:02d}\"" for k in range(48))


@query(_mask_oracle(f"""SELECT c.building_id, any_value(long_edge) AS "feature.geometry.long_edge", CAST(any_value(n_floors) AS INT) AS "feature.geometry.num_floors",
  any_value(typology) AS "feature.semantic.Typology", {_BINS} FROM cleaned c JOIN mask m ON m.building_id = c.building_id GROUP BY 1"""))
def shaded_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature records with their 48 shading columns, from cleaned buildings in one plan."""
    df = shaded_feature_table(V.stored(spark, sf), CONFIG, {"Typology": "typology"})
    plain = ["feature.geometry.long_edge", "feature.geometry.num_floors", "feature.semantic.Typology"]
    masks = [c for c in df.columns if "shading_mask" in c]
    return df.select("building_id", *(F.col(f"`{c}`") for c in plain), *(r6(F.col(f"`{c}`"), c) for c in masks))
