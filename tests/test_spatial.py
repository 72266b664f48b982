import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.functions.arrow import area, corners_to_points, geometry_from_wkb, geometry_to_wkb, measures, shape
from quoin.functions.projection import transformer
from quoin.operators import neighbors, shading, stations
from quoin.operators.footprints import add_rectangles
from quoin.sources.footprints import wkb_type


def points_frame(spark, points):
    return spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(points)], "building_id string, x double, y double")


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def shapes(spark, geoms):
    schema = "id int, geom array<array<array<struct<x:double,y:double>>>>"
    return spark.createDataFrame(list(enumerate(geoms)), schema)


@pytest.mark.parametrize("cell_rows", [4096, 3])
@pytest.mark.parametrize("parts", [1, 7])
def test_neighbors_match_brute_force_even_when_cells_are_split(spark, cell_rows, parts):
    rng = random.Random(5)
    points = [(rng.uniform(0, 60), rng.uniform(-40, 40)) for _ in range(120)] + [(1.0, 1.0)] * 12 + [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]
    found = neighbors.within_distance(points_frame(spark, points).repartition(parts), 10.0, cell_rows=cell_rows)
    got = {(r.src, r.dst) for r in found.collect()}
    expected = {
        (str(i), str(j)) for i, p in enumerate(points) for j, q in enumerate(points) if i != j and math.dist(p, q) <= 10.0
    }
    assert got == expected
    assert all((b, a) in got for a, b in got)
    assert found.count() == len(got)


def test_radius_zero_joins_coincident_points_only(spark):
    found = neighbors.within_distance(points_frame(spark, [(0, 0), (0, 0), (1, 0)]), 0.0)
    assert {(r.src, r.dst) for r in found.collect()} == {("0", "1"), ("1", "0")}


def test_neighbor_lists_are_one_row_whatever_their_length(spark):
    edges = spark.range(9000).select(
        F.lit("a").alias("src"), F.col("id").cast("string").alias("dst"),
        F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("rect"), F.lit(6.0).alias("height"), F.lit(2).alias("floors"),
    )
    whole = neighbors.gather_neighbors(edges).collect()
    assert len(whole) == 1
    assert [n.building_id for n in whole[0].neighbors] == sorted(map(str, range(9000)))
    lonely = neighbors.attach_neighbors(spark.createDataFrame([("b",)], "building_id string"), neighbors.gather_neighbors(edges))
    assert lonely.first().neighbors == []


def test_touching_boxes_intersect(spark):
    rows = [(0, 4.0, 0.0), (1, 4.0 + 1e-6, 0.0), (2, 3.0, 0.0), (3, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, dx double, dy double")
    box = lambda x, y: F.struct(x.alias("cx"), y.alias("cy"), F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(2.0).alias("hu"), F.lit(2.0).alias("hv"))
    got = df.select("id", G.boxes_intersect(box(F.lit(0.0), F.lit(0.0)), box(F.col("dx"), F.col("dy"))).alias("t"))
    assert {r.id: r.t for r in got.collect()} == {0: True, 1: False, 2: True, 3: True}


@pytest.mark.parametrize("threshold, finest", [(500.0, 2000.0), (500.0, 10.0), (60.0, 5.0), (None, 50.0)])
def test_nearest_station_matches_brute_force(spark, threshold, finest):
    rng = random.Random(9)
    points = [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(150)]
    sites = [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(25)] + [(0.0, 0.0), (0.0, 0.0)]
    table = spark.createDataFrame([(f"s{i:02d}", float(x), float(y), "p") for i, (x, y) in enumerate(sites)], "station_id string, x double, y double, path string")
    found = {r.building_id: r.station_id for r in stations.nearest_station(points_frame(spark, points), table, threshold, finest).collect()}
    expected = {}
    for i, p in enumerate(points):
        d, s = min((math.dist(p, q), f"s{k:02d}") for k, q in enumerate(sites))
        if threshold is None or d < threshold:
            expected[str(i)] = s
    assert found == expected


def test_threshold_is_strict(spark):
    table = spark.createDataFrame([("s", 100.0, 0.0, "p")], "station_id string, x double, y double, path string")
    found = stations.nearest_station(points_frame(spark, [(0, 0), (0.5, 0)]), table, 100.0)
    assert [r.building_id for r in found.collect()] == ["1"]


def test_station_urls(spark):
    df = spark.createDataFrame([("a/b.zip",), ("/a/b.zip",), ("http://x/y.zip",)], "p string")
    urls = [r.u for r in df.select(stations.station_url(F.col("p"), "https://h.org/w/").alias("u")).collect()]
    assert urls == ["https://h.org/w/a/b.zip", "https://h.org/a/b.zip", "http://x/y.zip"]


def test_measures_of_holes_parts_and_degenerate_shapes(spark):
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (2, 4), (4, 4), (4, 2))
    far = ring((20, 0), (30, 0), (30, 10), (20, 10))
    line = ring((0, 0), (1, 0), (2, 0))
    rows = shapes(spark, [[[square]], [[square, hole]], [[square], [far]], [[line]], None, []]).select("id", measures(F.col("geom")).alias("m"))
    m = {r.id: r.m for r in rows.collect()}
    assert m[0].area == 100 and (m[0].x, m[0].y) == (5, 5)
    assert m[1].area == 96 and m[1].x == pytest.approx((500 - 4 * 3) / 96)
    assert m[2].area == 200 and m[2].x == pytest.approx(15)
    assert m[3].area == 0 and m[3].x is None
    assert m[4].area is None and m[5].area is None


def test_minimum_rectangle_properties(spark):
    rng = np.random.default_rng(3)
    geoms = []
    for n in (3, 5, 8, 12, 13, 40):
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        radius = rng.uniform(3, 12, n)
        geoms.append([[ring(*zip(5e5 + radius * np.cos(angle), 2e5 + radius * np.sin(angle)))]])
    turn = 0.7
    turned = [[[[{"x": p["x"] * math.cos(turn) - p["y"] * math.sin(turn), "y": p["x"] * math.sin(turn) + p["y"] * math.cos(turn)} for p in r] for r in part] for part in g] for g in geoms]
    a, b = ({r.id: r for r in add_rectangles(shapes(spark, g), "geom").collect()} for g in (geoms, turned))
    for i, g in enumerate(geoms):
        assert a[i].short_edge * a[i].long_edge >= a[i].footprint_area - 1e-6
        assert a[i].long_edge == pytest.approx(b[i].long_edge, abs=1e-5)
        shift = (b[i].long_edge_angle - a[i].long_edge_angle - turn) % math.pi
        assert min(shift, math.pi - shift) < 1e-5
        # Brute force over every pair of vertices.
        pts = np.array([(p["x"], p["y"]) for p in g[0][0][:-1]]) - [5e5, 2e5]
        best = math.inf
        for p in range(len(pts)):
            for q in range(p):
                u = (pts[p] - pts[q]) / np.hypot(*(pts[p] - pts[q]))
                s, t = pts @ u, pts @ np.array([-u[1], u[0]])
                best = min(best, (s.max() - s.min()) * (t.max() - t.min()))
        assert a[i].short_edge * a[i].long_edge == pytest.approx(best, rel=1e-5)


def test_collinear_footprint_has_no_aspect_ratio(spark):
    row = add_rectangles(shapes(spark, [[[ring((0, 0), (3, 4), (6, 8))]]]), "geom").first()
    assert row.short_edge == 0 and row.long_edge == 10 and row.aspect_ratio is None


def test_wkt_edge_cases(spark):
    texts = [
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((0 0, 9 0, 9 9, 0 9, 0 0)))",
        "POLYGON EMPTY", "POINT (1 2)", "POLYGON ((0 0, 4 0, 4 x, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4))", "nonsense", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rings = {r.id: r.ring for r in df.select("id", G.exterior_from_wkt(F.col("t")).alias("ring")).collect()}
    assert len(rings[0]) == 5 and rings[1][1].x == 9.0
    assert all(rings[i] is None for i in range(2, 8))
    back = df.where("id < 2").select("id", G.geometry_to_wkt(G.geometry_from_wkt(F.col("t"))).alias("t")).collect()
    assert {r.id: r.t for r in back} == dict(enumerate(texts[:2]))


def test_wkb_reads_other_byte_orders_dimensions_and_types(spark):
    import struct

    big = struct.pack(">BIII", 0, 3, 1, 4) + struct.pack(">8d", 0, 0, 1, 0, 1, 1, 0, 0)
    raised = struct.pack("<BIII", 1, 1003, 1, 4) + struct.pack("<12d", 0, 0, 9, 1, 0, 9, 1, 1, 9, 0, 0, 9)
    ewkb = struct.pack("<BIIII", 1, 0x20000003, 3857, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate((big, raised, ewkb, point))], "id int, b binary")
    rows = df.select("id", wkb_type(F.col("b")).alias("t"), geometry_from_wkb(F.col("b")).alias("g")).collect()
    assert [r.t for r in rows] == ["Polygon", "Polygon", "Polygon", "Point"]
    assert all(len(r.g[0][0]) == 4 for r in rows[:3]) and rows[3].g is None
    again = df.where("id < 3").select(area(geometry_from_wkb(geometry_to_wkb(geometry_from_wkb(F.col("b"))))).alias("a")).collect()
    assert [r.a for r in again] == [0.5] * 3


def test_utm_known_values(spark):
    # On the central meridian the easting is the false easting; the equator is at zero.
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 52.0), (4.5, -33.0)], "lon double, lat double")
    x, y = transformer(4326, 32631)(F.col("lon"), F.col("lat"))
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    rows = there.collect()
    assert rows[0].x == pytest.approx(500000) and rows[0].y == pytest.approx(0, abs=1e-6)
    lon, lat = transformer(32631, 4326)(F.col("x"), F.col("y"))
    for r in there.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-10) and r.lat2 == pytest.approx(r.lat, abs=1e-10)
    with pytest.raises(ValueError):
        transformer(4326, 27700)


def test_fence_segments_meet_and_masks_default_to_zero(spark):
    edges = spark.createDataFrame([], "src string, own_x double, own_y double, box struct<cx:double,cy:double,ux:double,uy:double,hu:double,hv:double>, height double")
    masks = shading.shading_mask(spark.createDataFrame([("a",)], "building_id string"), edges)
    rows = shading.shading_fence(masks, 100.0).orderBy("bin").collect()
    assert len(rows) == 48 and all(r.fence_height == 0 for r in rows)
    for r, s in zip(rows, rows[1:] + rows[:1]):
        assert (r.x1, r.y1) == pytest.approx((s.x0, s.y0))


def test_a_wall_to_the_east_shades_the_east(spark):
    box = (20.0, 0.0, 0.0, 1.0, 5.0, 1.0)
    edges = spark.createDataFrame(
        [("a", 0.0, 0.0, box, 19.0)],
        "src string, own_x double, own_y double, box struct<cx:double,cy:double,ux:double,uy:double,hu:double,hv:double>, height double",
    )
    seen = {r.bin: r.elevation for r in shading.obstructions(edges).collect()}
    assert set(seen) == {47, 0, 1} and seen[0] == pytest.approx(math.pi / 4)


def test_shape_corners_surround_all_parts(spark):
    far = [[ring((0, 0), (1, 0), (1, 1), (0, 1))], [ring((9, 0), (10, 0), (10, 1), (9, 1))]]
    rect = shapes(spark, [far]).select(corners_to_points(shape(F.col("geom"))["corners"]).alias("r")).first().r
    assert sorted({round(p.x, 6) for p in rect}) == [0, 10]


def city(spark, n=3):
    """Small squares in degrees, and one station next to them in degrees."""
    from quoin.functions.arrow import moved_geometry

    rings = [[[ring((500000 + 40 * k, 200000), (500010 + 40 * k, 200000), (500010 + 40 * k, 200010), (500000 + 40 * k, 200010))]] for k in range(n)]
    df = shapes(spark, rings).withColumn("geom", moved_geometry(F.col("geom"), 32631, 4326)).withColumn("geom_type", F.lit("Polygon"))
    df = df.select(F.col("id").alias("osm"), "geom", "geom_type", F.lit(9.0).alias("tall"), F.lit("Office").alias("use_of_bui"), F.lit(0.3).alias("glass"))
    sites = spark.createDataFrame([("s", 3.0, 1.81, "tmyx", "a.zip")], "station_id string, x double, y double, source string, path string")
    return df, sites


def test_pipeline_in_degrees_with_own_column_names(spark):
    from quoin import FieldSpec, PreprocessConfig
    from quoin.plans.preprocess import Columns, preprocess
    from quoin.sources.footprints import keep_srid, srid_of

    df, sites = city(spark)
    names = Columns(id="osm", height="tall", wwr="glass")
    fields = [FieldSpec("use_of_building", ("Office",))]
    out, report = preprocess(keep_srid(df, 4326), sites, PreprocessConfig(metric_srid=32631), None, fields, stations_srid=4326, columns=names)
    rows = out.collect()
    assert len(rows) == 3 and srid_of(out) == 4326
    for r in rows:
        assert (r.wwr, r.n_floors, r.context["use_of_building"]) == (0.3, 3.0, "Office")
        assert r.footprint_area == pytest.approx(100, abs=1e-3) and r.weather_file.endswith("a.zip") and len(r.neighbors) == 2
    assert {r.reason: r.n_rows for r in report.collect()} == {"kept": 3}


def test_strict_stops_without_a_station_in_reach(spark):
    from quoin import PreprocessConfig
    from quoin.operators.checks import ValidationError
    from quoin.plans.preprocess import Columns, preprocess

    df, sites = city(spark, 1)
    config = PreprocessConfig(metric_srid=32631)
    far = sites.withColumn("y", F.lit(40.0))
    args = {"columns": Columns(id="osm", height="tall"), "stations_srid": 4326}
    with pytest.raises(ValidationError, match="no weather station"):
        preprocess(df, far, config, 4326, [], **args)
    assert preprocess(df, far, config, 4326, [], strict=False, **args)[0].first().weather_file is None


def test_utm_plans_are_short(spark):
    from quoin import PreprocessConfig
    from quoin.plans.preprocess import Columns, assess

    df, _ = city(spark, 1)
    plan = assess(df, PreprocessConfig(metric_srid=32631), 4326, Columns(id="osm", height="tall"))._jdf.queryExecution().executedPlan().toString()
    assert "atanh" not in plan.lower()


def test_rectangles_of_many_rows_at_once():
    """One batch of rings of 1 to 61 vertices, collinear and repeated points, ties: equal to all pairs of vertices."""
    from quoin.functions.rectangles import corners

    rng, rows = np.random.default_rng(5), []
    for k in range(240):
        n = int(rng.integers(1, 62 if k % 3 else 7))
        points = rng.normal(size=(n, 2)) * [20, 7] + [5e5, 2e5]
        if k % 4 == 0:
            points = np.round(points)
        if k % 7 == 0:  # regular: many rectangles of the same area
            turn = np.linspace(0, 2 * np.pi, n, endpoint=False) + 0.1 * k
            points = np.stack([np.cos(turn), np.sin(turn)], 1) * 10 + [5e5, 2e5]
        if k % 2:
            points = np.stack([points, (points + np.roll(points, -1, 0)) / 2], 1).reshape(-1, 2)
        rows.append(points)
    rows.append(np.array([[0.0, 0.0], [1.0, np.nan], [1.0, 1.0]]))
    x, y = np.concatenate(rows).T
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found = corners(x, y, row, len(rows) + 1).reshape(-1, 4, 2)
    assert np.isnan(found[-2:]).all()  # not finite, and a row without vertices
    for points, got in zip(rows[:-1], found, strict=False):
        p = points - points[0]
        i, j = np.triu_indices(len(p), 1)
        d = p[j] - p[i]
        length = np.hypot(*d.T)
        u = d[length > 0] / length[length > 0, None]
        if not len(u):
            assert np.isnan(got).all()
            continue
        along, across = u @ p.T, np.stack([-u[:, 1], u[:, 0]], 1) @ p.T
        e = np.stack([np.ptp(along, 1), np.ptp(across, 1)], 1)
        area = e.prod(1)
        same = area <= area.min() + 1e-7 * max(1, area.min())
        sides = sorted(np.hypot(*(got[[1, 3]] - got[0]).T))
        assert sides[0] * sides[1] == pytest.approx(area.min(), abs=1e-6, rel=1e-9)
        assert sides[1] == pytest.approx(e[same].max(), abs=1e-6)
        if sides[0] > 1e-6:
            assert -1e-9 <= math.atan2(*(got[1] - got[0])[::-1]) < math.pi / 2


def test_buildings_on_one_spot_cost_their_edges_only(spark, monkeypatch):
    """Hundreds of buildings with one box, two spots of them: edges as for each building, pairs only between boxes."""
    spots = [(0.0, 0.0, 400, 6.0), (30.0, 0.0, 3, 9.0), (0.0, 40.0, 1, 12.0), (4.0, 0.0, 1, 7.0), (500.0, 0.0, 2, 5.0)]
    rows = [(f"{k}-{i}", x, y, h + i / 10) for k, (x, y, n, h) in enumerate(spots) for i in range(n)]
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    df = spark.createDataFrame(rows, "building_id string, x double, y double, height_m double").withColumn("rect", F.array(corner(0, 0), corner(8, 0), corner(8, 5), corner(0, 5)))
    seen = []
    real = neighbors.within_distance
    monkeypatch.setattr(neighbors, "within_distance", lambda points, *a, **k: (seen.append(points.count()), real(points, *a, **k))[1])
    monkeypatch.setattr(neighbors, "CELL_ROWS", 50)
    got = {(r["src"], r["dst"], r["height"], r["floors"], r["rect"][0]["x"]) for r in neighbors.neighbor_edges(df, 100.0, 6.0, 3.0).collect()}
    want = set()
    for a, ax, ay, _ in rows:
        for b, bx, by, h in rows:
            apart = abs(ax - bx) > 8 or abs(ay - by) > 5
            if a != b and apart and math.hypot(ax - bx, ay - by) <= 100:
                want.add((a, b, h, int(h / 3.0), bx))
    assert seen == [5] and got == want and len(want) > 3000
