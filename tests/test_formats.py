"""Geometry formats: binary forms, feature collections cut anywhere, GeoParquet footers and skipped row groups."""

import json
import random
import struct
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.functions import wkb
from quoin.operators.checks import ValidationError
from quoin.session import shared_folder
from quoin.sources import geoparquet as gp
from quoin.sources.feature_collections import feature_texts
from quoin.sources.footprints import keep_srid, load_or_build, read_geojson, read_geojson_lines, read_geoparquet
from quoin import PreprocessConfig

GEOM = "array<array<array<struct<x:double,y:double>>>>"


def points(rng, n):
    return [{"x": round(rng.uniform(-9, 9), 3), "y": round(rng.uniform(-9, 9), 3)} for _ in range(n)]


def random_geometries(seed=1, n=60):
    rng = random.Random(seed)
    out = [None, [], [[]], [[[]]], [[points(rng, 4)], []]]
    for _ in range(n):
        out.append([[points(rng, rng.randrange(6)) for _ in range(rng.randrange(1, 4))] for _ in range(rng.choice([1, 1, 1, 2, 3]))])
    return out


def plain_wkb(geom, order="<", z=False, srid=None):
    """Byte by byte, as the format says."""
    flag = 1 if order == "<" else 0
    code = lambda kind: kind | (0x80000000 if z else 0) | (0x20000000 if srid else 0)

    def head(kind, n):
        return struct.pack(order + "BI", flag, code(kind)) + (struct.pack(order + "I", srid) if srid else b"") + struct.pack(order + "I", n)

    def polygon(rings):
        return head(3, len(rings)) + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + ("3d" if z else "2d"), p["x"], p["y"], *([7.0] if z else [])) for p in r) for r in rings)

    return polygon(geom[0]) if len(geom) == 1 else head(6, len(geom)) + b"".join(map(polygon, geom))


def test_binary_forms_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(wkb, "BLOCK", 7)
    geoms = random_geometries()
    column = pa.array(geoms, wkb.GEOMETRY)
    want = [None if g is None else plain_wkb(g) for g in geoms]
    for begin, end in ((0, len(geoms)), (3, 40), (0, 1), (5, 5)):  # parts of a column begin in the middle of its values
        assert wkb.encode(column.slice(begin, end - begin)).to_pylist() == want[begin:end]
        assert wkb.decode(pa.array(want, pa.binary()).slice(begin, end - begin)).to_pylist() == geoms[begin:end]
    boxes = wkb.boxes(column.slice(2))
    for g, box in zip(geoms[2:], boxes.tolist(), strict=True):
        flat = [p for part in g for r in part for p in r]
        if flat:
            assert box == [min(p["x"] for p in flat), min(p["y"] for p in flat), max(p["x"] for p in flat), max(p["y"] for p in flat)]
        else:
            assert all(v != v for v in box)


def test_other_binary_forms_are_read():
    geoms = [g for g in random_geometries(2, 12) if g]
    mixed = [plain_wkb(g, order, z, srid) for k, g in enumerate(geoms) for order, z, srid in (("<>"[k % 2], k % 3 == 0, 4326 if k % 4 == 0 else None),)]
    assert wkb.decode(pa.array(mixed, pa.binary())).to_pylist() == geoms
    iso = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 1) + struct.pack("<3d", 1, 2, 3)  # type code with a thousand for z
    point = struct.pack("<BIdd", 1, 1, 2, 3)
    assert wkb.decode(pa.array([iso, point, None, iso], pa.large_binary())).to_pylist() == [[[[{"x": 1.0, "y": 2.0}]]], None, None, [[[{"x": 1.0, "y": 2.0}]]]]
    for cut in (3, 8, 12, 20):
        with pytest.raises(ValueError, match="too early"):
            wkb.decode(pa.array([iso[:cut], iso], pa.binary()))


# --- feature collections ----------------------------------------------------------------------

NAMES = ["plain", 'quote " and \\ back', "brace } and { [", "ends with \\", "\\\"}", "ünïcödé 日本 }", '{"type":"Feature"}', "", "tab\tline\n"]


def feature(k, rng, order=0):
    properties = {"id": k, "name": rng.choice(NAMES), "more": {"type": "Feature", "list": [{"type": "Feature", "properties": {"id": -1}}, [1, {"a": "}"}]]}}
    geometry = rng.choice([{"type": "Polygon", "coordinates": [[[0, 0], [k, 0], [k, 1.5], [0, 0]]]}, None])
    items = [("type", "Feature"), ("properties", properties), ("geometry", geometry)]
    return dict(items[order:] + items[:order])


def collection(seed, n, indent=None):
    rng = random.Random(seed)
    features = [feature(k, rng, k % 3) for k in range(n)]
    whole = {"type": "FeatureCollection", "crs": {"properties": {"name": "x}", "deep": {"a": [{}]}}}, "links": [{"rel": "self", "type": "x"}], "features": features, "after": [{"type": "Other"}]}
    return json.dumps(whole, indent=indent, ensure_ascii=seed % 2 == 0), features


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        for n, v in names.items():
            spark.conf.set(n, v or str(size))

    yield cut
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("size", [37, 200, 5000])
def test_collections_cut_anywhere(spark, tmp_path, small_blocks, size):
    want = []
    for seed, (n, indent) in enumerate([(0, None), (1, None), (25, None), (12, 2), (30, None)]):
        text, features = collection(seed, n, indent)
        (tmp_path / f"c{seed}.geojson").write_bytes(text.encode() + (b"\n" if seed == 2 else b""))
        want += [f["properties"] for f in features] + [{"rel": "self"}, {"other": 1}]
    small_blocks(size)
    texts = feature_texts(spark, str(tmp_path))
    assert size > 1000 or texts.rdd.getNumPartitions() > 50
    found = [json.loads(r["text"]) for r in texts.collect()]
    got = [f["properties"] if f["type"] == "Feature" else {"rel": "self"} if f["type"] == "x" else {"other": 1} for f in found]
    key = lambda p: json.dumps(p, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_collection_rows_equal_the_line_reader(spark, tmp_path, small_blocks):
    text, features = collection(4, 40)
    (tmp_path / "c.geojson").write_text(text)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in features))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    small_blocks(300)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(read_geojson(spark, str(tmp_path / "c.geojson"), schema)) == rows(read_geojson_lines(spark, str(tmp_path / "lines.json"), schema))
    assert read_geojson(spark, str(tmp_path / "c.geojson"), schema).schema["geom"].metadata == {"srid": 4326}


def test_collection_that_is_cut_off_raises(spark, tmp_path):
    text, _ = collection(4, 5)
    for k, end in enumerate((len(text) // 2, len(text) - 2)):
        (tmp_path / f"c{k}.geojson").write_text(text[:end])
        with pytest.raises(ValidationError, match="middle of a value"):
            feature_texts(spark, str(tmp_path / f"c{k}.geojson"))


# --- GeoParquet -------------------------------------------------------------------------------


def squares(spark, n, parts=3):
    x, y = (F.col("id") * 37) % 100, (F.col("id") * 53) % 97
    at = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0))
    geom = F.when(F.col("id") == 3, F.lit(None)).when(F.col("id") % 10 == 0, F.array(F.array(ring), F.array(ring))).otherwise(F.array(F.array(ring)))
    df = spark.range(0, n, 1, parts).select("id", geom.cast(GEOM).alias("geom"), F.lit("given").alias("bbox"))
    return keep_srid(df, 32631)


def target(spark):
    return f"{shared_folder(spark)}/geo-{uuid.uuid4().hex}"


def files_of(path):
    return sorted(Path(path.removeprefix("file:")).glob("part-*.parquet"))


def test_footers_and_merged_bounds(spark):
    path = target(spark)
    gp.write_geoparquet(squares(spark, 500), path, group_rows=50)
    boxes = []
    for f in files_of(path):
        info = json.loads(pq.read_metadata(f).metadata[b"geo"])
        column = info["columns"][info["primary_column"]]
        assert (info["version"], column["encoding"], column["crs"]["id"]) == ("1.1.0", "WKB", {"authority": "EPSG", "code": 32631})
        assert set(column["geometry_types"]) <= {"Polygon", "MultiPolygon"} and column["covering"]["bbox"]["xmax"] == ["bbox", "xmax"]
        table = pq.read_table(f)
        sides = [r for r in table.column("bbox").to_pylist() if r["xmin"] is not None]
        assert column["bbox"] == [min(s["xmin"] for s in sides), min(s["ymin"] for s in sides), max(s["xmax"] for s in sides), max(s["ymax"] for s in sides)]
        boxes.append(column["bbox"])
    whole = json.loads(pq.read_metadata(f"{path.removeprefix('file:')}/_common_metadata").metadata[b"geo"])["columns"]["geometry"]
    assert whole["bbox"] == gp.merged(boxes) and whole["geometry_types"] == ["MultiPolygon", "Polygon"]
    back = gp.read_written(spark, path)
    assert gp.srid_of_files(path) == 32631 == back.schema["geom"].metadata["srid"]
    rows = lambda df: sorted((r["id"], str(r["geom"])) for r in df.select("id", "geom").collect())
    assert rows(back) == rows(squares(spark, 500))
    assert {p.name for p in Path(path.removeprefix("file:")).iterdir() if p.name.startswith("_")} == {"_SUCCESS", "_common_metadata"}


def test_windows_skip_row_groups(spark):
    path = target(spark)
    gp.write_geoparquet(squares(spark, 4000, 2), path, group_rows=100)
    near = gp.window(spark, path, 10, 10, 14, 14)
    want = {r["id"] for r in squares(spark, 4000).collect() if r["id"] != 3 and 9 <= r["id"] * 37 % 100 <= 14 and 9 <= r["id"] * 53 % 97 <= 14}
    assert {r["id"] for r in near.collect()} == want and want
    assert "bbox.xmin" in near._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1]
    groups = [g for f in files_of(path) for m in [pq.read_metadata(f)] for g in range(m.num_row_groups) for c in [m.row_group(g)] if m]
    meet = 0
    for f in files_of(path):
        m = pq.read_metadata(f)
        for g in range(m.num_row_groups):
            ends = {m.row_group(g).column(k).path_in_schema: m.row_group(g).column(k).statistics for k in range(m.num_columns)}
            meet += ends["bbox.xmin"].min <= 14 and ends["bbox.xmax"].max >= 10 and ends["bbox.ymin"].min <= 14 and ends["bbox.ymax"].max >= 10
    assert len(groups) >= 40 and meet <= len(groups) / 5


def test_modes_and_failures(spark):
    path = target(spark)
    gp.write_geoparquet(squares(spark, 20), path, clustered=False)
    with pytest.raises(ValidationError, match="already"):
        gp.write_geoparquet(squares(spark, 20), path)
    gp.write_geoparquet(squares(spark, 5), path, mode="append")
    assert gp.read_written(spark, path).count() == 25
    broken = squares(spark, 400).withColumn("id", F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint"))
    with pytest.raises(Exception, match="broken"):
        gp.write_geoparquet(broken, path, mode="overwrite", clustered=False)
    assert gp.read_written(spark, path).count() == 25  # nothing of it is to be seen
    gp.write_geoparquet(squares(spark, 7), path, mode="overwrite")
    assert gp.read_written(spark, path).count() == 7
    none = target(spark)
    gp.write_geoparquet(squares(spark, 7).limit(0), none)
    assert files_of(none) == []
    plain = target(spark)
    gp.write_geoparquet(squares(spark, 7).withMetadata("geom", {"srid": 4326}), plain)
    assert "crs" not in json.loads(pq.read_metadata(files_of(plain)[0]).metadata[b"geo"])["columns"]["geometry"]
    assert read_geoparquet(spark, plain).schema["geom"].metadata == {"srid": 4326} and gp.srid_of_files(plain) == 4326
    with pytest.raises(TypeError):
        load_or_build(spark, plain, PreprocessConfig(), lambda: squares(spark, 2))
