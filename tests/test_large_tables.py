"""What decides whether large tables fit: work and memory that must not grow faster than the tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from catalog.all import ORACLES
from catalog.compare import compare
from quoin import FieldSpec, PreprocessConfig
from quoin.operators import stations as S
from quoin.operators.checks import ValidationError
from quoin.operators.neighbors import within_distance
from quoin.operators.results import long_to_wide
from quoin.plans.preprocess import preprocess
from quoin.plans.submission import submission


def _towns(spark):
    """Many stations in one town, several at one place, and buildings in it and far from it."""
    rng = random.Random(5)
    sites = [(f"s{k:04}", float(rng.randrange(100, 3900)), float(rng.randrange(100, 3900)), f"{k}.zip") for k in range(1500)]
    sites += [(f"r{k:04}", x, y, path) for k, (_, x, y, path) in enumerate(sites[:300])]
    places = [(rng.uniform(0, 4000), rng.uniform(0, 4000)) for _ in range(200)] + [(rng.uniform(-1000, 3000), rng.uniform(90_000, 94_000)) for _ in range(200)]
    points = [(f"b{k}", x, y) for k, (x, y) in enumerate([*places, *((float(round(x)), float(round(y))) for x, y in places)])]
    return points, sites, spark.createDataFrame(points, "building_id string, x double, y double"), spark.createDataFrame(sites, "station_id string, x double, y double, path string")


def test_station_search_compares_few_stations_and_finds_what_all_comparisons_find(spark, monkeypatch):
    points, sites, at, of = _towns(spark)
    steps = []
    real = S._undominated
    monkeypatch.setattr(S, "_undominated", lambda pairs, size: steps.append(real(pairs, size)) or steps[-1])
    found = {r["building_id"]: (r["distance"], r["station_id"], r["path"]) for r in S.nearest_station(at, of).collect()}
    best = {b: min((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), s, p) for s, u, v, p in sites) for b, x, y in points}
    assert found == best
    per_cell = steps[-1].groupBy("bi", "bj").count().agg(F.max("count")).first()[0]
    assert per_cell < 60  # of 1500 places, all of which lie in reach of every cell


def test_weather_of_buildings_with_places_is_searched_without_a_join_by_id(spark):
    """The search reads its points once per level, so a join by id under it would be done again for each."""
    points, sites, at, of = _towns(spark)
    buildings = at.withColumn("weather_file", F.when(F.substring("building_id", -1, 1) == "3", F.concat("building_id", F.lit(".epw"))))
    given = S.assign_weather(buildings, buildings, of, threshold=50_000.0)
    looked_up = S.assign_weather(buildings, at, of, threshold=50_000.0)
    best = {b: min((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), s, p) for s, u, v, p in sites) for b, x, y in points}
    expected = {b: f"{b}.epw" if b.endswith("3") else S.WEATHER_BASE_URL + p if d < 50_000 else None for b, (d, _, p) in best.items()}
    assert None in expected.values()
    for df in (given, looked_up):
        assert {r["building_id"]: r["weather_file"] for r in df.collect()} == expected
    assert {r["building_id"]: r["weather_file"] for r in S.assign_weather(at, buildings, of, threshold=50_000.0).collect()} == {
        b: S.WEATHER_BASE_URL + p if d < 50_000 else None for b, (d, _, p) in best.items()
    }
    assert "LeftSemi" not in given._jdf.queryExecution().optimizedPlan().toString()


def test_weather_of_preprocessed_buildings_is_searched_without_a_join_by_id(spark):
    middles = [(500_000, 200_000), (500_000, 210_000)]
    sites = [("a", 500_100.0, 200_000.0, "tmyx", "a.zip"), ("b", 500_100.0, 210_000.0, "tmyx", "b.zip")]
    rows = [(str(k), "Office", 6.0, 0.2, _square(x - 6, y - 6), "Polygon", "own.epw" if k else None) for k, (x, y) in enumerate(middles)]
    stock = spark.createDataFrame(rows, f"{STOCK}, weather_file string")
    buildings, _ = preprocess(stock, spark.createDataFrame(sites, SITES), PreprocessConfig(), 3857, (FieldSpec("use", ("Office",)),), height_col="height", weather_required=False)
    weather = buildings.select("building_id", "weather_file")
    assert sorted(tuple(r) for r in weather.collect()) == [("0", S.WEATHER_BASE_URL + "a.zip"), ("1", "own.epw")]
    assert "LeftSemi" not in weather._jdf.queryExecution().optimizedPlan().toString()


def _square(x, y, side=12.0):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return [[[{"x": float(a), "y": float(b)} for a, b in ring]]]


STOCK = "building_id string, use string, height double, wwr double, geom array<array<array<struct<x:double,y:double>>>>, geom_type string"
SITES = "station_id string, x double, y double, source string, path string"


def _preprocess(spark, middles, sites, **more):
    rows = [(str(k), "Office", 6.0, 0.2, _square(x - 6, y - 6), "Polygon") for k, (x, y) in enumerate(middles)]
    return preprocess(spark.createDataFrame(rows, STOCK), spark.createDataFrame(sites, SITES), PreprocessConfig(), 3857, (FieldSpec("use", ("Office",)),), height_col="height", **more)


def test_stations_at_equal_distance_of_a_footprint_go_by_id(spark):
    """The middle comes from degrees, so it is off by its last digits; that must not choose the station."""
    middles = [(500_000 + 1000 * k, 200_000 + 7000 * k) for k in range(40)]
    sites = [(f"{name}{k:02}", x + dx, y + dy, "tmyx", f"{name}{k:02}.zip") for k, (x, y) in enumerate(middles) for name, dx, dy in (("a", 30.0, 40.0), ("b", -50.0, 0.0), ("c", 0.0, -50.0), ("d", -30.0, 40.0))]
    buildings, _ = _preprocess(spark, middles, sites)
    found = {r["building_id"]: r["weather_file"].rsplit("/", 1)[1] for r in buildings.select("building_id", "weather_file").collect()}
    assert found == {str(k): f"a{k:02}.zip" for k in range(40)}


def test_buildings_out_of_reach_are_reported_and_batched_where_weather_is_not_required(spark):
    middles = [(500_000, 200_000), (500_000, 900_000)]
    sites = [("a", 500_100.0, 200_000.0, "tmyx", "a.zip")]
    with pytest.raises(ValidationError, match="in reach"):
        _preprocess(spark, middles, sites)
    buildings, report = _preprocess(spark, middles, sites, weather_required=False)
    assert [r.asDict() for r in report.collect()] == [{"reason": "kept", "n_rows": 2}]
    batches = submission(buildings, "lib.db", "fields.yml", "map.yml", per_batch=1)
    assert sorted((r["building_id"], r["weather_file"] is None) for r in batches.select("building_id", "weather_file").collect()) == [("0", False), ("1", True)]


def test_buildings_out_of_reach_are_left_out_and_counted_where_only_those_in_reach_are_wanted(spark):
    sites = [("a", 500_000.0, 200_000.0, "tmyx", "a.zip")]
    middles = [(500_000, 699_980), (500_000, 700_020), (500_000, 900_000)]
    rows = [(str(k), "Office", 6.0, 0.2, _square(x - 6, y - 6), "Polygon", "own.epw" if k == 2 else None) for k, (x, y) in enumerate(middles)]
    rows += [("own", "Office", 6.0, 0.2, _square(500_000, 200_000), "Polygon", "own.epw"), ("bad", "Office", 6.0, 2.0, _square(500_000, 900_000), "Polygon", None)]
    stock = spark.createDataFrame(rows, f"{STOCK}, weather_file string")
    made = [
        preprocess(stock, spark.createDataFrame(sites, SITES), PreprocessConfig(), 3857, (FieldSpec("use", ("Office",)),), height_col="height", weather_file=file, only_in_reach=True)
        for file in (None, "city.epw")
    ]
    for (buildings, report), file in zip(made, (S.WEATHER_BASE_URL + "a.zip", "city.epw")):
        found = {r["building_id"]: (r["weather_file"], [n["building_id"] for n in r["neighbors"]]) for r in buildings.collect()}
        assert found == {"0": (file, ["1"]), "own": ("own.epw", [])}  # out of reach, 1 still is a neighbour of 0
        assert {r["reason"]: r["n_rows"] for r in report.collect()} == {"kept": 2, "no_station": 2, "wwr": 1}


@pytest.mark.parametrize("name", ["preprocessed_buildings", "preprocessed_buildings_utm", "refreshed_buildings"])
def test_query_over_a_stock_that_leaves_the_reach_of_the_stations(spark, tmp_path, name):
    import duckdb

    tables, con = tmp_path / "tables", duckdb.connect()
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    far = customers.withColumn("c_custkey", F.col("c_custkey") + 502_350)  # the reach ends among them
    customers.unionByName(far).write.parquet(f"{tables}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").write.parquet(f"{tables}/supplier.parquet")
    for table in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    assert compare(spark, con, str(tables), name) == ""
    kept = con.execute(ORACLES["weather_assignment"]).fetchall()
    found = {int(b) for (b, *_) in con.execute(f"SELECT building_id FROM ({ORACLES[name]})").fetchall()}
    assert any(b >= 502_350 for b in found) and len(found) < len(kept)


def test_distance_join_sorts_no_copied_points(spark):
    """Points are copied to nine cells; only the other side, once each, is held by a task."""
    points = spark.range(50).select(F.col("id").cast("string").alias("building_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    pairs = within_distance(points, 2.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((int(r["src"]), int(r["dst"])) for r in pairs.collect()) == [(a, b) for a in range(50) for b in range(50) if a != b and abs(a - b) <= 2]


def test_wide_rows_are_laid_out_without_a_pivot(spark):
    """A pivot holds a wide row of nearly every key in each task."""
    rows = spark.createDataFrame([("1", "E", "U", "Gas", 1, 2.0), ("1", "E", "U", "Gas", 2, None), ("2", "X", "U", "Gas", 1, 5.0)], "building_id string, measurement string, aggregation string, meter string, month int, value double")
    wide = long_to_wide(rows, ["E|U|Gas|1", "E|U|Gas|2"])
    assert "pivotfirst" not in wide._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(tuple(r) for r in wide.collect()) == [("1", 2.0, None), ("2", None, None)]
