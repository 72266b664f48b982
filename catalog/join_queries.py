"""Neighbours, stations, locations, scenarios, components and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6
from catalog.views import CONFIG, oracle
from quoin.functions.geometry import boxes_intersect, with_oriented_box
from quoin.operators import components, neighbors, results, specs, stations
from quoin.session import durable

# --- neighbours -----------------------------------------------------------------------------


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return V.stored(spark, sf).withColumns({"x": F.col("cx"), "y": F.col("cy")})


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Kept buildings as stored points, with no more columns than the station search needs."""
    return durable(V.cleaned(spark, sf).select("building_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "weather_file"))


@query(oracle("SELECT src, dst, round(distance, 6) AS distance FROM near", "near"))
def neighbors_within_100m(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbors.within_distance(_points(spark, sf).select("building_id", "x", "y"), CONFIG.neighbor_threshold)
    return pairs.select("src", "dst", r6("distance"))


@query(oracle("""SELECT CAST(a.o_orderkey AS VARCHAR) AS src, CAST(b.o_orderkey AS VARCHAR) AS dst, CAST(0 AS DOUBLE) AS distance
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey <> b.o_orderkey""", "buildings"))
def coincident_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Radius 0: points at exactly the same place (customer and date as coordinates)."""
    points = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("building_id"), F.col("o_custkey").cast("double").alias("x"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("y"),
    )
    return neighbors.within_distance(points, 0.0)


@query(oracle("SELECT n.src, n.dst, x.gap <= 1e-9 AS touching FROM near n JOIN axes x ON n.src = x.src AND n.dst = x.dst", "near", "axes"))
def touching_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    boxed = with_oriented_box(_points(spark, sf))
    pairs = neighbors.within_distance(boxed, CONFIG.neighbor_threshold, F.struct("box"), F.struct("box"))
    return pairs.select("src", "dst", boxes_intersect(F.col("own.box"), F.col("neighbor.box")).alias("touching"))


def _edges_of(df: DataFrame) -> DataFrame:
    return neighbors.neighbor_edges(df, CONFIG.neighbor_threshold, CONFIG.default_height, CONFIG.f2f_height)


@query(oracle("SELECT src, dst, round(distance, 6) AS distance FROM apart", "apart"))
def separate_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return _edges_of(V.stored(spark, sf)).select("src", "dst", r6("distance"))


@query(oracle("""
SELECT c.building_id, CAST(count(n.dst) AS BIGINT) AS n_neighbors, coalesce(string_agg(n.dst, ',' ORDER BY n.dst), '') AS neighbor_ids,
  coalesce(sum(n.b_height), 0.0) AS height_sum, CAST(coalesce(sum(trunc(n.b_height / 3.0)), 0) AS BIGINT) AS floor_sum
FROM cleaned c LEFT JOIN apart n ON n.src = c.building_id GROUP BY 1""", "apart"))
def neighbor_attributes(spark: SparkSession, sf: str) -> DataFrame:
    table = V.stored(spark, sf)
    lists = neighbors.gather_neighbors(_edges_of(table))
    df = neighbors.attach_neighbors(table.select("building_id"), lists)
    items = F.col("neighbors")
    return df.select(
        "building_id",
        F.size(items).cast("bigint").alias("n_neighbors"),
        F.array_join(F.transform(items, lambda n: n["building_id"]), ",").alias("neighbor_ids"),
        F.aggregate(items, F.lit(0.0), lambda s, n: s + n["height"]).alias("height_sum"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda s, n: s + n["floors"]).alias("floor_sum"),
    )


@query(oracle("""SELECT src AS building_id, dst AS neighbor_id, coalesce(num_storeys * 3.0, 6.0) AS height, CAST(trunc(coalesce(num_storeys * 3.0, 6.0) / 3.0) AS INT) AS floors
FROM apart JOIN buildings ON building_id = dst""", "apart"))
def neighbor_heights_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Missing neighbour heights become the default; floors are cut to whole floors."""
    df = V.stored(spark, sf).withColumn("height_m", F.col("num_storeys") * 3.0)
    edges = neighbors.neighbor_edges(df, CONFIG.neighbor_threshold, CONFIG.default_height, CONFIG.f2f_height)
    return edges.select(F.col("src").alias("building_id"), F.col("dst").alias("neighbor_id"), "height", "floors")


# --- stations -------------------------------------------------------------------------------


@query(oracle("SELECT building_id, station_id, round(dist, 6) AS distance, path FROM closest", "closest"))
def nearest_station(spark: SparkSession, sf: str) -> DataFrame:
    sites = stations.valid_stations(V.stations(spark, sf), CONFIG.station_filter)
    found = stations.nearest_station(_places(spark, sf), sites)
    return found.select("building_id", "station_id", r6("distance"), "path")


@query(oracle("SELECT building_id, station_id, round(dist, 6) AS distance FROM closest WHERE dist < 150", "closest"))
def nearest_station_in_reach(spark: SparkSession, sf: str) -> DataFrame:
    """A short threshold: buildings without a station strictly inside it do not appear."""
    sites = stations.valid_stations(V.stations(spark, sf), CONFIG.station_filter)
    found = stations.nearest_station(_places(spark, sf), sites, threshold=150.0, finest=40.0)
    return found.select("building_id", "station_id", r6("distance"))


@query(oracle("""SELECT c.building_id, coalesce(c.weather_file, 'https://climate.onebuilding.org/' || n.path) AS weather_file
FROM cleaned c LEFT JOIN closest n ON n.building_id = c.building_id""", "closest"))
def weather_assignment(spark: SparkSession, sf: str) -> DataFrame:
    sites = stations.valid_stations(V.stations(spark, sf), CONFIG.station_filter)
    df = _places(spark, sf)
    df = stations.assign_weather(df, df, sites)
    return df.select("building_id", "weather_file")


@query(oracle("SELECT building_id, coalesce(weather_file, 'city.zip') AS weather_file FROM cleaned", "cleaned"))
def weather_from_config(spark: SparkSession, sf: str) -> DataFrame:
    """A configured file leaves nothing to search for."""
    df = _points(spark, sf)
    df = stations.assign_weather(df, df, V.stations(spark, sf), "city.zip")
    return df.select("building_id", "weather_file")


# --- results joins --------------------------------------------------------------------------


@query(oracle("""SELECT r.building_id, r.scenario, r.measurement, r.aggregation, r.meter, r.month, r.value, b.cy AS lat, b.cx AS lon
FROM results r JOIN buildings b ON r.building_id = b.building_id WHERE b.wwr IS NOT NULL""", "results", "buildings"))
def results_with_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings with an incomplete location row have no match."""
    places = V.buildings(spark, sf).select(
        "building_id", F.when(F.col("wwr").isNotNull(), F.col("cy")).alias("lat"), F.col("cx").alias("lon")
    )
    return results.with_locations(V.results(spark, sf), places)


_TWO = """SELECT b.building_id, b.v AS bv, c.v AS cv FROM (SELECT building_id, sum(value) AS v FROM results WHERE measurement = 'Energy' AND aggregation = 'End Uses' AND scenario = 'Baseline' GROUP BY 1) b
JOIN (SELECT building_id, sum(value) AS v FROM results WHERE measurement = 'Energy' AND aggregation = 'End Uses' AND scenario = 'Retrofit' GROUP BY 1) c ON b.building_id = c.building_id"""


@query(oracle(f"SELECT building_id, bv AS baseline_value, cv AS comparison_value, round((cv - bv) / bv * 100, 6) AS percent_change FROM ({_TWO})", "results"))
def scenario_percent_change(spark: SparkSession, sf: str) -> DataFrame:
    """Two EUI tables joined by building."""
    rows = V.results(spark, sf)
    tables = [results.building_eui(rows.where(F.col("scenario") == s)) for s in ("Baseline", "Retrofit")]
    return results.compare_scenarios(*tables, "eui").withColumn("percent_change", r6("percent_change"))


@query(oracle(f"SELECT building_id, bv AS baseline_value, cv AS comparison_value, round((cv - bv) / bv * 100, 6) AS percent_change FROM ({_TWO})", "results"))
def scenario_change_single_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The same comparison in one pass over the results."""
    return results.compare_eui(V.results(spark, sf), "Baseline", "Retrofit").withColumn("percent_change", r6("percent_change"))


@query(oracle(f"""SELECT count(*) AS n_buildings, sum(bv) AS baseline_total, sum(cv) AS retrofit_total, sum(bv) - sum(cv) AS saving,
  round((sum(bv) - sum(cv)) / sum(bv) * 100, 6) AS saving_percent, round(avg((cv - bv) / bv * 100), 6) AS mean_percent_change FROM ({_TWO})""", "results"))
def retrofit_savings(spark: SparkSession, sf: str) -> DataFrame:
    saved = results.retrofit_savings(results.compare_eui(V.results(spark, sf), "Baseline", "Retrofit"))
    return saved.withColumns({c: F.round(c, 6) for c in ("saving_percent", "mean_percent_change")})


# --- components and grids -------------------------------------------------------------------


@query(oracle("""SELECT b.building_id, l.envelope FROM buildings b LEFT JOIN library l
ON b.region = l.region AND b.typology = l.typology AND b.age_bracket = l.age_bracket""", "library"))
def component_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = components.lookup_component(
        V.buildings(spark, sf), V.library(spark, sf), ("region", "typology", "age_bracket"), ("envelope",)
    )
    return df.select("building_id", "envelope")


@query(oracle("""SELECT building_id, region || '-' || typology AS dhw, typology || '/' || age_bracket AS envelope FROM buildings
WHERE NOT (typology = 'Hotel' AND age_bracket = 'Pre_1980') UNION ALL
SELECT building_id, region || '-' || typology, NULL FROM buildings WHERE typology = 'Hotel' AND age_bracket = 'Pre_1980'""", "buildings"))
def component_lookup_several(spark: SparkSession, sf: str) -> DataFrame:
    """Components with different source fields."""
    df = V.buildings(spark, sf)
    dhw = df.select("region", "typology", F.concat_ws("-", "region", "typology").alias("dhw")).distinct()
    out = components.lookup_components(
        df,
        {
            "Envelope": (V.library(spark, sf), ("region", "typology", "age_bracket"), ("envelope",)),
            "DHW": (dhw, ("region", "typology"), ("dhw",)),
        },
    )
    return out.select("building_id", "dhw", "envelope")


@query(oracle("""SELECT 'Envelope' AS component, region, typology, age_bracket, count(*) AS n_buildings FROM buildings
WHERE typology = 'Hotel' AND age_bracket = 'Pre_1980' GROUP BY 1, 2, 3, 4""", "buildings"))
def component_coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return components.missing_components(
        V.buildings(spark, sf), V.library(spark, sf), ("region", "typology", "age_bracket"), "Envelope"
    )


@query(oracle("""
SELECT r.v AS region, t.v AS typology, a.v AS age_bracket, i.v AS income, round(w.v, 6) AS wwr, coalesce(n, 0) AS n_buildings
FROM (VALUES ('R0'), ('R1'), ('R2'), ('R3'), ('R4')) r(v), (VALUES ('Office'), ('School'), ('Residential'), ('Hospital'), ('Hotel')) t(v),
  (VALUES ('Pre_1980'), ('1980_to_2000'), ('Post_2000')) a(v), (VALUES ('Low'), ('High')) i(v), (SELECT CAST(unnest(range(10)) AS DOUBLE) / 9 AS v) w
LEFT JOIN (SELECT region, typology, age_bracket, income, count(*) AS n FROM buildings GROUP BY 1, 2, 3, 4) b
ON b.region = r.v AND b.typology = t.v AND b.age_bracket = a.v AND b.income = i.v""", "buildings"))
def semantic_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of field values, with the buildings that have its categories."""
    fields = [*V.FIELDS, V.FieldSpec("wwr", minimum=0.0, maximum=1.0)]
    grid = specs.semantic_grid(spark, fields, 10)
    present = V.buildings(spark, sf).groupBy(*V.FIELD_NAMES).agg(F.count(F.lit(1)).alias("n"))
    joined = grid.join(present, list(V.FIELD_NAMES), "left")
    return joined.select(*V.FIELD_NAMES, r6("wwr"), F.coalesce("n", F.lit(0)).alias("n_buildings"))
