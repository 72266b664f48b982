"""Checks, imputation and dropping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6
from catalog.views import CONFIG, oracle
from quoin.operators import checks, clean, specs
from quoin.operators.ordering import sample_rows
from quoin.operators.stations import valid_stations
from quoin.schema import FieldSpec

_STATUS = V._STATUS_LIST

# --- checks ---------------------------------------------------------------------------------

_CHECKED = (
    FieldSpec("region", ("R0", "R1", "R2", "R3", "R4")),
    FieldSpec("typology", ("Office", "School", "Residential", "Hospital")),
    FieldSpec("basement", ("none", "unoccupied_unconditioned", "unoccupied_conditioned", "occupied_unconditioned", "occupied_conditioned")),
    FieldSpec("wwr", minimum=0.0, maximum=1.0),
    FieldSpec("height", minimum=2.0, maximum=20.0),
)


@query(oracle(f"""
SELECT field, kind, bad_value, count(*) AS n_rows FROM (
  SELECT 'typology' AS field, 'categorical' AS kind, typology AS bad_value FROM buildings WHERE typology NOT IN ('Office','School','Residential','Hospital')
  UNION ALL SELECT 'region', 'categorical', region FROM buildings WHERE region NOT IN ('R0','R1','R2','R3','R4')
  UNION ALL SELECT 'basement', 'categorical', basement FROM buildings WHERE basement IS NULL OR basement NOT IN ({_STATUS})
) GROUP BY 1, 2, 3""", "buildings"))
def categorical_field_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.field_violations(V.buildings(spark, sf), _CHECKED)
    return found.where("kind = 'categorical'")


@query(oracle("""
SELECT field, kind, round(bad, 6) AS bad_value, count(*) AS n_rows FROM (
  SELECT 'wwr' AS field, 'numeric' AS kind, wwr AS bad FROM buildings WHERE wwr IS NULL OR wwr < 0 OR wwr > 1
  UNION ALL SELECT 'height', 'numeric', height FROM buildings WHERE height IS NULL OR height < 2 OR height > 20
) GROUP BY 1, 2, 3""", "buildings"))
def numeric_field_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.field_violations(V.buildings(spark, sf), _CHECKED).where("kind = 'numeric'")
    return found.select("field", "kind", r6(F.col("bad_value").cast("double"), "bad_value"), "n_rows")


@query("""
SELECT count(*) AS n_rows, count(*) - count(o_custkey) AS n_missing, count(DISTINCT o_custkey) AS n_distinct,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_repeated FROM orders""")
def id_report(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("building_id"))
    return checks.id_report(orders)


@query("SELECT CAST(o_custkey AS VARCHAR) AS building_id, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("building_id"))
    return checks.duplicate_ids(orders)


@query("SELECT CAST(c_custkey AS VARCHAR) AS building_id, c_mktsegment AS market_segment, c_acctbal AS account_balance FROM customer")
def restored_column_names(spark: SparkSession, sf: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    cut = customer.select(
        F.col("c_custkey").cast("string").alias("building_id"),
        F.col("c_mktsegment").alias("market_seg"),
        F.col("c_acctbal").alias("account_ba"),
    )
    wanted = ("building_id", "market_segment", "account_balance", None)
    return checks.require_columns(checks.restore_truncated_names(cut, wanted), wanted)


@query(oracle("""
SELECT building_id, reason FROM (
  SELECT building_id, unnest([CASE WHEN basement_exposed_frac <= 0 OR basement_exposed_frac >= 1 THEN 'exposed_fraction' END]) AS reason FROM cleaned
) WHERE reason IS NOT NULL""", "cleaned"))
def spec_bound_violations(spark: SparkSession, sf: str) -> DataFrame:
    bad = checks.spec_violations(V.cleaned(spark, sf))
    return bad.select("building_id", F.explode("reasons").alias("reason"))


@query(oracle("""
SELECT c.building_id, round(m.a, 6) AS modelled_area, round(c.w * c.d, 6) AS expected_area
FROM cleaned c LEFT JOIN (SELECT building_id, w * d * (CASE typology WHEN 'Hotel' THEN 1.001 WHEN 'School' THEN 1.000001 ELSE 1.0 END) AS a FROM buildings WHERE region <> 'R3') m
ON c.building_id = m.building_id WHERE m.a IS NULL OR NOT abs(m.a - c.w * c.d) <= 1e-8 + 1e-5 * abs(c.w * c.d)""", "cleaned"))
def area_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    drift = F.when(F.col("typology") == "Hotel", 1.001).when(F.col("typology") == "School", 1.000001).otherwise(1.0)
    modelled = V.buildings(spark, sf).where("region <> 'R3'").select("building_id", (F.col("w") * F.col("d") * drift).alias("modelled_area"))
    expected = V.cleaned(spark, sf).select("building_id", (F.col("w") * F.col("d")).alias("expected_area"))
    return checks.area_mismatches(modelled, expected).select("building_id", r6("modelled_area"), r6("expected_area"))


# --- dropping -------------------------------------------------------------------------------

_REASON = f"""CASE WHEN NOT coalesce(height BETWEEN 3 AND 300 AND num_storeys BETWEEN 1 AND 125, false) THEN 'height_or_floors'
  WHEN NOT coalesce(wwr, 0.2) BETWEEN 0 AND 1 THEN 'wwr'
  WHEN coalesce(basement, 'none') NOT IN ({_STATUS}) THEN 'basement'
  WHEN NOT coalesce(basement_exposed_frac, 0.25) BETWEEN 0 AND 1 THEN 'basement_exposed_frac'
  WHEN coalesce(attic, 'none') NOT IN ({_STATUS}) THEN 'attic'
  WHEN w * d < 10 THEN 'area' WHEN least(w, d) < 3 OR greatest(w, d) > 1000 THEN 'edge_length' END"""


def _given(spark: SparkSession, sf: str) -> DataFrame:
    """Heights and floors both given, nothing imputed."""
    return V.assessed(spark, sf, "height", "num_storeys")


@query(oracle(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n_rows FROM buildings GROUP BY 1", "buildings"))
def drop_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_report(_given(spark, sf))


@query(oracle(f"""SELECT count(*) AS n_initial, count(r) AS n_dropped, count(*) - count(r) AS n_kept,
  round(count(r) / count(*), 6) AS dropped_share FROM (SELECT {_REASON} AS r FROM buildings)""", "buildings"))
def drop_totals(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_totals(_given(spark, sf)).withColumn("dropped_share", r6("dropped_share"))


@query(oracle(f"""
SELECT reason, n_dropped, n_remaining, round(n_dropped / n_remaining, 6) AS dropped_per_remaining FROM (
  SELECT reason, n_dropped, total - CAST(sum(n_dropped) OVER (ORDER BY pos) AS BIGINT) AS n_remaining FROM (
    SELECT pos, name AS reason, count(r) AS n_dropped, (SELECT count(*) FROM buildings) AS total
    FROM (VALUES (0, 'height_or_floors'), (1, 'wwr'), (2, 'basement'), (3, 'basement_exposed_frac'), (4, 'attic'), (5, 'area'), (6, 'edge_length')) AS rules(pos, name)
    LEFT JOIN (SELECT {_REASON} AS r FROM buildings) ON r = name GROUP BY 1, 2))""", "buildings"))
def drop_shares(spark: SparkSession, sf: str) -> DataFrame:
    names = [n for n, _ in [*clean.attribute_rules(CONFIG), *clean.shape_rules(CONFIG)]]
    shares = clean.drop_shares(_given(spark, sf), names)
    return shares.withColumn("dropped_per_remaining", r6("dropped_per_remaining"))


@query(oracle("SELECT building_id, round(w * d, 6) AS footprint_area FROM buildings WHERE w * d >= 200", "buildings"))
def minimum_area(spark: SparkSession, sf: str) -> DataFrame:
    config = V.PreprocessConfig(min_building_area=200.0)
    rule = clean.shape_rules(config)[0]
    return clean.keep_where(V.with_rectangles(V.buildings(spark, sf)), rule).select("building_id", r6("footprint_area"))


@query(oracle("SELECT building_id, least(w, d) AS short_edge, greatest(w, d) AS long_edge FROM buildings WHERE least(w, d) >= 10 AND greatest(w, d) <= 25", "buildings"))
def edge_bounds(spark: SparkSession, sf: str) -> DataFrame:
    config = V.PreprocessConfig(min_edge_length=10.0, max_edge_length=25.0)
    rule = clean.shape_rules(config)[1]
    return clean.keep_where(V.with_rectangles(V.buildings(spark, sf)), rule).select("building_id", "short_edge", "long_edge")


@query(oracle("SELECT building_id, CASE typology WHEN 'Office' THEN 'Polygon' ELSE 'MultiPolygon' END AS geom_type FROM buildings WHERE typology IN ('Office', 'School')", "buildings"))
def polygons_only(spark: SparkSession, sf: str) -> DataFrame:
    use = F.col("typology")
    kind = F.when(use == "Office", "Polygon").when(use == "School", "MultiPolygon").when(use == "Hotel", "Point")
    typed = V.buildings(spark, sf).select("building_id", kind.alias("geom_type"))
    return clean.keep_where(typed, clean.polygon_rule())


@query(oracle("SELECT building_id, height AS height_m, num_storeys AS n_floors, CAST(3.0 AS DOUBLE) AS floor_height_m FROM buildings WHERE height BETWEEN 3 AND 300 AND num_storeys BETWEEN 1 AND 125", "buildings"))
def height_and_floors_given(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.impute_height_and_floors(V.buildings(spark, sf), CONFIG, "height", "num_storeys")
    kept = clean.keep_where(df, clean.attribute_rules(CONFIG)[0])
    return kept.select("building_id", "height_m", "n_floors", "floor_height_m")


@query(oracle("""SELECT building_id, round_even(coalesce(num_storeys, 2.0), 0) AS n_floors, round_even(coalesce(num_storeys, 2.0), 0) * 3.0 AS height_m
FROM buildings WHERE round_even(coalesce(num_storeys, 2.0), 0) BETWEEN 1 AND 125""", "buildings"))
def height_from_floors(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.impute_height_and_floors(V.buildings(spark, sf), CONFIG, floors_col="num_storeys")
    return clean.keep_where(df, clean.attribute_rules(CONFIG)[0]).select("building_id", "n_floors", "height_m")


@query(oracle("SELECT building_id, n_floors, height_m FROM imputed WHERE height_m BETWEEN 3 AND 300 AND n_floors BETWEEN 1 AND 125", "imputed"))
def floors_from_height(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.impute_height_and_floors(V.buildings(spark, sf), CONFIG, height_col="height")
    return clean.keep_where(df, clean.attribute_rules(CONFIG)[0]).select("building_id", "n_floors", "height_m")


def _filled(spark: SparkSession, sf: str, rule: int, column: str) -> DataFrame:
    df = clean.fill_envelope(V.buildings(spark, sf), CONFIG)
    return clean.keep_where(df, clean.attribute_rules(CONFIG)[rule]).select("building_id", column)


@query(oracle("SELECT building_id, coalesce(wwr, CAST(0.2 AS DOUBLE)) AS wwr FROM buildings WHERE coalesce(wwr, 0.2) BETWEEN 0 AND 1", "buildings"))
def filled_wwr(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, 1, "wwr")


@query(oracle(f"SELECT building_id, coalesce(basement, 'none') AS basement FROM buildings WHERE coalesce(basement, 'none') IN ({_STATUS})", "buildings"))
def filled_basement(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, 2, "basement")


@query(oracle("SELECT building_id, coalesce(basement_exposed_frac, CAST(0.25 AS DOUBLE)) AS basement_exposed_frac FROM buildings WHERE coalesce(basement_exposed_frac, 0.25) BETWEEN 0 AND 1", "buildings"))
def filled_exposed_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, 3, "basement_exposed_frac")


@query(oracle(f"SELECT building_id, coalesce(attic, 'none') AS attic FROM buildings WHERE coalesce(attic, 'none') IN ({_STATUS})", "buildings"))
def filled_attic(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, 4, "attic")


@query(oracle("SELECT building_id, CAST(0.2 AS DOUBLE) AS wwr, 'none' AS basement, 'none' AS attic FROM buildings", "buildings"))
def envelope_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """No source columns at all: constants."""
    bare = V.buildings(spark, sf).select("building_id")
    return clean.fill_envelope(bare, CONFIG, None, None, None, None).select("building_id", "wwr", "basement", "attic")


@query(oracle("SELECT building_id, typology FROM (SELECT *, md5(building_id || '|sample') AS h FROM cleaned) ORDER BY h, building_id LIMIT 100", "cleaned"))
def sampled_buildings(spark: SparkSession, sf: str) -> DataFrame:
    return sample_rows(V.cleaned(spark, sf), 100).select("building_id", "typology")


@query(oracle("SELECT station_id, x, y, path FROM stations WHERE source IN ('tmyx') AND x <= 502000", "stations"))
def valid_stations_only(spark: SparkSession, sf: str) -> DataFrame:
    """Source filter, then invalid points out: eastern stations are given a broken coordinate."""
    x = F.when(F.col("x") > 502500, float("nan")).when(F.col("x") > 502000, float("inf")).otherwise(F.col("x"))
    broken = V.stations(spark, sf).withColumn("x", x)
    return valid_stations(broken, CONFIG.station_filter).select("station_id", "x", "y", "path")


@query(oracle("SELECT building_id, 'Baseline' AS scenario, 'lib.db' AS db_file, 'fields.yml' AS semantic_fields_file, 'map.yml' AS component_map_file FROM buildings", "buildings"))
def provenance_and_scenario(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.tag_scenario(V.buildings(spark, sf).select("building_id"), "Baseline")
    return clean.add_provenance(df, "lib.db", "fields.yml", "map.yml")


@query(oracle("""SELECT building_id, '{"region":"' || region || '","typology":"' || typology || '","age_bracket":"' || age_bracket || '","income":"' || income || '"}' AS context FROM buildings""", "buildings"))
def semantic_context(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.pack_context(V.buildings(spark, sf), V.FIELD_NAMES)
    return df.select("building_id", F.to_json("context").alias("context"))


# --- derived spec columns -------------------------------------------------------------------

_FLAGS = """basement <> 'none' AS has_basement, basement IN ('occupied_unconditioned','occupied_conditioned') AS basement_is_occupied,
  basement IN ('occupied_conditioned','unoccupied_conditioned') AS basement_is_conditioned,
  attic <> 'none' AS has_attic, attic IN ('occupied_unconditioned','occupied_conditioned') AS attic_is_occupied,
  attic IN ('occupied_conditioned','unoccupied_conditioned') AS attic_is_conditioned"""


@query(oracle(f"SELECT building_id, {_FLAGS} FROM cleaned", "cleaned"))
def status_flags(spark: SparkSession, sf: str) -> DataFrame:
    names = ["has_basement", "basement_is_occupied", "basement_is_conditioned", "has_attic", "attic_is_occupied", "attic_is_conditioned"]
    return specs.add_status_flags(V.cleaned(spark, sf)).select("building_id", *names)


_FLOORS = """CAST(n_floors AS INT) + CAST(basement_is_conditioned AS INT) + CAST(attic_is_conditioned AS INT) AS n_conditioned_floors,
  CAST(n_floors AS INT) + CAST(basement_is_occupied AS INT) + CAST(attic_is_occupied AS INT) AS n_occupied_floors"""


@query(oracle(f"SELECT building_id, {_FLOORS} FROM (SELECT *, {_FLAGS} FROM cleaned)", "cleaned"))
def floor_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = specs.add_floor_counts(specs.add_status_flags(V.cleaned(spark, sf)))
    return df.select("building_id", "n_conditioned_floors", "n_occupied_floors")


@query(oracle(f"""SELECT building_id, w * d AS model_footprint_area, n_conditioned_floors * w * d AS conditioned_area, n_occupied_floors * w * d AS occupied_area
FROM (SELECT *, {_FLOORS} FROM (SELECT *, {_FLAGS} FROM cleaned))""", "cleaned"))
def model_areas(spark: SparkSession, sf: str) -> DataFrame:
    df = specs.add_areas(specs.add_floor_counts(specs.add_status_flags(V.cleaned(spark, sf))))
    return df.select("building_id", "model_footprint_area", "conditioned_area", "occupied_area")


@query(oracle("SELECT building_id, CASE WHEN w > 15 AND d > 15 THEN 'core/perim' ELSE 'by_storey' END AS zoning FROM cleaned", "cleaned"))
def zoning_rule(spark: SparkSession, sf: str) -> DataFrame:
    return specs.add_zoning(V.cleaned(spark, sf)).select("building_id", "zoning")


def _draw(salt: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(building_id || '|{salt}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@query(oracle(f"""SELECT building_id, round(CASE WHEN basement_is_occupied THEN 0.2 + 0.4 * {_draw('basement_use/0')} ELSE 0 END, 6) AS basement_use_fraction,
  round(CASE WHEN attic_is_occupied THEN 0.2 + 0.4 * {_draw('attic_use/0')} ELSE 0 END, 6) AS attic_use_fraction
FROM (SELECT *, {_FLAGS} FROM cleaned)""", "cleaned"))
def use_fractions(spark: SparkSession, sf: str) -> DataFrame:
    df = specs.add_use_fractions(specs.add_status_flags(V.cleaned(spark, sf)))
    return df.select("building_id", r6("basement_use_fraction"), r6("attic_use_fraction"))


_ATTIC = f"""SELECT *, CASE WHEN attic_is_occupied OR attic_is_conditioned THEN 0.5 ELSE 4.0 / 12 END AS lo,
  least(CASE WHEN attic_is_occupied OR attic_is_conditioned THEN 0.75 ELSE 0.5 END, 7.5 / (short_edge / 2)) AS hi,
  {_draw('attic_height/0')} AS u FROM (SELECT *, {_FLAGS} FROM cleaned)"""


@query(oracle(f"""SELECT building_id, (NOT has_attic OR lo <= 7.5 / (short_edge / 2)) AS attic_fits,
  CASE WHEN has_attic AND lo <= 7.5 / (short_edge / 2) THEN round(short_edge / 2 * (lo + (hi - lo) * u), 6) END AS attic_height FROM ({_ATTIC})""", "cleaned"))
def attic_heights(spark: SparkSession, sf: str) -> DataFrame:
    df = specs.add_attic_height(specs.add_status_flags(V.cleaned(spark, sf)))
    return df.select("building_id", "attic_fits", r6("attic_height"))


@query("""
SELECT building_id, greatest(length, width) AS long_edge, least(length, width) AS short_edge, round(greatest(length, width) / least(length, width), 6) AS aspect_ratio,
  CAST(n_floors * 3.5 AS DOUBLE) AS height_m,
  'POLYGON ((0 0, ' || CAST(greatest(length, width) AS INT) || ' 0, ' || CAST(greatest(length, width) AS INT) || ' ' || CAST(least(length, width) AS INT) || ', 0 ' || CAST(least(length, width) AS INT) || ', 0 0))' AS rotated_rectangle
FROM (SELECT CAST(p_partkey AS VARCHAR) AS building_id, CAST(3 + p_size AS DOUBLE) AS length, CAST(3 + p_partkey % 37 AS DOUBLE) AS width, 1 + p_size % 9 AS n_floors FROM part)""")
def parametric_specs(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "CAST(p_partkey AS STRING) AS building_id", "CAST(3 + p_size AS DOUBLE) AS length",
        "CAST(3 + p_partkey % 37 AS DOUBLE) AS width", "1 + p_size % 9 AS n_floors", "CAST(3.5 AS DOUBLE) AS floor_height_m",
    )
    out = specs.parametric_specs(rows)
    return out.select("building_id", "long_edge", "short_edge", r6("aspect_ratio"), "height_m", "rotated_rectangle")
