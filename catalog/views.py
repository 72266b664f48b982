"""Building-stock tables derived from the given tables.

The defining SQL is the same text for Spark and for the oracle, apart from type names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.config import PreprocessConfig
from quoin.functions import geometry as G
from quoin.operators import clean
from quoin.schema import FieldSpec
from quoin.session import durable

CONFIG = PreprocessConfig()

# Domains of the semantic fields.
FIELDS = (
    FieldSpec("region", tuple(f"R{i}" for i in range(5))),
    FieldSpec("typology", ("Office", "School", "Residential", "Hospital", "Hotel")),
    FieldSpec("age_bracket", ("Pre_1980", "1980_to_2000", "Post_2000")),
    FieldSpec("income", ("Low", "High")),
)
FIELD_NAMES = tuple(f.name for f in FIELDS)

BUILDINGS = """
SELECT CAST(c_custkey AS {text}) AS building_id,
  CAST(500000 + (c_custkey % 40) * 40 + (c_custkey * 7) % 11 AS DOUBLE) AS cx,
  CAST(200000 + FLOOR(c_custkey / 40) * 40 + (c_custkey * 13) % 9 AS DOUBLE) AS cy,
  CAST(6 + (c_custkey * 17) % 30 AS DOUBLE) AS w,
  CAST(5 + (c_custkey * 23) % 25 AS DOUBLE) AS d,
  CAST((c_custkey * 37) % 180 AS DOUBLE) * PI() / 180 AS theta,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(3 + (c_custkey * 29) % 40 AS DOUBLE) / 2 END AS height,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(2 + (c_custkey * 31) % 27 AS DOUBLE) / 2 END AS num_storeys,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 11) % 120 AS DOUBLE) / 100 END AS wwr,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'unoccupied_unconditioned'
    WHEN 3 THEN 'unoccupied_conditioned' WHEN 4 THEN 'occupied_unconditioned'
    WHEN 5 THEN 'occupied_conditioned' ELSE 'cellar' END AS basement,
  CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'occupied_conditioned' WHEN 2 THEN 'unoccupied_unconditioned'
    WHEN 3 THEN 'unoccupied_conditioned' ELSE NULL END AS attic,
  CAST((c_custkey * 3) % 11 AS DOUBLE) / 10 AS basement_exposed_frac,
  CONCAT('R', CAST(c_nationkey % 5 AS {text})) AS region,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Residential' WHEN 'BUILDING' THEN 'Office'
    WHEN 'AUTOMOBILE' THEN 'Hotel' WHEN 'MACHINERY' THEN 'Hospital' ELSE 'School' END AS typology,
  CASE c_custkey % 3 WHEN 0 THEN 'Pre_1980' WHEN 1 THEN '1980_to_2000' ELSE 'Post_2000' END AS age_bracket,
  CASE WHEN c_acctbal < 0 THEN 'Low' ELSE 'High' END AS income,
  CASE WHEN c_custkey % 29 = 0 THEN CONCAT('custom/', CAST(c_custkey AS {text}), '.zip') ELSE NULL END AS weather_file
FROM {customer}
"""

STATIONS = """
SELECT CAST(s_suppkey AS {text}) AS station_id,
  CAST(499000 + (s_suppkey * 313) % 4000 AS DOUBLE) AS x,
  CAST(199000 + (s_suppkey * 571) % 4000 AS DOUBLE) AS y,
  CASE s_suppkey % 3 WHEN 0 THEN 'tmyx' WHEN 1 THEN 'tmy3' ELSE 'iwec' END AS source,
  CONCAT('wmo/', CAST(s_suppkey AS {text}), '.zip') AS path
FROM {supplier}
"""

RESULTS = """
SELECT CAST(o_custkey AS {text}) AS building_id,
  CASE WHEN l_linestatus = 'O' THEN 'Baseline' ELSE 'Retrofit' END AS scenario,
  CASE l_linenumber % 3 WHEN 2 THEN 'Peak' ELSE 'Energy' END AS measurement,
  CASE l_linenumber % 3 WHEN 0 THEN 'End Uses' WHEN 1 THEN 'Utilities'
    ELSE CASE l_suppkey % 3 WHEN 0 THEN 'Utilities' ELSE 'Raw' END END AS aggregation,
  CASE l_linenumber % 3
    WHEN 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'Heating' WHEN 1 THEN 'Cooling' WHEN 2 THEN 'Lighting' ELSE 'Equipment' END
    ELSE CASE l_suppkey % 2 WHEN 0 THEN 'Electricity' ELSE 'NaturalGas' END END AS meter,
  CAST(EXTRACT(MONTH FROM l_shipdate) AS INT) AS month,
  SUM(l_quantity) AS value
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY 1, 2, 3, 4, 5, 6
"""

HOURLY = """
SELECT CAST(user_id AS {text}) AS building_id,
  'zone' AS zone,
  date_trunc('HOUR', ts) AS ts,
  ROUND(18 + AVG(value) / 5, 6) AS temp_c,
  CAST(30 + MAX(event_id) % 60 AS DOUBLE) AS rel_humidity
FROM {events}
GROUP BY CAST(user_id AS {text}), date_trunc('HOUR', ts)
"""

# Files of published runs: name / scenario / version / table, several versions each.
RUN_FILES = """
SELECT CONCAT('outputs/', p_brand, '/', CASE WHEN p_size % 2 = 0 THEN 'Baseline' ELSE 'Retrofit' END,
  '/v', CAST(p_partkey % 3 AS {text}), '.', CAST(p_partkey % 12 AS {text}), '.', CAST(p_size % 11 AS {text}), '/',
  CASE p_partkey % 5 WHEN 0 THEN 'Results' WHEN 1 THEN 'EnergyAndPeak' WHEN 2 THEN 'HourlyData'
    WHEN 3 THEN 'BasicOverheating' ELSE 'notes' END,
  CASE WHEN p_partkey % 5 = 4 THEN '.txt' ELSE '.pq' END) AS path
FROM {part}
"""

_TABLES = {
    "buildings": (BUILDINGS, ("customer",)),
    "stations": (STATIONS, ("supplier",)),
    "results": (RESULTS, ("lineitem", "orders")),
    "hourly": (HOURLY, ("events",)),
    "run_files": (RUN_FILES, ("part",)),
}


def _view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql, sources = _TABLES[name]
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in sources}
    return spark.sql(sql.replace("{text}", "STRING"), **tables)


def view_sql(name: str) -> str:
    """Oracle form of a view."""
    sql, sources = _TABLES[name]
    sql = sql.replace("{text}", "VARCHAR")
    for table in sources:
        sql = sql.replace("{" + table + "}", table)
    return sql.strip()


def buildings(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "buildings")


def stations(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "stations")


def results(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "results")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "hourly")


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "run_files")


def footprints(spark: SparkSession, folder: str) -> DataFrame:
    """Buildings with rotated-rectangle polygons in metres."""
    ring = G.rectangle_ring(*[F.col(c) for c in ("cx", "cy", "w", "d", "theta")])
    return buildings(spark, folder).withColumns(
        {"geom": F.array(F.array(ring)), "geom_type": F.lit("Polygon")}
    )


def with_rectangles(df: DataFrame) -> DataFrame:
    """Rectangle columns from the known shape, without searching for it."""
    ring = G.rectangle_ring(*[F.col(c) for c in ("cx", "cy", "w", "d", "theta")])
    boxed = df.withColumn("rect", F.slice(ring, 1, 4))
    return boxed.withColumns(
        {
            "footprint_area": F.col("w") * F.col("d"),
            "short_edge": F.least("w", "d"),
            "long_edge": F.greatest("w", "d"),
            "long_edge_angle": G.rectangle_angle(F.col("rect")),
            "aspect_ratio": F.greatest("w", "d") / F.least("w", "d"),
            "rect_fill_ratio": F.lit(1.0),
        }
    )


def assessed(spark: SparkSession, folder: str, height_col: str | None = "height", floors_col: str | None = None) -> DataFrame:
    """All buildings with canonical columns and drop reasons."""
    df = clean.impute_height_and_floors(with_rectangles(buildings(spark, folder)), CONFIG, height_col, floors_col)
    df = clean.fill_envelope(df, CONFIG)
    return clean.with_drop_reason(df, [*clean.attribute_rules(CONFIG), *clean.shape_rules(CONFIG)])


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Kept buildings, floors derived from heights."""
    return clean.kept(assessed(spark, folder))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Kept buildings as a written table, for operators that start from them several times."""
    return durable(cleaned(spark, folder))


def library(spark: SparkSession, folder: str) -> DataFrame:
    """Component library with one combination missing."""
    return (
        buildings(spark, folder)
        .where("not (typology = 'Hotel' and age_bracket = 'Pre_1980')")
        .select("region", "typology", "age_bracket", F.concat_ws("/", "typology", "age_bracket").alias("envelope"))
        .distinct()
    )


def eui(spark: SparkSession, folder: str) -> DataFrame:
    """One row per building and scenario."""
    from quoin.operators.results import building_eui

    return building_eui(results(spark, folder))


# --- oracle fragments -----------------------------------------------------------------------

_STATUS_LIST = "'none','unoccupied_unconditioned','unoccupied_conditioned','occupied_unconditioned','occupied_conditioned'"

_ANGLE = """CASE WHEN w > d THEN CASE WHEN pi() - fmod(theta, pi()) < 1e-9 THEN 0.0 ELSE fmod(theta, pi()) END
  WHEN d > w THEN CASE WHEN pi() - fmod(theta + pi() / 2, pi()) < 1e-9 THEN 0.0 ELSE fmod(theta + pi() / 2, pi()) END
  ELSE CASE WHEN pi() / 2 - fmod(theta, pi() / 2) < 1e-9 THEN 0.0 ELSE fmod(theta, pi() / 2) END END"""

_FRAGMENTS = {
    **{name: view_sql(name) for name in _TABLES},
    "shaped": f"SELECT *, least(w, d) AS short_edge, greatest(w, d) AS long_edge, {_ANGLE} AS long_edge_angle FROM buildings",
    "imputed": """SELECT * EXCLUDE (wwr, basement, attic, basement_exposed_frac),
  round_even(coalesce(height, 6.0) / 3.0, 0) AS n_floors, round_even(coalesce(height, 6.0) / 3.0, 0) * 3.0 AS height_m,
  CAST(3.0 AS DOUBLE) AS floor_height_m, coalesce(wwr, CAST(0.2 AS DOUBLE)) AS wwr,
  coalesce(basement, 'none') AS basement, coalesce(attic, 'none') AS attic,
  coalesce(basement_exposed_frac, CAST(0.25 AS DOUBLE)) AS basement_exposed_frac FROM shaped""",
    "cleaned": f"""SELECT * FROM imputed WHERE height_m BETWEEN 3 AND 300 AND n_floors BETWEEN 1 AND 125
  AND wwr BETWEEN 0 AND 1 AND basement IN ({_STATUS_LIST}) AND basement_exposed_frac BETWEEN 0 AND 1
  AND attic IN ({_STATUS_LIST}) AND w * d >= 10 AND short_edge >= 3 AND long_edge <= 1000""",
    "library": """SELECT DISTINCT region, typology, age_bracket, typology || '/' || age_bracket AS envelope
  FROM buildings WHERE NOT (typology = 'Hotel' AND age_bracket = 'Pre_1980')""",
    "eui": "SELECT building_id, scenario, sum(value) AS eui FROM results WHERE measurement = 'Energy' AND aggregation = 'End Uses' GROUP BY 1, 2",
    "corners": """SELECT c.*, k, cx + sx * w / 2 * cos(theta) - sy * d / 2 * sin(theta) AS vx,
  cy + sx * w / 2 * sin(theta) + sy * d / 2 * cos(theta) AS vy
  FROM cleaned c, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) AS s(k, sx, sy)""",
    "near": """SELECT a.building_id AS src, b.building_id AS dst, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS distance,
  a.cx AS ax, a.cy AS ay, a.w AS aw, a.d AS ad, a.theta AS ta, b.cx AS bx, b.cy AS by_, b.w AS bw, b.d AS bd, b.theta AS tb,
  b.height_m AS b_height
  FROM cleaned a JOIN cleaned b ON a.building_id <> b.building_id
  AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 10000""",
    # Separating axes: the four axis directions are a's and b's sides.
    "axes": """SELECT src, dst, max(gap) AS gap FROM (
  SELECT src, dst, abs((bx - ax) * cos(phi) + (by_ - ay) * sin(phi))
    - aw / 2 * abs(cos(ta - phi)) - ad / 2 * abs(sin(ta - phi)) - bw / 2 * abs(cos(tb - phi)) - bd / 2 * abs(sin(tb - phi)) AS gap
  FROM (SELECT *, unnest([ta, ta + pi() / 2, tb, tb + pi() / 2]) AS phi FROM near)) GROUP BY 1, 2""",
    "apart": "SELECT n.* FROM near n JOIN axes x ON n.src = x.src AND n.dst = x.dst WHERE x.gap > 1e-9",
    "sites": "SELECT * FROM stations WHERE source IN ('tmyx')",
    "closest": """SELECT * FROM (SELECT building_id, station_id, path, dist, row_number() OVER (PARTITION BY building_id ORDER BY dist, station_id) AS rn
  FROM (SELECT b.building_id, s.station_id, s.path, sqrt((s.x - b.cx) * (s.x - b.cx) + (s.y - b.cy) * (s.y - b.cy)) AS dist
    FROM cleaned b, sites s)) WHERE rn = 1 AND dist < 500000""",
}

_NEEDS = {
    "shaped": ["buildings"],
    "imputed": ["shaped"],
    "cleaned": ["imputed"],
    "library": ["buildings"],
    "eui": ["results"],
    "corners": ["cleaned"],
    "near": ["cleaned"],
    "axes": ["near"],
    "apart": ["near", "axes"],
    "sites": ["stations"],
    "closest": ["cleaned", "sites"],
}


def oracle(body: str, *names: str) -> str:
    """``body`` with the named fragments, and what they build on, as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_FRAGMENTS[n]})" for n in ordered) + "\n" + body
