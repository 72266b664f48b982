"""Building specifications and the feature records derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.config import PreprocessConfig
from quoin.functions.draws import unit_draw, uniform_draw
from quoin.functions.geometry import ring_to_wkt
from quoin.operators.checks import ValidationError
from quoin.operators.shading import BINS
from quoin.schema import CONDITIONED, INDEX_FEATURES, OCCUPIED, FieldSpec

# Edge length above which a plan gets a core zone [m]; range of use fractions; rise over
# run of used and of unused attics; highest attic in floor heights; side of the dry-run square [m].
CORE_ZONE_EDGE = 15.0
USE_FRACTION = (0.2, 0.6)
USED_ATTIC_RISE = (6 / 12, 9 / 12)
UNUSED_ATTIC_RISE = (4 / 12, 6 / 12)
ATTIC_LIMIT_FLOORS = 2.5
GRID_WIDTH = 12.0


# --- derived columns ------------------------------------------------------------------------


def add_status_flags(df: DataFrame) -> DataFrame:
    """has_ / is_occupied / is_conditioned flags of basement and attic."""
    columns = {}
    for space in ("basement", "attic"):
        status = F.col(space)
        columns[f"has_{space}"] = status != "none"
        columns[f"{space}_is_occupied"] = status.isin(*OCCUPIED)
        columns[f"{space}_is_conditioned"] = status.isin(*CONDITIONED)
    return df.withColumns(columns)


def add_floor_counts(df: DataFrame) -> DataFrame:
    """Floors that are conditioned / occupied, basement and attic included.  Needs status flags."""
    floors = F.col("n_floors").cast("int")
    columns = {}
    for use in ("conditioned", "occupied"):
        extra = [F.col(f"{space}_is_{use}").cast("int") for space in ("basement", "attic")]
        columns[f"n_{use}_floors"] = floors + extra[0] + extra[1]
    return df.withColumns(columns)


def add_areas(df: DataFrame) -> DataFrame:
    """Model footprint, conditioned and occupied area.  Needs floor counts."""
    footprint = F.col("long_edge") * F.col("short_edge")
    return df.withColumns(
        {
            "model_footprint_area": footprint,
            "conditioned_area": F.col("n_conditioned_floors") * footprint,
            "occupied_area": F.col("n_occupied_floors") * footprint,
        }
    )


def add_zoning(df: DataFrame) -> DataFrame:
    wide = (F.col("long_edge") > CORE_ZONE_EDGE) & (F.col("short_edge") > CORE_ZONE_EDGE)
    return df.withColumn("zoning", F.when(wide, F.lit("core/perim")).otherwise(F.lit("by_storey")))


def add_use_fractions(df: DataFrame, seed: str = "0") -> DataFrame:
    """Use fraction of basement and attic: 0 when unoccupied, else uniform in [0.2, 0.6)."""
    columns = {}
    for space in ("basement", "attic"):
        draw = uniform_draw(F.col("building_id"), f"{space}_use/{seed}", *USE_FRACTION)
        columns[f"{space}_use_fraction"] = F.when(F.col(f"{space}_is_occupied"), draw).otherwise(F.lit(0.0))
    return df.withColumns(columns)


def add_attic_height(df: DataFrame, seed: str = "0") -> DataFrame:
    """``attic_height``: NULL without an attic, else half the short edge times a random slope.

    Drawing slopes until the attic is at most 2.5 floor heights is the same as drawing once from the
    slopes that satisfy the limit.  Where none does, the height is NULL and ``attic_fits`` false.
    """
    used = F.col("attic_is_occupied") | F.col("attic_is_conditioned")
    low = F.when(used, F.lit(USED_ATTIC_RISE[0])).otherwise(F.lit(UNUSED_ATTIC_RISE[0]))
    high = F.when(used, F.lit(USED_ATTIC_RISE[1])).otherwise(F.lit(UNUSED_ATTIC_RISE[1]))
    run = F.col("short_edge") / 2
    steepest = F.try_divide(F.col("floor_height_m") * ATTIC_LIMIT_FLOORS, run)
    fits = ~F.col("has_attic") | F.coalesce(low <= steepest, F.lit(True))
    top = F.least(high, steepest)
    height = run * (low + (top - low) * unit_draw(F.col("building_id"), f"attic_height/{seed}"))
    return df.withColumns(
        {"attic_fits": fits, "attic_height": F.when(F.col("has_attic") & fits, height)}
    )


def attic_violations(df: DataFrame) -> DataFrame:
    """Buildings whose lowest permitted attic is still too high.  Needs ``add_attic_height``."""
    return df.where(~F.col("attic_fits")).select("building_id", "short_edge", "floor_height_m")


def derive_all(df: DataFrame, seed: str = "0") -> DataFrame:
    df = add_areas(add_floor_counts(add_status_flags(df)))
    return add_attic_height(add_use_fractions(add_zoning(df), seed), seed)


# --- features -------------------------------------------------------------------------------


def file_stem(path: Column) -> Column:
    """Last path segment without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def feature_table(
    buildings: DataFrame, semantic: Mapping[str, str] | Sequence[str], mask_col: str | None = None, seed: str = "0"
) -> DataFrame:
    """One feature record per building, columns named ``feature.*``.

    ``semantic`` names the semantic features: a list of columns, or feature name -> column.
    ``mask_col`` is a shading mask array; its bins become 48 columns.
    """
    if not isinstance(semantic, Mapping):
        semantic = {name: name for name in semantic}
    df = derive_all(buildings, seed)
    angle = F.col("long_edge_angle")
    geometry = {
        "long_edge": F.col("long_edge"),
        "short_edge": F.col("short_edge"),
        "orientation": angle,
        "orientation.cos": F.cos(angle),
        "orientation.sin": F.sin(angle),
        "aspect_ratio": F.col("aspect_ratio"),
        "wwr": F.col("wwr"),
        "num_floors": F.col("n_floors").cast("int"),
        "f2f_height": F.col("floor_height_m"),
        "zoning": F.col("zoning"),
        "energy_model_conditioned_area": F.col("conditioned_area"),
        "energy_model_occupied_area": F.col("occupied_area"),
        "attic_height": F.coalesce("attic_height", F.lit(0.0)),
        "exposed_basement_frac": F.col("basement_exposed_frac"),
    }
    columns = [c.alias(f"feature.geometry.{name}") for name, c in geometry.items()]
    if mask_col is not None:
        columns += [
            F.col(mask_col)[k].alias(f"feature.geometry.shading_mask_{k:02d}") for k in range(BINS)
        ]
    columns += [F.col(c).alias(f"feature.semantic.{name}") for name, c in semantic.items()]
    columns.append(file_stem(F.col("weather_file")).alias("feature.weather.file"))
    for space in ("basement", "attic"):
        prefix = f"feature.extra_spaces.{space}"
        flags = {"exists": f"has_{space}", "occupied": f"{space}_is_occupied", "conditioned": f"{space}_is_conditioned"}
        columns += [
            F.when(F.col(flag), F.lit("Yes")).otherwise(F.lit("No")).alias(f"{prefix}.{name}")
            for name, flag in flags.items()
        ]
        columns.append(F.col(f"{space}_use_fraction").alias(f"{prefix}.use_fraction"))
    return df.select("building_id", *columns)


def index_subset(features: DataFrame) -> DataFrame:
    """The essential feature columns that are present."""
    return features.select("building_id", *[F.col(f"`{c}`") for c in INDEX_FEATURES if c in features.columns])


def feature_index(features: DataFrame) -> DataFrame:
    """building_id and every semantic feature."""
    names = [c for c in features.columns if c == "building_id" or "feature.semantic." in c]
    return features.select(*[F.col(f"`{c}`") for c in names])


# --- specifications -------------------------------------------------------------------------


def closed_wkt(rect: Column) -> Column:
    """WKT of a rectangle given by four corners."""
    return ring_to_wkt(F.concat(rect, F.slice(rect, 1, 1)))


def building_specs(buildings: DataFrame, db_file: str, fields_file: str, component_map_file: str) -> DataFrame:
    """Specification records of cleaned buildings with neighbour lists."""
    items = F.col("neighbors")
    return buildings.select(
        "building_id",
        F.lit(db_file).alias("db_file"),
        F.lit(fields_file).alias("semantic_fields_file"),
        F.lit(component_map_file).alias("component_map_file"),
        "weather_file",
        "context",
        F.transform(items, lambda n: closed_wkt(n["rect"])).alias("neighbor_polys"),
        F.transform(items, lambda n: n["height"]).alias("neighbor_heights"),
        F.transform(items, lambda n: n["floors"]).alias("neighbor_floors"),
        closed_wkt(F.col("rect")).alias("rotated_rectangle"),
        "long_edge_angle",
        "long_edge",
        "short_edge",
        "aspect_ratio",
        "rect_fill_ratio",
        "wwr",
        "height_m",
        F.col("n_floors").cast("int").alias("n_floors"),
        "floor_height_m",
        "basement",
        "attic",
        "basement_exposed_frac",
    )


def parametric_specs(rows: DataFrame) -> DataFrame:
    """Specs of plain boxes given by length, width, floors and floor height.

    The longer side becomes the length; the rectangle sits at the origin, unrotated, alone.
    """
    length, width = F.greatest("length", "width"), F.least("length", "width")
    sized = rows.withColumns({"long_edge": length, "short_edge": width})
    long, short, zero = F.col("long_edge"), F.col("short_edge"), F.lit(0.0)
    corners = [(zero, zero), (long, zero), (long, short), (zero, short)]
    rect = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    return sized.withColumns(
        {
            "rotated_rectangle": closed_wkt(rect),
            "long_edge_angle": zero,
            "aspect_ratio": F.try_divide(long, short),
            "rect_fill_ratio": F.lit(1.0),
            "height_m": F.col("n_floors") * F.col("floor_height_m"),
            "n_neighbors": F.lit(0),
        }
    ).drop("length", "width")


def parametric_violations(rows: DataFrame) -> DataFrame:
    """Parametric rows outside their bounds: (building_id, reasons)."""
    rules = {
        "length": F.col("length") >= 3,
        "width": F.col("width") >= 3,
        "floors": F.col("n_floors") >= 1,
        "floor_height": F.col("floor_height_m") >= 0,
        "wwr": F.col("wwr").between(0, 1),
        "exposed_fraction": F.col("basement_exposed_frac").between(0, 1),
    }
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    return rows.select("building_id", F.filter(failed, lambda r: r.isNotNull()).alias("reasons")).where(
        F.size("reasons") > 0
    )


# --- parameter grid -------------------------------------------------------------------------


def semantic_grid(spark: SparkSession, fields: Sequence[FieldSpec], steps: int = 10) -> DataFrame:
    """All combinations of field values: (grid_index, one column per field).

    Row i spells i in mixed radix, so the product is generated in parallel from a range and nothing
    is joined.
    """
    levels = [f.levels(steps) for f in fields]
    total = 1
    for values in levels:
        total *= len(values)
    index, stride, columns = F.col("id"), total, []
    for field, values in zip(fields, levels):
        stride //= max(len(values), 1)
        digit = (F.floor(index / stride) % len(values)).cast("int")
        columns.append(F.array(*[F.lit(v) for v in values])[digit].alias(field.name))
    return spark.range(total).select(index.alias("grid_index"), *columns)


def grid_specs(
    spark: SparkSession,
    fields: Sequence[FieldSpec],
    config: PreprocessConfig,
    weather_file: str,
    max_tests: int | None = None,
    steps: int = 10,
) -> DataFrame:
    """Dry-run specs: the grid (or a sample of it) on one fixed square building."""
    from quoin.operators.ordering import sample_rows

    if not weather_file:
        raise ValidationError("a weather file is required for a dry run")
    grid = semantic_grid(spark, fields, steps)
    if max_tests:
        grid = sample_rows(grid, max_tests, "grid_index")
    side = F.lit(GRID_WIDTH)
    corners = [(0.0, 0.0), (GRID_WIDTH, 0.0), (GRID_WIDTH, GRID_WIDTH), (0.0, GRID_WIDTH)]
    rect = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return grid.select(
        F.concat(F.lit("dryrun_"), F.lpad(F.col("grid_index").cast("string"), F.greatest(F.length(F.col("grid_index").cast("string")), F.lit(5)), F.lit("0"))).alias("building_id"),
        F.struct(*[f.name for f in fields]).alias("context"),
        F.lit(weather_file).alias("weather_file"),
        closed_wkt(rect).alias("rotated_rectangle"),
        F.lit(0.0).alias("long_edge_angle"),
        side.alias("long_edge"),
        side.alias("short_edge"),
        F.lit(1.0).alias("aspect_ratio"),
        F.lit(1.0).alias("rect_fill_ratio"),
        F.lit(config.default_wwr).alias("wwr"),
        F.lit(float(config.default_height)).alias("height_m"),
        F.lit(config.default_num_floors).alias("n_floors"),
        F.lit(config.f2f_height).alias("floor_height_m"),
        F.lit(config.default_basement).alias("basement"),
        F.lit(config.default_attic).alias("attic"),
        F.lit(config.default_exposed_basement_frac).alias("basement_exposed_frac"),
    )
