"""Imputation and rule-based dropping with full accounting.

Rows are never dropped rule by rule.  Every rule contributes to one ``drop_reason`` column (first
failing rule in order), from which both the kept rows and the report follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.config import PreprocessConfig
from quoin.operators.checks import ValidationError, require_numeric
from quoin.schema import STATUSES

Rule = tuple[str, Column]


def _number(name: str) -> Column:
    """The column as double, with NaN read as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


# --- imputation -----------------------------------------------------------------------------


def impute_height_and_floors(
    df: DataFrame,
    config: PreprocessConfig,
    height_col: str | None = None,
    floors_col: str | None = None,
) -> DataFrame:
    """Canonical ``height_m``, ``n_floors`` and ``floor_height_m``.

    Only floors known: whole floors (half to even, missing -> default), height follows.  Only height
    known: missing -> default, floors rounded from it and the height snapped to whole floors.  Both
    known: taken as they are, missing ones are left to the bounds rule.
    """
    if height_col is None and floors_col is None:
        raise ValidationError("neither a height nor a floors column is given")
    require_numeric(df, height_col, floors_col)
    storey = F.lit(float(config.f2f_height))
    if height_col is None:
        floors = F.coalesce(F.bround(_number(floors_col), 0), F.lit(float(config.default_num_floors)))
        columns = {"n_floors": floors, "height_m": floors * storey}
    elif floors_col is None:
        height = F.coalesce(_number(height_col), F.lit(float(config.default_height)))
        floors = F.bround(height / storey, 0)
        columns = {"n_floors": floors, "height_m": floors * storey}
    else:
        columns = {"n_floors": _number(floors_col), "height_m": _number(height_col)}
    return df.withColumns({**columns, "floor_height_m": storey})


def fill_missing(df: DataFrame, target: str, source: str | None, default: float | str) -> DataFrame:
    """Canonical column ``target`` from ``source``; absent column or missing value -> default."""
    if source is None or source not in df.columns:
        return df.withColumn(target, F.lit(default))
    value = F.col(source) if isinstance(default, str) else _number(source)
    return df.withColumn(target, F.coalesce(value, F.lit(default)))


def fill_envelope(
    df: DataFrame,
    config: PreprocessConfig,
    wwr_col: str | None = "wwr",
    basement_col: str | None = "basement",
    exposed_col: str | None = "basement_exposed_frac",
    attic_col: str | None = "attic",
) -> DataFrame:
    df = fill_missing(df, "wwr", wwr_col, float(config.default_wwr))
    df = fill_missing(df, "basement", basement_col, config.default_basement)
    df = fill_missing(
        df, "basement_exposed_frac", exposed_col, float(config.default_exposed_basement_frac)
    )
    return fill_missing(df, "attic", attic_col, config.default_attic)


def tag_scenario(df: DataFrame, scenario: str | None) -> DataFrame:
    return df if scenario is None else df.withColumn("scenario", F.lit(scenario))


def pack_context(df: DataFrame, fields: Sequence[str], target: str = "context") -> DataFrame:
    """Semantic fields of a row as one typed struct."""
    return df.withColumn(target, F.struct(*[F.col(f) for f in fields]))


def add_provenance(df: DataFrame, db_file: str, fields_file: str, component_map_file: str) -> DataFrame:
    return df.withColumns(
        {
            "db_file": F.lit(db_file),
            "semantic_fields_file": F.lit(fields_file),
            "component_map_file": F.lit(component_map_file),
        }
    )


# --- rules ----------------------------------------------------------------------------------


def attribute_rules(config: PreprocessConfig) -> list[Rule]:
    return [
        (
            "height_or_floors",
            F.col("height_m").between(config.min_building_height, config.max_building_height)
            & F.col("n_floors").between(config.min_num_floors, config.max_num_floors),
        ),
        ("wwr", F.col("wwr").between(0, 1)),
        ("basement", F.col("basement").isin(*STATUSES)),
        ("basement_exposed_frac", F.col("basement_exposed_frac").between(0, 1)),
        ("attic", F.col("attic").isin(*STATUSES)),
    ]


def polygon_rule(kind_col: str = "geom_type") -> Rule:
    return ("not_polygon", F.col(kind_col).isin("Polygon", "MultiPolygon"))


def shape_rules(config: PreprocessConfig) -> list[Rule]:
    low, high = config.min_edge_length, config.max_edge_length
    return [
        ("area", (F.col("footprint_area") >= config.min_building_area) & ~F.isnan("footprint_area")),
        ("edge_length", F.col("short_edge").between(low, high) & F.col("long_edge").between(low, high)),
    ]


def with_drop_reason(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add or extend ``drop_reason``: the first rule a row fails; a missing value fails its rule."""
    failures = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    if "drop_reason" in df.columns:
        failures = [F.col("drop_reason"), *failures]
    return df.withColumn("drop_reason", F.coalesce(*failures))


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("drop_reason").isNull()).drop("drop_reason")


def keep_where(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows that satisfy one rule."""
    return df.where(F.coalesce(rule[1], F.lit(False)))


def drop_report(df: DataFrame, in_reach: DataFrame | None = None) -> DataFrame:
    """Rows per outcome: (reason, n_rows), kept rows under ``kept``.

    With ``in_reach`` (building_id), kept rows that aren't there are counted under ``no_station``.
    """
    outcome = F.lit("kept")
    if in_reach is not None:
        there = in_reach.select("building_id").distinct().withColumn("_there", F.lit(True))
        df = df.select("building_id", "drop_reason").join(there, "building_id", "left")
        outcome = F.when(F.col("_there"), outcome).otherwise("no_station")
    reason = F.coalesce(F.col("drop_reason"), outcome).alias("reason")
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n_rows"))


def drop_totals(df: DataFrame) -> DataFrame:
    """One row: initial, dropped and kept counts and the dropped share."""
    dropped = F.count("drop_reason")
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("n_initial"),
        dropped.alias("n_dropped"),
        (total - dropped).alias("n_kept"),
        F.try_divide(dropped, total).alias("dropped_share"),
    )


def drop_shares(df: DataFrame, rule_names: Sequence[str]) -> DataFrame:
    """Per rule, rows dropped and their ratio to the rows remaining after that rule.

    All counters come from one global aggregate; the running total is plain arithmetic over the
    handful of rules.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("drop_reason") == r, 1)).alias(f"n_{i}") for i, r in enumerate(rule_names)],
    )
    left, rows = F.col("total"), []
    for i, name in enumerate(rule_names):
        left = left - F.col(f"n_{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("reason"),
                F.col(f"n_{i}").alias("n_dropped"),
                left.alias("n_remaining"),
                F.try_divide(F.col(f"n_{i}"), left).alias("dropped_per_remaining"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))
