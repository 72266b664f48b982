"""Schema and value checks.

Plan-time checks look at the schema only.  Value checks return a table of violations, so that one job
reports everything; ``require_empty`` turns such a table into an error for strict callers.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.functions.projection import is_supported
from quoin.schema import NUMERIC_TYPES, RESULT_LEVELS, STATUSES, FieldSpec


class ValidationError(ValueError):
    """A table breaks a rule it must satisfy."""


# --- plan-time checks -----------------------------------------------------------------------


def require_columns(df: DataFrame, expected: Iterable[str | None]) -> DataFrame:
    missing = [c for c in expected if c is not None and c not in df.columns]
    if missing:
        raise ValidationError(f"missing columns {missing}; available: {df.columns}")
    return df


def require_numeric(df: DataFrame, *columns: str | None) -> DataFrame:
    """Height and floor columns must be 32/64 bit ints or floats."""
    accepted = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    for name in columns:
        if name is not None and not isinstance(df.schema[name].dataType, accepted):
            raise ValidationError(f"column {name!r} is {df.schema[name].dataType.simpleString()}, not numeric")
    return df


def require_srid(srid: int | None, metric_srid: int) -> int:
    """Only 4326, 3857 and the configured metric system are accepted."""
    if srid is None:
        raise ValidationError("the table has no coordinate reference system")
    if srid not in (4326, 3857, metric_srid) or not is_supported(srid):
        raise ValidationError(f"unexpected srid {srid}; expected 4326, 3857 or {metric_srid}")
    return srid


def restore_truncated_names(df: DataFrame, expected: Iterable[str | None]) -> DataFrame:
    """Shapefiles cut names to ten characters: rename a cut name back unless the full one exists."""
    renames = {
        name[:10]: name
        for name in expected
        if name is not None and name not in df.columns and name[:10] in df.columns
    }
    return df.withColumnsRenamed(renames)


def has_geo_columns(df: DataFrame) -> bool:
    return "lat" in df.columns and "lon" in df.columns


def require_geo_columns(df: DataFrame) -> tuple[str, str]:
    require_columns(df, ("lat", "lon"))
    return "lat", "lon"


def is_results_format(df: DataFrame) -> bool:
    """True for a long results table: the four level columns, in order, and a value."""
    levels = [c for c in df.columns if c in RESULT_LEVELS]
    return tuple(levels) == RESULT_LEVELS and "value" in df.columns


def field_kinds(fields: Sequence[FieldSpec]) -> dict[str, str]:
    """Kind per field; a field without a validator raises."""
    return {f.name: f.kind for f in fields}


# --- value checks ---------------------------------------------------------------------------


def require_rows(df: DataFrame) -> DataFrame:
    """Strict, eager: stops at the first row."""
    if df.isEmpty():
        raise ValidationError("the table has no rows")
    return df


def require_empty(violations: DataFrame, shown: int = 5) -> None:
    """Strict, eager: raise with a few examples if the violations table has rows."""
    examples = violations.limit(shown).collect()
    if examples:
        raise ValidationError("; ".join(str(row.asDict()) for row in examples))


def _field_rule(field: FieldSpec, missing_ok: bool) -> Column | None:
    """True where the value is acceptable; None when there is nothing to check."""
    column = F.col(field.name)
    if field.kind == "categorical":
        if not field.options:
            return None
        valid = column.isin(list(field.options))
        missing = column.isNull()
    else:
        if field.minimum is None or field.maximum is None:
            return None
        valid = column.between(field.minimum, field.maximum)
        missing = column.isNull() | F.isnan(column.cast("double"))
    return F.when(missing, F.lit(missing_ok)).otherwise(F.coalesce(valid, F.lit(False)))


def field_violations(
    df: DataFrame, fields: Sequence[FieldSpec], missing_ok: bool = False
) -> DataFrame:
    """Bad values per field: (field, kind, bad_value, n_rows).

    One pass: each row emits only its own violations, which are then counted with map-side partial
    aggregation, so neither the good rows nor repeated bad values are shuffled.
    """
    kinds = field_kinds(fields)
    entries = []
    for field in fields:
        if field.name not in df.columns:
            continue
        rule = _field_rule(field, missing_ok)
        if rule is None:
            continue
        entries.append(
            F.when(
                ~rule,
                F.struct(
                    F.lit(field.name).alias("field"),
                    F.lit(kinds[field.name]).alias("kind"),
                    F.col(field.name).cast("string").alias("bad_value"),
                ),
            )
        )
    if not entries:
        schema = "field string, kind string, bad_value string, n_rows bigint"
        return df.sparkSession.createDataFrame([], schema)
    bad = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("v"))
    return bad.groupBy("v.field", "v.kind", "v.bad_value").agg(F.count(F.lit(1)).alias("n_rows"))


def outcome_counts(df: DataFrame, fields: Sequence[FieldSpec]) -> list[Column]:
    """Counts over rows with building_id and drop_reason: n_rows, n_kept, n_missing (no id), n_bad (values)."""
    rules = [_field_rule(f, False) for f in fields if f.name in df.columns]
    bad = [F.count(F.when(~rule, 1)) for rule in rules if rule is not None]
    counts = {
        "n_rows": F.count(F.lit(1)),
        "n_kept": F.count(F.when(F.col("drop_reason").isNull(), 1)),
        "n_missing": F.count(F.when(F.col("building_id").isNull(), 1)),
        "n_bad": sum(bad, F.lit(0).cast("bigint")),
    }
    return [c.alias(name) for name, c in counts.items()]


def observed(df: DataFrame, fields: Sequence[FieldSpec]) -> tuple[DataFrame, Observation]:
    """``df`` and its ``outcome_counts``, which the next job over it counts by the way, for :func:`require_observed`."""
    seen = Observation()
    return df.observe(seen, *outcome_counts(df, fields)), seen


def require_observed(counts: Mapping[str, int], assessed: DataFrame, fields: Sequence[FieldSpec]) -> None:
    """Strict, eager: raise on an empty table, bad values, missing or repeated ids, or when no row is kept.

    Only repeated ids need a look at the stored rows, at one column of them.
    """
    if not counts["n_rows"]:
        raise ValidationError("the table has no rows")
    if counts["n_bad"]:
        require_empty(field_violations(assessed, fields))
    if counts["n_missing"]:
        raise ValidationError(f"{counts['n_missing']} rows have no building_id")
    require_ids(assessed)
    if not counts["n_kept"]:
        raise ValidationError("every building was dropped")


def id_report(df: DataFrame, id_col: str = "building_id") -> DataFrame:
    """One row: rows, missing ids, distinct ids, ids used more than once (compared as text)."""
    require_columns(df, (id_col,))
    per_id = df.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("id").alias("n_distinct"),
        F.count(F.when(F.col("id").isNotNull() & (F.col("n") > 1), 1)).alias("n_repeated"),
    )


def duplicate_ids(df: DataFrame, id_col: str = "building_id") -> DataFrame:
    """Ids used more than once, with their row counts."""
    per_id = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias(id_col))
    return per_id.agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_ids(df: DataFrame, id_col: str = "building_id") -> DataFrame:
    """Strict, eager: ids present, complete and unique; returned as text."""
    report = id_report(df, id_col).first()
    if report["n_missing"]:
        raise ValidationError(f"{report['n_missing']} rows have no {id_col}")
    if report["n_repeated"]:
        raise ValidationError(f"{report['n_repeated']} values of {id_col} are used more than once")
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def spec_violations(specs: DataFrame) -> DataFrame:
    """Specs outside the bounds a simulation accepts: (building_id, reasons).

    The exposed fraction must lie strictly between 0 and 1 here, although cleaning keeps both ends.
    """
    exposed = F.col("basement_exposed_frac")
    floors = F.col("n_floors")
    rules = {
        "wwr": F.col("wwr").between(0, 1),
        "height": (F.col("height_m") >= 0) & ~F.isnan("height_m"),
        "floors": (floors >= 0) & (floors == F.floor(floors)),
        "floor_height": (F.col("floor_height_m") >= 0) & ~F.isnan("floor_height_m"),
        "basement": F.col("basement").isin(*STATUSES),
        "attic": F.col("attic").isin(*STATUSES),
        "exposed_fraction": (exposed > 0) & (exposed < 1),
    }
    failed = F.array(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    )
    reasons = F.filter(failed, lambda r: r.isNotNull())
    return specs.select("building_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def area_mismatches(
    modelled: DataFrame, expected: DataFrame, rtol: float = 1e-5, atol: float = 1e-8
) -> DataFrame:
    """Expected buildings whose modelled conditioned area is not close to it, or is not there at all."""
    a, b = F.col("modelled_area"), F.col("expected_area")
    joined = expected.select("building_id", "expected_area").join(
        modelled.select("building_id", "modelled_area"), "building_id", "left"
    )
    close = F.coalesce(F.abs(a - b) <= F.lit(atol) + F.abs(b) * rtol, F.lit(False))
    return joined.where(~close)
