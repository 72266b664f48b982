"""Writers for result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.config import HourlyConfig
from quoin.operators.results import SEPARATOR, month_rows, sheet_label


def csv_ready(df: DataFrame, keys: Sequence[str] = ("building_id",), value_columns: Sequence[str] | None = None) -> DataFrame:
    """Keys and the value columns only; other index columns (features) go.

    A table of several scenarios needs the scenario among its keys.
    """
    values = value_columns or [c for c in df.columns if c.count(SEPARATOR) == 3]
    return df.select(*keys, *[F.col(f"`{c}`") for c in values])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_month_csv(results: DataFrame, names: Sequence[str], path: str, mode: str = "error") -> None:
    """Months as rows, ``Measurement|Aggregation|Meter`` as columns."""
    write_csv(month_rows(results, names), path, mode)


def labelled(results: DataFrame) -> DataFrame:
    """Adds ``sheet``: the name of the split a row belongs to."""
    return results.withColumn("sheet", sheet_label())


def write_split(results: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per measurement and aggregation."""
    labelled(results).write.mode(mode).partitionBy("sheet").parquet(path)


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """Result store, partitioned so that readers of one scenario or measurement skip the rest."""
    results.write.mode(mode).partitionBy("scenario", "measurement").parquet(path)


def route_hourly(hourly: DataFrame, config: HourlyConfig, path: str, mode: str = "error") -> DataFrame | None:
    """Write and / or hand back the configured hourly variables, as the output mode says."""
    rows = hourly.where(F.col("meter").isin(*config.variables)) if config.variables else hourly
    if config.writes_files:
        rows.write.mode(mode).parquet(path)
    return rows if config.returns_frame else None
