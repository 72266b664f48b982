"""Everything a results page shows, as one set of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators import results as R
from quoin.operators.checks import ValidationError, is_results_format
from quoin.session import durable


def page_facts(results: DataFrame) -> DataFrame:
    """What all tables of a page are made of, in one pass over the results.

    Rows of two grouping sets, told apart by ``of_building``: energy and highest peak per building, and sums and
    moments per measurement, aggregation, meter and month; both per scenario where there are several.
    """
    scenario = [c for c in ("scenario",) if c in results.columns]
    series = ["measurement", "aggregation", "meter", "month"]
    value = R._value()
    energy = (F.col("m") == "Energy") & (F.col("a") == "End Uses")
    peak = (F.col("m") == "Peak") & (F.col("a") == "Raw")
    # The levels once more under other names, since those that are grouped by are NULL in the building's set.
    rows = results.withColumns({"m": F.col("measurement"), "a": F.col("aggregation")})
    sets = rows.groupingSets([[*scenario, "building_id"], [*scenario, *series]], *scenario, "building_id", *series)
    return sets.agg(
        (F.grouping("building_id") == 0).alias("of_building"),
        F.sum(F.when(energy, value)).alias("energy"),
        F.count(F.when(energy, 1)).alias("n_energy"),
        F.max(F.when(peak, value)).alias("peak"),
        F.sum(value).alias("sum"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"),
    )


def summarise(results: DataFrame, region_name: str = "", scenario_name: str = "") -> dict[str, DataFrame]:
    """Tables of a results page, each labelled with region and scenario.

    A table with several scenarios is labelled with its own, and ``scenario_name`` isn't used.  Eager: one pass over
    the results is stored, and every table is read from it; the largest ones have one row per building.
    """
    if not is_results_format(results):
        raise ValidationError("not a results table")
    facts = durable(page_facts(results))
    scenario = [c for c in ("scenario",) if c in results.columns]
    buildings, series = facts.where("of_building"), facts.where("not of_building and measurement = 'Energy'")
    known = buildings.groupBy(*scenario).agg(F.count("building_id").alias("n"))

    def label(df: DataFrame) -> DataFrame:
        own = F.col("scenario") if scenario else F.lit(scenario_name)
        tags = [F.lit(region_name).alias("region_name"), own.alias("scenario_name")]
        return df.select(*tags, *(c for c in df.columns if c != "scenario"))

    def monthly(aggregation: str) -> DataFrame:
        stats = series.where(F.col("aggregation") == aggregation).withColumn("sd", F.coalesce("sd", F.lit(0.0)))
        return R.with_band(stats.select(*scenario, "meter", "month", "avg", "min", "max", "sd"), known, [*scenario, "meter", "month"])

    def meters(aggregation: str) -> DataFrame:
        keys = [*scenario, "meter"]
        return series.where(F.col("aggregation") == aggregation).select(*keys).distinct().orderBy(*keys)

    def totals(aggregation: str) -> DataFrame:
        keys = [*scenario, "meter"]
        return R.major(series.where(F.col("aggregation") == aggregation).groupBy(*keys).agg(F.coalesce(F.sum("sum"), F.lit(0.0)).alias("total")), keys)

    parts = {
        "eui": buildings.where("n_energy > 0").select(*scenario, "building_id", F.coalesce("energy", F.lit(0.0)).alias("eui")),
        "peak": buildings.where("peak is not null").select(*scenario, "building_id", "peak"),
        "monthly_end_uses": monthly("End Uses"),
        "monthly_fuels": monthly("Utilities"),
        "end_use_meters": meters("End Uses"),
        "fuel_meters": meters("Utilities"),
        "end_uses_total": totals("End Uses"),
        "utilities_total": totals("Utilities"),
    }
    return {name: label(df) for name, df in parts.items()}
