"""Summaries, comparisons and reshaping of long result tables.

Long form: (building_id, scenario, measurement, aggregation, meter, month, value).  A missing cell is
NULL; NaN is turned into NULL on the way in.  Where there is a scenario, it is a key of every result: scenarios
are never added together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.checks import ValidationError, require_columns
from quoin.schema import RESULT_LEVELS

# Two-sided 95 % normal quantile; share of the total below which a meter is left out.
CI_FACTOR = 1.96
MINOR_SHARE = 0.01
# Fixed value: joins the level names in a wide column name.
SEPARATOR = "|"
METRICS = ("energy_usage", "peak_power", "percent_change", "eui", "custom")


def _value() -> Column:
    return F.nanvl("value", F.lit(None).cast("double"))


def _filled_sum() -> Column:
    return F.coalesce(F.sum(_value()), F.lit(0.0))


def _with_scenario(results: DataFrame, *keys: str) -> list[str]:
    return [*(["scenario"] if "scenario" in results.columns else []), *keys]


def of(results: DataFrame, measurement: str, aggregation: str | None = None) -> DataFrame:
    rows = results.where(F.col("measurement") == measurement)
    return rows if aggregation is None else rows.where(F.col("aggregation") == aggregation)


# --- aggregates -----------------------------------------------------------------------------


def annual_totals(results: DataFrame) -> DataFrame:
    """Sum over months per building, measurement, aggregation and meter; all-missing gives 0."""
    if "month" not in results.columns:
        return results
    keys = [c for c in results.columns if c not in ("month", "value")]
    return results.groupBy(*keys).agg(_filled_sum().alias("value"))


def monthly_stats(results: DataFrame, aggregation: str) -> DataFrame:
    """Mean, range and 95 % band of Energy per meter and month.

    The count behind the band is that of all buildings (of the scenario), with or without a value; one value has
    no spread.
    """
    keys = _with_scenario(results, "meter", "month")
    scenario = keys[:-2]
    buildings = results.groupBy(*scenario).agg(F.count_distinct("building_id").alias("n"))
    rows = of(results, "Energy", aggregation)
    stats = rows.groupBy(*keys).agg(
        F.avg(_value()).alias("avg"),
        F.min(_value()).alias("min"),
        F.max(_value()).alias("max"),
        F.coalesce(F.stddev_samp(_value()), F.lit(0.0)).alias("sd"),
    )
    return with_band(stats, buildings, keys)


def with_band(stats: DataFrame, buildings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Band around ``avg`` from ``sd`` and the number ``n`` of buildings (one row per scenario, broadcast by its size)."""
    scenario = [k for k in keys if k == "scenario"]
    stats = stats.join(buildings, scenario) if scenario else stats.withColumn("n", buildings.select("n").scalar())
    half = F.col("sd") / F.sqrt("n") * CI_FACTOR
    return stats.select(
        *keys, "avg", "min", "max",
        (F.col("avg") - half).alias("ci_low"), (F.col("avg") + half).alias("ci_high"),
    )


def building_eui(results: DataFrame) -> DataFrame:
    """Energy over all end uses and months per building."""
    keys = _with_scenario(results, "building_id")
    return of(results, "Energy", "End Uses").groupBy(*keys).agg(_filled_sum().alias("eui"))


def building_peak(results: DataFrame) -> DataFrame:
    """Highest monthly raw peak per building; buildings without any value are left out."""
    keys = _with_scenario(results, "building_id")
    peaks = of(results, "Peak", "Raw").groupBy(*keys).agg(F.max(_value()).alias("peak"))
    return peaks.where(F.col("peak").isNotNull())


def stock_totals(results: DataFrame, aggregation: str) -> DataFrame:
    """Energy of the whole stock per meter, meters above 1 % of the total only."""
    keys = _with_scenario(results, "meter")
    return major(of(results, "Energy", aggregation).groupBy(*keys).agg(_filled_sum().alias("total")), keys)


def major(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals (one row per scenario and meter) above 1 % of their scenario's sum."""
    overall = F.sum("total").over(Window.partitionBy(*keys[:-1]))
    return (
        totals.withColumn("_all", overall)
        .where((F.col("_all") != 0) & (F.col("total") > F.col("_all") * MINOR_SHARE))
        .drop("_all")
    )


def meter_totals(results: DataFrame) -> DataFrame:
    """Per building and meter: Energy / End Uses, and Peak / Utilities summed over months."""
    energy = (F.col("measurement") == "Energy") & (F.col("aggregation") == "End Uses")
    peak = (F.col("measurement") == "Peak") & (F.col("aggregation") == "Utilities")
    rows = results.where(energy | peak)
    return rows.groupBy(*_with_scenario(results, "building_id", "measurement", "meter")).agg(_filled_sum().alias("total"))


def meter_names(results: DataFrame, aggregation: str) -> DataFrame:
    """Distinct meters with a monthly series, in order."""
    keys = _with_scenario(results, "meter")
    return of(results, "Energy", aggregation).select(*keys).distinct().orderBy(*keys)


# --- joins ----------------------------------------------------------------------------------


def with_locations(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Inner join on building_id with complete location rows."""
    require_columns(df, ("building_id",))
    require_columns(locations, ("building_id", "lat", "lon"))
    known = locations.select("building_id", "lat", "lon").dropna()
    known = known.where(~F.isnan("lat") & ~F.isnan("lon"))
    return df.join(known, "building_id")


def _change(base: Column, other: Column) -> Column:
    return F.try_divide(other - base, base) * 100


def compare_scenarios(baseline: DataFrame, comparison: DataFrame, metric: str) -> DataFrame:
    """Percent change per building; NULL for a zero baseline.  Duplicate ids multiply."""
    for df in (baseline, comparison):
        require_columns(df, ("building_id", metric))
    a = baseline.select("building_id", F.col(metric).alias("baseline_value"))
    b = comparison.select("building_id", F.col(metric).alias("comparison_value"))
    return a.join(b, "building_id").withColumn(
        "percent_change", _change(F.col("baseline_value"), F.col("comparison_value"))
    )


def compare_eui(results: DataFrame, baseline: str, comparison: str) -> DataFrame:
    """EUI comparison of two scenarios of one table in a single pass and a single shuffle.

    Equals ``compare_scenarios`` on the two EUI tables, without reading the results twice.
    """
    rows = of(results, "Energy", "End Uses").where(F.col("scenario").isin(baseline, comparison))

    def part(name: str) -> list[Column]:
        inside = F.col("scenario") == name
        return [
            F.coalesce(F.sum(F.when(inside, _value())), F.lit(0.0)),
            F.count(F.when(inside, F.lit(1))),
        ]

    base, other = part(baseline), part(comparison)
    both = rows.groupBy("building_id").agg(
        base[0].alias("baseline_value"),
        other[0].alias("comparison_value"),
        base[1].alias("_n0"),
        other[1].alias("_n1"),
    )
    return (
        both.where("_n0 > 0 and _n1 > 0")
        .withColumn("percent_change", _change(F.col("baseline_value"), F.col("comparison_value")))
        .drop("_n0", "_n1")
    )


def retrofit_savings(comparison: DataFrame) -> DataFrame:
    """One row of stock totals over a scenario comparison."""
    base, other = F.sum("baseline_value"), F.sum("comparison_value")
    return comparison.agg(
        F.count(F.lit(1)).alias("n_buildings"),
        base.alias("baseline_total"),
        other.alias("retrofit_total"),
        (base - other).alias("saving"),
        (F.try_divide(base - other, base) * 100).alias("saving_percent"),
        F.avg("percent_change").alias("mean_percent_change"),
    )


def building_metric(
    results: DataFrame,
    metric: str,
    column: str | None = None,
    baseline: str | None = None,
    comparison: str | None = None,
    aggregation: str = "End Uses",
) -> DataFrame:
    """(building_id, value) for a named metric, with the scenario where there is one.

    Energy counts under one aggregation: end uses and utilities are the same energy seen twice.
    """
    keys = _with_scenario(results, "building_id")
    if metric == "energy_usage":
        return of(results, "Energy", aggregation).groupBy(*keys).agg(_filled_sum().alias("value"))
    if metric == "eui":
        return building_eui(results).withColumnRenamed("eui", "value")
    if metric == "peak_power":
        return building_peak(results).withColumnRenamed("peak", "value")
    if metric == "percent_change":
        if baseline is None or comparison is None:
            raise ValidationError("percent_change needs two scenarios")
        return compare_eui(results, baseline, comparison).select(
            "building_id", F.col("percent_change").alias("value")
        )
    if metric == "custom":
        require_columns(results, (column,))
        return results.select(*keys, F.col(column).cast("double").alias("value"))
    raise ValidationError(f"unknown metric {metric!r}; known: {METRICS}")


# --- reshape --------------------------------------------------------------------------------


def wide_to_long(wide: DataFrame, keys: Sequence[str] = ("building_id",)) -> DataFrame:
    """Wide columns ``Measurement|Aggregation|Meter|Month`` to rows; missing cells stay, as NULL."""
    values = [c for c in wide.columns if c not in keys and c.count(SEPARATOR) == len(RESULT_LEVELS) - 1]
    typed = wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    rows = typed.unpivot(list(keys), [F.col(f"`{c}`") for c in values], "_name", "value")
    parts = F.split("_name", r"\|")
    columns = [parts[i].alias(level) for i, level in enumerate(RESULT_LEVELS[:-1])]
    return rows.select(*keys, *columns, parts[3].cast("int").alias("month"), _value().alias("value"))


def wide_name(levels: Sequence[str] = RESULT_LEVELS) -> Column:
    return F.concat_ws(SEPARATOR, *[F.col(c).cast("string") for c in levels])


def _spread(results: DataFrame, names: Sequence[str], keys: Sequence[str], name: Column) -> DataFrame:
    """One row per key with the value of each of ``names`` as a column; two values for one cell stop the job.

    A key's cells are gathered as a short list and laid out afterwards, so that no task holds the wide rows of many
    keys, as a pivot does.
    """
    place = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)])
    cell = F.struct(F.try_element_at(place, name).alias("at"), F.col("value").cast("double").alias("value"))
    listed = results.select(*keys, cell.alias("_cell")).groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_cell.at").isNotNull() & F.col("_cell.value").isNotNull(), F.col("_cell"))).alias("_cells")
    )
    clash = F.raise_error(F.lit("two values for one cell: a key is missing")).cast("map<int,double>")
    alone = F.size(F.array_distinct(F.col("_cells.at"))) == F.size("_cells")
    laid = listed.select(*keys, F.when(alone, F.map_from_entries("_cells")).otherwise(clash).alias("_cells"))
    return laid.select(*keys, *[F.try_element_at("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def long_to_wide(results: DataFrame, names: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Rows to the given wide columns, one row per key (by default building and scenario)."""
    keys = _with_scenario(results, "building_id") if keys is None else keys
    return _spread(results, names, keys, wide_name())


def month_rows(results: DataFrame, names: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Month becomes rows, the other levels become the given columns ``Measurement|Aggregation|Meter``."""
    keys = _with_scenario(results, "building_id") if keys is None else keys
    return _spread(results, names, [*keys, "month"], wide_name(RESULT_LEVELS[:-1]))


def sheet_label() -> Column:
    """Name of a split export: measurement and aggregation without spaces."""
    return F.concat_ws("_", F.replace("measurement", F.lit(" "), F.lit("")), F.replace("aggregation", F.lit(" "), F.lit("")))


def attach_building_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Prepend building key columns to a result table, keeping its own index columns."""
    extra = [c for c in keys.columns if c != "building_id"]
    rest = [c for c in table.columns if c != "building_id"]
    return table.join(keys, "building_id").select("building_id", *[F.col(f"`{c}`") for c in extra + rest])
