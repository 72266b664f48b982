"""Hourly comfort analytics: overheating, degree hours, heat index and exceedance runs.

Hourly form: (building_id, zone, ts, temp_c, rel_humidity), at most one row per zone and hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default temperature limit [deg C] and hours above it that count as overheating.
TEMPERATURE_LIMIT = 26.0
HOURS_LIMIT = 200
# Lower limits of the heat-index categories [deg F].
HEAT_INDEX_CATEGORIES = (
    ("extreme_danger", 125.0),
    ("danger", 103.0),
    ("extreme_caution", 90.0),
    ("caution", 80.0),
)
_KEYS = ("building_id", "zone")
_CHUNK_HOURS = 24 * 28


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch, by the clock of the timestamp."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 24 + F.hour(ts)


def basic_overheating(
    hourly: DataFrame, limit: float = TEMPERATURE_LIMIT, hours_limit: int = HOURS_LIMIT, keys: Sequence[str] = _KEYS
) -> DataFrame:
    """Hours above the limit per zone, and whether they exceed ``hours_limit``."""
    hours = F.count(F.when(F.col("temp_c") > limit, 1))
    out = hourly.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hours"), hours.alias("hours_above"))
    return out.withColumn("overheated", F.col("hours_above") > hours_limit)


def exceedance_degree_hours(
    hourly: DataFrame, limit: float = TEMPERATURE_LIMIT, keys: Sequence[str] = _KEYS
) -> DataFrame:
    excess = F.greatest(F.col("temp_c") - limit, F.lit(0.0))
    return hourly.groupBy(*keys).agg(F.coalesce(F.sum(excess), F.lit(0.0)).alias("degree_hours"))


def heat_index_f(temp_c: Column, rel_humidity: Column) -> Column:
    """Heat index [deg F] by the published weather-service procedure.

    A simple average formula is used while it stays below 80; above that the Rothfusz regression, with
    its corrections for very dry and for very humid air.
    """
    # Coefficients and correction terms of the published procedure.
    t, r = temp_c * 1.8 + 32, rel_humidity
    simple = (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094) * 0.5
    full = (
        -42.379 + t * 2.04901523 + r * 10.14333127 - t * r * 0.22475541 - t * t * 6.83783e-3
        - r * r * 5.481717e-2 + t * t * r * 1.22874e-3 + t * r * r * 8.5282e-4 - t * t * r * r * 1.99e-6
    )
    dry = ((F.lit(13.0) - r) / 4) * F.sqrt(F.greatest((F.lit(17.0) - F.abs(t - 95.0)) / 17, F.lit(0.0)))
    humid = ((r - 85.0) / 10) * ((F.lit(87.0) - t) / 5)
    corrected = (
        F.when((r < 13) & t.between(80, 112), full - dry)
        .when((r > 85) & t.between(80, 87), full + humid)
        .otherwise(full)
    )
    return F.when((simple + t) / 2 < 80, simple).otherwise(corrected)


def heat_index_category(index_f: Column) -> Column:
    out = None
    for name, lowest in HEAT_INDEX_CATEGORIES:
        test = index_f >= lowest
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.when(index_f.isNotNull(), F.lit("normal"))


def heat_index_hours(hourly: DataFrame, keys: Sequence[str] = _KEYS) -> DataFrame:
    """Hours per heat-index category, one column per category."""
    category = heat_index_category(heat_index_f(F.col("temp_c"), F.col("rel_humidity")))
    names = [n for n, _ in HEAT_INDEX_CATEGORIES] + ["normal"]
    rows = hourly.select(*keys, category.alias("category"))
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col("category") == n, 1)).alias(n) for n in names])


def exceedance_runs(
    hourly: DataFrame, limit: float = TEMPERATURE_LIMIT, keys: Sequence[str] = _KEYS
) -> DataFrame:
    """Longest stretches of consecutive hours above the limit: keys, start_hour, hours.

    Runs are first found inside four-week chunks, so that one zone's long record is spread over many
    tasks; the far fewer chunk runs are then merged where one ends and the next begins.
    """
    hot = hourly.where(F.col("temp_c") > limit).select(*keys, hour_number(F.col("ts")).alias("hour"))
    chunked = hot.withColumn("_chunk", F.floor(F.col("hour") / _CHUNK_HOURS))
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy("hour")
    pieces = (
        chunked.withColumn("_island", F.col("hour") - F.dense_rank().over(in_chunk))
        .groupBy(*keys, "_chunk", "_island")
        .agg(F.min("hour").alias("from_hour"), F.max("hour").alias("to_hour"))
    )
    ordered = Window.partitionBy(*keys).orderBy("from_hour")
    starts = F.coalesce(F.col("from_hour") != F.lag("to_hour").over(ordered) + 1, F.lit(True))
    joined = pieces.withColumn("_new", starts.cast("int")).withColumn("_run", F.sum("_new").over(ordered))
    return joined.groupBy(*keys, "_run").agg(
        F.min("from_hour").alias("start_hour"),
        (F.max("to_hour") - F.min("from_hour") + 1).alias("hours"),
    ).drop("_run")


def longest_runs(runs: DataFrame, keys: Sequence[str] = _KEYS) -> DataFrame:
    """Number of runs and the longest one per zone."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.max("hours").alias("longest"))


# --- hourly reshaping -----------------------------------------------------------------------


def hourly_series(hourly: DataFrame, value_col: str = "value") -> DataFrame:
    """Time-ordered values per building, group, meter and year: (…, year, n, first_ts, values).

    The year is part of the key, which bounds a list by the hours of a year.
    """
    item = F.struct("ts", F.col(value_col).alias("v"))
    grouped = hourly.groupBy("building_id", "grp", "meter", F.year("ts").alias("year")).agg(
        F.array_sort(F.collect_list(item)).alias("s")
    )
    return grouped.select(
        "building_id", "grp", "meter", "year",
        F.size("s").alias("n"),
        F.col("s")[0]["ts"].alias("first_ts"),
        F.transform("s", lambda e: e["v"]).alias("values"),
    )


def _only(value_col: str) -> Column:
    """The value of a cell; two values for one cell stop the job."""
    clash = F.raise_error(F.lit("two values for one step: a key is missing")).cast("double")
    return F.when(F.count(value_col) > 1, clash).otherwise(F.max(value_col))


def hourly_wide(hourly: DataFrame, timesteps: Sequence[str], value_col: str = "value") -> DataFrame:
    """One row per (building, group, meter), one column per listed timestep (yyyy-MM-dd HH:mm).

    Two values for one step stop the job; for whole records see :func:`hourly_days`.
    """
    named = hourly.withColumn("_step", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return named.groupBy("building_id", "grp", "meter").pivot("_step", list(timesteps)).agg(_only(value_col))


def hourly_days(hourly: DataFrame, value_col: str = "value", steps_per_hour: int = 1) -> DataFrame:
    """One row per (building, group, meter, day) with ``n`` and ``values``: a slot for every step of the day.

    A value goes to the slot of its time of day, slots without a value are NULL, and two values for one slot stop the
    job.  Slots form in the map tasks: a task shuffles one row of fixed length per day however its rows lie, and no
    list grows with the length of a record or the fineness of its steps.
    """
    slots = 24 * steps_per_hour
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    placed = hourly.select(
        "building_id", "grp", "meter", F.to_date("ts").alias("day"), F.floor(seconds * steps_per_hour / 3600).cast("int").alias("slot"), F.col(value_col).alias("v")
    ).where(F.col("v").isNotNull())
    taken = F.collect_set("slot")  # at most ``slots`` numbers
    days = placed.groupBy("building_id", "grp", "meter", "day").agg(
        F.count(F.lit(1)).alias("n"), F.size(taken).alias("_taken"), F.array(*(F.max(F.when(F.col("slot") == k, F.col("v"))) for k in range(slots))).alias("values")
    )
    clash = F.raise_error(F.lit("two values for one step: a key is missing")).cast("bigint")
    return days.select("building_id", "grp", "meter", "day", F.when(F.col("n") > F.col("_taken"), clash).otherwise(F.col("n")).alias("n"), "values")


def day_columns(days: DataFrame, steps_per_hour: int = 1) -> DataFrame:
    """The slots of :func:`hourly_days` as columns named by the time of day (HH:mm)."""
    minutes = [k * 60 // steps_per_hour for k in range(24 * steps_per_hour)]
    return days.select("building_id", "grp", "meter", "day", "n", *(F.col("values")[k].alias(f"{m // 60:02d}:{m % 60:02d}") for k, m in enumerate(minutes)))
