"""Distribution summaries of one numeric column, for the whole table or for each of several groups side by side.

``keys`` names the columns of a group, such as the scenario; rows without one of them are in no group.  What holds for
a whole group (its axis, its quantiles) is a table of one row per group that is joined by the keys; without keys it is
one row, used as a scalar subquery.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.geometry import bound
from quoin.operators.checks import require_columns
from quoin.schema import NUMERIC_TYPES
from quoin.session import Scratch, durable

# Intervals of a rounded axis, wanted histogram bins, density grid steps, divisor of the
# axis length that gives the density bandwidth.
AXIS_TICKS = 10
HISTOGRAM_BINS = 25
DENSITY_STEPS = 200
BANDWIDTH_DIVISOR = 40
#: Parts in which a pass of the quantile search cuts an interval, and terms of the density's expansion.
BUCKETS = 4096
MOMENTS = 18


def finite(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value) of the rows where the column is a finite number and no key is missing."""
    value = F.col(column).cast("double")
    rows = df.select(*keys, value.alias("value")).where(~F.isnan("value") & (F.abs("value") < F.lit(math.inf)))
    return rows.dropna(subset=list(keys)) if keys else rows


def _attached(rows: DataFrame, groups: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``rows`` with a column of their group's row."""
    if keys:
        return rows.join(groups.select(*keys, column), list(keys))
    return rows.withColumn(column, groups.select(column).scalar())


# --- exact quantiles ------------------------------------------------------------------------


def quantiles(values: DataFrame, probabilities: Sequence[float], keys: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles (linear between ranks) of column ``value``, one row per group: keys, q0, q1, ...

    Eager.  Every wanted rank has an interval that holds it, at first the group's whole range.  A pass over the values
    counts those of each interval in ``buckets`` parts of it (by ratio where it spans many sizes, else by width) and
    notes the smallest and largest of each part; the part that holds the rank is the next interval.  It ends at a
    single value, after two or three passes as a rule.  So a task keeps a fixed number of counters however many values
    there are, all groups and ranks share the passes, and no values are ever sorted.  Without a value no group appears
    (without keys: one row of NULLs).
    """
    spark, keys = values.sparkSession, list(keys)
    none = [F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probabilities))]
    with Scratch(spark) as scratch:
        stored = scratch.table(values.select(*keys, F.col("value").cast("double").alias("value")).dropna())
        ends = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where("n > 0")
        ranks = F.array(*(F.struct(F.lit(i).alias("which"), F.lit(side).alias("side"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities) for side in (0, 1)))
        at = F.col("r.p") * (F.col("n") - 1)
        wanted = ends.withColumn("r", F.explode(ranks)).select(
            *keys, "r.which", "r.side", F.when(F.col("r.side") == 0, F.floor(at)).otherwise(F.ceil(at)).alias("rank"), (at - F.floor(at)).alias("weight"), "low", "high"
        )
        wanted = scratch.table(wanted)
        while not (open_ := wanted.where("low < high")).isEmpty():
            inside = [*keys, "low", "high"]
            spans = open_.select(*inside).distinct()
            if keys:
                placed = stored.join(spans, keys)
            else:  # a few rows, known by now
                known = [F.struct(F.lit(r["low"]).alias("low"), F.lit(r["high"]).alias("high")) for r in spans.collect()]
                placed = stored.select("value", F.explode(F.array(*known)).alias("s")).select("value", "s.*")
            placed = placed.where(F.col("value").between(F.col("low"), F.col("high")))
            parts = placed.groupBy(*inside, _part(buckets).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
            upto = Window.partitionBy(*inside).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
            parts = scratch.table(parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))
            left = F.col("rank") - F.col("before")
            next_ = open_.join(parts, inside).where((left >= 0) & (left < F.col("n")))
            next_ = next_.select(*keys, "which", "side", left.alias("rank"), "weight", F.col("least").alias("low"), F.col("most").alias("high"))
            wanted = scratch.table(wanted.where("low >= high").unionByName(next_))
        found = durable(wanted.select(*keys, "which", "side", "weight", F.col("low").alias("value")))
    value = lambda i, side: F.max(F.when((F.col("which") == i) & (F.col("side") == side), F.col("value")))
    weight = lambda i: F.max(F.when(F.col("which") == i, F.col("weight")))
    lines = [(value(i, 0) + (value(i, 1) - value(i, 0)) * weight(i)).alias(f"q{i}") for i in range(len(probabilities))]
    return found.groupBy(*keys).agg(*(lines or none)) if keys else found.agg(*lines)


def _part(buckets: int) -> Column:
    """Number of the part of [low, high] in which ``value`` lies; grows with the value.

    The ends lie in the first and the last part, so an interval always shrinks.
    """
    v, low, high = (F.col(c) for c in ("value", "low", "high"))
    ratio = F.when((low > 0) & (high > low * 4), F.log(v / low) / F.log(high / low)).when((high < 0) & (low < high * 4), 1 - F.log(v / high) / F.log(low / high))
    share = F.coalesce(ratio, (v / 2 - low / 2) / (high / 2 - low / 2))
    return F.when(v <= low, 0).when(v >= high, buckets - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(share * buckets)))).cast("int")


def describe(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: count, mean, median, min and max of the finite values."""
    values = finite(df, column, keys)
    median = quantiles(values, [0.5], keys).withColumnRenamed("q0", "median")
    sums = values.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return _attached(sums, median, "median", keys)


# --- axis, histogram, density ---------------------------------------------------------------


def _tick(span: Column, count: int) -> Column:
    """struct(m, d): a step m / d of 1, 2 or 5 times a power of ten that cuts ``span`` into about
    ``count``.  One of m and d is 1, so that a tick is index * m / d with a single rounding."""

    def scaled(raw: Column) -> Column:
        return bound(F.floor(F.log10(raw)), lambda power: step(raw, power))

    def step(raw: Column, power: Column) -> Column:
        lead = raw / F.pow(F.lit(10.0), power)
        factor = (
            F.when(lead >= math.sqrt(50), 10.0)
            .when(lead >= math.sqrt(10), 5.0)
            .when(lead >= math.sqrt(2), 2.0)
            .otherwise(1.0)
        )
        return F.struct(
            F.when(power < 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), power) * factor).alias("m"),
            F.when(power < 0, F.pow(F.lit(10.0), -power) / factor).otherwise(F.lit(1.0)).alias("d"),
        )

    return F.when(span > 0, bound(span / count, scaled))


def _rounded_out(a: Column) -> Column:
    """struct(low, high) moved outwards to the ticks of its own range; a single point stays."""

    def widen(t: Column) -> Column:
        low = F.floor(a["low"] * t["d"] / t["m"]) * t["m"] / t["d"]
        high = F.ceil(a["high"] * t["d"] / t["m"]) * t["m"] / t["d"]
        return F.struct(F.coalesce(low, a["low"]).alias("low"), F.coalesce(high, a["high"]).alias("high"))

    return bound(_tick(a["high"] - a["low"], AXIS_TICKS), widen)


def axis(values: DataFrame, rounds: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group with ``axis``: struct(low, high), the range rounded outwards until it settles."""
    row = values.groupBy(*keys).agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("axis"))
    out = F.col("axis")
    for _ in range(rounds):
        out = bound(out, _rounded_out)
    return row.select(*keys, out.alias("axis"))


def _bin_frame(a: Column, bins: int) -> Column:
    """struct(low, high, m, d, first, top): axis, bin step, index of the first inner edge, last bin."""

    def frame(t: Column) -> Column:
        first = F.floor(a["low"] * t["d"] / t["m"]) + 1
        last = F.ceil(a["high"] * t["d"] / t["m"]) - 1
        top = F.coalesce(F.greatest(last - first + 1, F.lit(0)), F.lit(0))
        return F.struct(
            a["low"].alias("low"), a["high"].alias("high"), t["m"].alias("m"), t["d"].alias("d"),
            first.alias("first"), F.when(a["low"].isNotNull(), top).alias("top"),
        )

    return bound(_tick(a["high"] - a["low"], bins), frame)


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, x0, x1, n): bins [x0, x1), the last one closed; empty bins included.

    The axis is rounded outwards; inside it the bin edges are the multiples of a 1/2/5 step.  All
    equal values make one bin, no values none.  Only (bin, count) pairs are shuffled.
    """
    keys = list(keys)
    values = finite(df, column, keys)
    frame = axis(values, keys=keys).select(*keys, bound(F.col("axis"), lambda a: _bin_frame(a, bins)).alias("f"))
    placed = _attached(values, frame, "f", keys)
    cut = F.floor(F.col("value") * F.col("f.d") / F.col("f.m")) - F.col("f.first") + 1
    position = F.coalesce(F.least(F.greatest(cut, F.lit(0)), F.col("f.top")), F.lit(0).cast("bigint"))
    counts = placed.groupBy(*keys, position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    slots = frame.select(*keys, "f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("f.top"))).alias("bin"))

    def edge(index: Column) -> Column:
        return (F.col("f.first") + index) * F.col("f.m") / F.col("f.d")

    inner = F.col("f.m").isNotNull()
    edges = slots.select(
        *keys,
        "bin",
        F.when((F.col("bin") > 0) & inner, edge(F.col("bin") - 1)).otherwise(F.col("f.low")).alias("x0"),
        F.when((F.col("bin") < F.col("f.top")) & inner, edge(F.col("bin"))).otherwise(F.col("f.high")).alias("x1"),
    )
    joined = edges.join(counts, [*keys, "bin"], "left")
    return joined.select(*keys, "bin", "x0", "x1", F.coalesce("n", F.lit(0)).alias("n"))


def kernel_density(df: DataFrame, column: str, steps: int = DENSITY_STEPS, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian density on an even grid over the rounded axis: (keys, step, x, density).

    A fast Gauss transform: the axis is cut into cells of a bandwidth, and a value adds its powers, measured from the
    middle of its cell, to the cell's moments.  The kernel's sum at a grid point follows from the moments by a Hermite
    expansion.  With offsets of at most half a bandwidth, ``MOMENTS`` terms leave out less than 0.5 ** n / sqrt(n!) of
    a kernel's height for each value, under 1e-13 of it.  Moments form in the map tasks, so a task shuffles one row
    for each of about forty cells, and a value is touched once instead of once for each grid point.
    """
    keys = list(keys)
    values = finite(df, column, keys)
    width = F.col("axis.high") - F.col("axis.low")
    frame = axis(values, keys=keys).where(width > 0).select(*keys, F.struct(F.col("axis.low").alias("low"), width.alias("width"), (width / BANDWIDTH_DIVISOR).alias("h")).alias("f"))
    at = (F.col("value") - F.col("f.low")) / F.col("f.h")
    placed = _attached(values, frame, "f", keys).where("f is not null")
    placed = placed.select(*keys, "f", F.floor(at).alias("cell"), ((at - F.floor(at) - 0.5) / math.sqrt(2)).alias("u"))
    powers = [F.lit(1.0)]
    for k in range(1, MOMENTS):
        powers.append(F.pow("u", F.lit(float(k))) / math.factorial(k))
    moments = placed.groupBy(*keys, "f", "cell").agg(F.array(*(F.sum(p) for p in powers)).alias("moments"))
    points = moments.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    x = F.col("f.low") + F.col("step") * (F.col("f.width") / steps)
    t = ((x - F.col("f.low")) / F.col("f.h") - F.col("cell") - 0.5) / math.sqrt(2)
    points = points.withColumns({"x": x, "t": t})

    def next_term(a: Column, k: Column) -> Column:
        """One Hermite function more: h(k + 1) = 2 t h(k) - 2 k h(k - 1)."""
        after = 2 * F.col("t") * a["now"] - 2 * (k - 1) * a["last"]
        return F.struct(a["now"].alias("last"), after.alias("now"), (a["total"] + F.get("moments", k) * after).alias("total"))

    bell = F.exp(-F.col("t") * F.col("t"))
    first = F.struct(F.lit(0.0).alias("last"), bell.alias("now"), (F.col("moments")[0] * bell).alias("total"))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(MOMENTS - 1)), first, next_term)
    scale = math.sqrt(2 * math.pi)
    sums = points.select(*keys, "f", "step", "x", terms["total"].alias("total"), F.col("moments")[0].alias("n"))
    out = sums.groupBy(*keys, "step").agg(F.max("x").alias("x"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("f.h").alias("h"))
    return out.select(*keys, "step", "x", (F.col("total") / (F.col("n") * F.col("h") * scale)).alias("density"))


def category_means(df: DataFrame, column: str, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per group and category, largest first in each group."""
    means = df.groupBy(*keys, F.col(category).alias("category")).agg(F.avg(F.col(column).cast("double")).alias("mean"))
    return means.orderBy(*keys, F.desc("mean"), "category")


def positive_shares(totals: DataFrame, value: str = "total") -> DataFrame:
    """Adds ``share``: percent of the sum of the positive entries; others are left out.

    For small summary tables (one row per scenario and meter); shares are within a scenario.
    """
    rows = totals.where(F.col(value) > 0)
    within = Window.partitionBy(*(["scenario"] if "scenario" in totals.columns else []))
    return rows.withColumn("share", F.col(value) / F.sum(value).over(within) * 100)


def _shown(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a position, a value and all keys."""
    require_columns(df, ("lat", "lon", column))
    return df.dropna(subset=["lat", "lon", column, *keys]).where(~F.isnan(F.col("lat").cast("double")) & ~F.isnan(F.col("lon").cast("double")) & ~F.isnan(F.col(column).cast("double")))


def clipped_heights(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``display_height``: the column clipped to its group's quantile range and rebased to start at 1.

    Eager, see :func:`quantiles`.  Rows missing position, value or a key are left out.
    """
    value = F.col(column).cast("double")
    rows = _shown(df, column, keys)
    cuts = quantiles(rows.select(*keys, value.alias("value")), [low, high], keys)
    rows = _attached(rows, cuts.select(*keys, F.struct("q0", "q1").alias("_cut")), "_cut", keys)
    clipped = F.least(F.greatest(value, F.col("_cut.q0")), F.col("_cut.q1"))
    # The low quantile is never below the smallest value, so it is the smallest clipped value.
    return rows.withColumn("display_height", clipped - F.col("_cut.q0") + 1.0).drop("_cut")


def view_center(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean position of the rows that ``clipped_heights`` shows, per group."""
    return _shown(df, column, keys).groupBy(*keys).agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))


# --- column discovery -----------------------------------------------------------------------


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns except the excluded ones (case ignored)."""
    skip = {c.lower() for c in exclude}
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name.lower() not in skip
    ]


def categorical_columns(df: DataFrame, max_unique: int = 50) -> DataFrame:
    """Non-numeric columns with 2 to ``max_unique`` distinct values: (column, n_distinct).

    Exact in one pass: a task keeps, for each column, at most ``max_unique + 1`` of its distinct values, since one more
    already decides; so ids cost a bounded set a task and are never shuffled.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    schema = "column string, n_distinct bigint"
    if not names:
        return df.sparkSession.createDataFrame([], schema)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Array] = [pa.array([], pa.string()) for _ in names]
        for batch in batches:
            for k in range(len(names)):
                if len(seen[k]) <= max_unique:
                    here = pc.unique(pa.concat_arrays([seen[k], batch.column(k).cast(pa.string())])).drop_null()
                    seen[k] = here[: max_unique + 1]
        columns = [pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [len(v) for v in seen])), pa.concat_arrays(seen)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "v"])

    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(names)))
    counts = texts.mapInArrow(few, "at int, v string").distinct().groupBy("at").agg(F.count(F.lit(1)).alias("n_distinct"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1)
    return counts.where((F.col("n_distinct") > 1) & (F.col("n_distinct") <= max_unique)).select(named.alias("column"), "n_distinct")


def timestamps_as_text(df: DataFrame, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Every timestamp or date column as text."""
    moments = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    return df.withColumns({c: F.date_format(c, pattern) for c in moments})
