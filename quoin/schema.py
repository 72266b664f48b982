"""Declared column types, status values and field specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
POLYGON = T.ArrayType(RING)
MULTIPOLYGON = T.ArrayType(POLYGON)

# The status vocabulary shared by basements and attics.
STATUSES = (
    "none",
    "unoccupied_unconditioned",
    "unoccupied_conditioned",
    "occupied_unconditioned",
    "occupied_conditioned",
)
OCCUPIED = ("occupied_unconditioned", "occupied_conditioned")
CONDITIONED = ("occupied_conditioned", "unoccupied_conditioned")
UNOCCUPIED = tuple(s for s in STATUSES if s not in OCCUPIED)
UNCONDITIONED = tuple(s for s in STATUSES if s not in CONDITIONED)

# Key columns of a results table, outermost first.
RESULT_LEVELS = ("measurement", "aggregation", "meter", "month")

RESULTS = T.StructType(
    [
        T.StructField("building_id", T.StringType(), False),
        T.StructField("scenario", T.StringType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("aggregation", T.StringType()),
        T.StructField("meter", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

STATIONS = T.StructType(
    [
        T.StructField("station_id", T.StringType(), False),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)

# Feature names kept when a result index is cut down to its essentials.
INDEX_FEATURES = (
    "feature.geometry.long_edge",
    "feature.geometry.short_edge",
    "feature.geometry.orientation",
    "feature.geometry.num_floors",
    "feature.geometry.energy_model_conditioned_area",
    "feature.geometry.energy_model_occupied_area",
    "feature.semantic.Typology",
    "feature.semantic.Age_bracket",
    "feature.semantic.Region",
    "feature.weather.file",
    "feature.geometry.wwr",
    "feature.geometry.f2f_height",
    "feature.geometry.attic_height",
)

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


@dataclass(frozen=True)
class FieldSpec:
    """One semantic field: either a list of options or a closed numeric range."""

    name: str
    options: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None

    @property
    def kind(self) -> str:
        if self.options is not None:
            return "categorical"
        if self.minimum is not None or self.maximum is not None:
            return "numeric"
        raise ValueError(f"field {self.name!r} has neither options nor a numeric range")

    def levels(self, steps: int) -> list:
        """The values this field takes in a parameter grid."""
        if self.kind == "categorical":
            return list(self.options)
        if self.minimum is None or self.maximum is None:
            raise ValueError(f"field {self.name!r} needs both bounds to be discretised")
        if steps < 2:
            return [float(self.minimum)]
        width = (self.maximum - self.minimum) / (steps - 1)
        return [self.minimum + i * width for i in range(steps)]
