"""Building locations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.arrow import measures, moved_point
from quoin.sources.footprints import read_geoparquet, srid_of


def locations(df: DataFrame, geom_col: str = "geom", srid: int | None = None) -> DataFrame:
    """``lat``/``lon`` as double where a row has both, else the footprint centroid in degrees; NaN is a missing value.

    Both values of a row come from the same source.  The geometry's system is ``srid``, or the one recorded on
    it, or degrees.  Geometry is dropped.
    """
    given = [F.col(c).cast("double") if {"lat", "lon"} <= set(df.columns) else F.lit(None).cast("double") for c in ("lat", "lon")]
    known = given[0].isNotNull() & given[1].isNotNull() & ~F.isnan(given[0]) & ~F.isnan(given[1])
    if geom_col in df.columns:
        source = srid or srid_of(df, geom_col) or 4326
        df = df.withColumn("_c", measures(F.col(geom_col)))
        df = df.withColumn("_c", moved_point(F.col("_c.x"), F.col("_c.y"), source, 4326) if source != 4326 else F.col("_c"))
        fallback = [F.col("_c.y"), F.col("_c.x")]
    else:
        fallback = [F.lit(None).cast("double")] * 2
    columns = {c: F.when(known, g).otherwise(f) for c, g, f in zip(("lat", "lon"), given, fallback, strict=True)}
    return df.withColumns(columns).drop("_c", geom_col, "geom_type")


def load_locations(spark: SparkSession, path: str) -> DataFrame | None:
    """Locations from a footprint file; None when the file is missing."""
    try:
        return locations(read_geoparquet(spark, path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
