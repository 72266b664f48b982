"""Selecting library components for buildings by their source fields.

The library is keyed by field combinations, so lookups are plain equi-joins; Spark broadcasts the
library only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_component(
    buildings: DataFrame, library: DataFrame, source_fields: Sequence[str], attributes: Sequence[str]
) -> DataFrame:
    """Left join of one component's attributes; buildings without a match keep NULLs."""
    return buildings.join(library.select(*source_fields, *attributes), list(source_fields), "left")


def lookup_components(
    buildings: DataFrame, selections: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]
) -> DataFrame:
    """Several components in turn: name -> (library, source fields, attributes)."""
    for library, source_fields, attributes in selections.values():
        buildings = lookup_component(buildings, library, source_fields, attributes)
    return buildings


def missing_components(
    buildings: DataFrame, library: DataFrame, source_fields: Sequence[str], component: str = "component"
) -> DataFrame:
    """Field combinations in use that the library does not cover, with the buildings concerned.

    The buildings are reduced to their combinations before the anti-join.
    """
    needed = buildings.groupBy(*source_fields).agg(F.count(F.lit(1)).alias("n_buildings"))
    gaps = needed.join(library.select(*source_fields), list(source_fields), "left_anti")
    return gaps.select(F.lit(component).alias("component"), *source_fields, "n_buildings")
