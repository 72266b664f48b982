"""Feature records of a whole stock, what the neighbours shade included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from quoin.config import PreprocessConfig
from quoin.operators import neighbors, shading, specs


def shaded_feature_table(cleaned: DataFrame, config: PreprocessConfig, semantic: Mapping[str, str] | Sequence[str], seed: str = "0") -> DataFrame:
    """``feature_table`` with the 48 columns of the shading mask.

    ``cleaned`` is used twice: hand in a stored table.  Neighbour edges go straight to 48 maxima per building; no
    neighbour lists are built.  Buildings without neighbours have a mask of zeros.
    """
    edges = neighbors.neighbor_edges(cleaned, config.neighbor_threshold, config.default_height, config.f2f_height)
    masks = shading.shading_mask(cleaned, edges)
    return specs.feature_table(cleaned.join(masks, "building_id"), semantic, "mask", seed)
