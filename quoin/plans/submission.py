"""From preprocessed buildings to batches of specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators import ordering
from quoin.operators.checks import ValidationError
from quoin.operators.components import missing_components
from quoin.operators.specs import building_specs
from quoin.session import durable


def submission(
    buildings: DataFrame,
    db_file: str,
    fields_file: str,
    component_map_file: str,
    library: DataFrame | None = None,
    source_fields: Sequence[str] = (),
    drop_gaps: bool = False,
    sample: int | None = None,
    per_batch: int | None = None,
) -> DataFrame:
    """Specifications with provenance and ``batch_id``, batched by payload size or ``per_batch`` at a time.

    ``library`` must cover the ``source_fields`` of every building: otherwise the plan raises, or leaves such
    buildings out with ``drop_gaps``.  ``sample`` takes that many buildings, reproducibly.
    """
    if library is not None:
        keyed = buildings.withColumns({f: F.col(f"context.{f}") for f in source_fields})
        if drop_gaps:
            buildings = keyed.join(library.select(*source_fields).distinct(), list(source_fields), "left_semi").drop(*source_fields)
        elif not missing_components(keyed, library, source_fields).isEmpty():
            raise ValidationError(f"the library misses combinations of {tuple(source_fields)}")
    if sample is not None:
        buildings = ordering.sample_rows(buildings, sample)
    specs = building_specs(buildings, db_file, fields_file, component_map_file)
    if per_batch is None:
        return ordering.assign_batches(specs)
    # Stored, since rows are counted, then numbered.
    specs = durable(specs)
    return ordering.add_row_index(specs, target="_at").withColumn("batch_id", F.floor(F.col("_at") / per_batch)).drop("_at")
