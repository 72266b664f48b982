"""Keeping preprocessed buildings up to date.

A footprint table changes a little at a time, and a building's record depends on its own row, on the buildings
within the neighbour radius and on the stations.  So after a change only the changed rows are assessed again, and
only buildings in reach of a place where something changed, old or new, get new neighbours.  Everything else is
taken over from the last version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.config import PreprocessConfig
from quoin.functions.geometry import with_oriented_box
from quoin.operators import checks, clean
from quoin.plans.preprocess import Columns, assess, enrich, stored_assessment
from quoin.schema import FieldSpec
from quoin.session import Scratch, durable
from quoin.sources import runs
from quoin.sources.footprints import keep_srid, srid_of

_ASSESSED, _BUILDINGS = "Assessed", "Buildings"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh leaves: the current tables, their version, and the ids that were worked out anew."""

    buildings: DataFrame
    report: DataFrame
    version: str
    #: (building_id, change) of rows that are new, changed or gone; None after a full run.
    changed: DataFrame | None
    #: (building_id) of buildings that were worked out anew, also those that ``only_in_reach`` leaves out; None after a full run.
    renewed: DataFrame | None


def with_digest(rows: DataFrame) -> DataFrame:
    """Column ``_digest`` of everything a row holds, whatever the order of its columns."""
    named = F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns) if c != "_digest"))
    return rows.withColumn("_digest", F.sha2(F.to_json(named), 256))


def table_digest(rows: DataFrame) -> str:
    """One text for the content of a table, whatever the order of its rows: their number and the sum of their digests."""
    part = F.conv(F.substring("_digest", 1, 15), 16, 10).cast("decimal(38,0)")
    found = with_digest(rows).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("total")).first()
    return f"{found['n']}-{found['total']}"


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(building_id, change) between two tables of (building_id, _digest): added, changed or removed."""
    old = before.select("building_id", F.col("_digest").alias("_old"))
    both = now.select("building_id", "_digest").join(old, "building_id", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_digest").isNull(), "removed").when(F.col("_digest") != F.col("_old"), "changed")
    return both.select("building_id", change.alias("change")).where(F.col("change").isNotNull())


def in_cells(buildings: DataFrame, reach: float) -> DataFrame:
    """``buildings`` with the grid cell of their box's middle."""
    size = max(reach, 1e-3) * 1.001  # rounding can't put two buildings in reach two cells apart
    boxed = with_oriented_box(buildings)
    return boxed.withColumns({"cell_x": F.floor(F.col("box.cx") / size), "cell_y": F.floor(F.col("box.cy") / size)}).drop("box")


def cells_around(cells: DataFrame, rings: int) -> DataFrame:
    """Cells at most ``rings`` away from given ones."""
    steps = range(-rings, rings + 1)
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps))
    moved = cells.select("cell_x", "cell_y").distinct().withColumn("_o", F.explode(offsets))
    return moved.select((F.col("cell_x") + F.col("_o.i")).alias("cell_x"), (F.col("cell_y") + F.col("_o.j")).alias("cell_y")).distinct()


def refresh(
    path: str,
    footprints: DataFrame,
    stations_table: DataFrame,
    config: PreprocessConfig,
    srid: int | None,
    fields: Sequence[FieldSpec],
    columns: Columns,
    inputs: Sequence[object],
    scenario: str | None = None,
    weather_file: str | None = None,
    strict: bool = True,
    stations_srid: int | None = None,
    only_in_reach: bool = False,
) -> Refreshed:
    """Buildings as ``preprocess`` makes them from ``footprints``, reusing the last version below ``path``.

    Versions are kept apart by a key over the settings, everything else that decides the result, the content of
    the stations, and ``inputs``: whatever the caller knows to matter besides (a file version, say; it may be
    empty).  The first run of a key works out everything.  Later runs compare a digest of every row: an id is
    matched by its text, so ids must be there and unique.  Each run publishes a new version in one step, also
    where nothing changed; readers of older versions aren't disturbed, and a run that fails leaves none.
    """
    spark = footprints.sparkSession
    srid = checks.require_srid(srid_of(footprints) if srid is None else srid, config.metric_srid)
    names = [f.name for f in fields]
    parts = [config.fingerprint(), srid, *fields, columns, scenario, weather_file, strict, stations_srid, only_in_reach, table_digest(stations_table), *inputs]
    key = hashlib.sha256("\n".join(map(repr, parts)).encode()).hexdigest()[:16]
    rows = checks.restore_truncated_names(footprints, [*names, *astuple(columns)])
    checks.require_columns(rows, [columns.id])
    rows = keep_srid(with_digest(rows).withColumn("building_id", F.col(columns.id).cast("string")), srid)

    def finish(assessed: DataFrame, buildings: DataFrame, changed: DataFrame | None, renewed: DataFrame | None) -> Refreshed:
        version = runs.publish(spark, path, key, {_ASSESSED: assessed, _BUILDINGS: buildings})
        stored, report = (runs.load_published(spark, path, key, name, version) for name in (_BUILDINGS, _ASSESSED))
        return Refreshed(stored, clean.drop_report(report, stored if only_in_reach else None), version, changed, renewed)

    def enriched(cleaned: DataFrame, around: DataFrame | None = None) -> DataFrame:
        cleaned = cleaned.drop("_digest")
        return enrich(cleaned, config, stations_table, names, weather_file, stations_srid, strict, around, only_in_reach)

    versions = runs.published_versions(spark, path, key)
    if not versions:
        assessed = stored_assessment(assess(rows, config, srid, columns, scenario, fields), fields, strict)
        if not strict:
            checks.require_ids(assessed)
        return finish(assessed, enriched(clean.kept(assessed)), None, None)

    before = runs.load_published(spark, path, key, _ASSESSED, versions[-1])
    made = runs.load_published(spark, path, key, _BUILDINGS, versions[-1])
    checks.require_ids(rows.select("building_id"))
    with Scratch(spark) as scratch:
        changed = scratch.table(changes(before, rows))
        gone = changed.select("building_id")
        # Only these rows go to the shape step.
        fresh = scratch.table(rows.join(changed.where("change != 'removed'").select("building_id"), "building_id", "left_semi"))
        if fresh.isEmpty():
            anew = before.limit(0)
        else:
            anew = scratch.table(assess(fresh, config, srid, columns, scenario, fields))
            if strict:
                checks.require_empty(checks.field_violations(anew, fields))
        assessed = before.join(gone, "building_id", "left_anti").unionByName(anew)
        # Where something changed: places of the rows that went and of those that came.
        moved = clean.kept(before.join(gone, "building_id", "left_semi")).select("building_id", "rect")
        moved = moved.unionByName(clean.kept(anew).select("building_id", "rect"))
        reach = config.neighbor_threshold + 1e-6
        spots = scratch.table(in_cells(moved, reach).select("cell_x", "cell_y").distinct())
        located = in_cells(clean.kept(assessed), reach)
        # Two rings hold the neighbours of buildings in one ring.
        around = scratch.table(located.join(cells_around(spots, 2), ["cell_x", "cell_y"], "left_semi"))
        near = around.join(cells_around(spots, 1), ["cell_x", "cell_y"], "left_semi").drop("cell_x", "cell_y")
        near = scratch.table(near)
        renewed = near.select("building_id")
        kept = made.join(gone.unionByName(renewed), "building_id", "left_anti")
        buildings = kept.unionByName(enriched(near, around.drop("cell_x", "cell_y")))
        if strict and clean.kept(assessed).isEmpty():
            raise checks.ValidationError("every building was dropped")
        changed_out, renewed_out = durable(changed), durable(renewed)
        return finish(assessed, buildings, changed_out, renewed_out)
