"""GeoParquet files: binary geometry, its system and bounds in every footer, and boxes that readers can skip by.

Spark's own writer can't add entries to a footer, so this is a data source whose tasks write the files.  Tasks write to
a staging folder and report what they wrote; only what the commit names moves to its place, so a task that runs twice
leaves nothing double, and the bounds of all files are merged there.  Rows can be laid along a curve that keeps
neighbours together, which gives row groups small boxes: a query for a window then reads few of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quoin.functions import wkb
from quoin.operators.checks import ValidationError
from quoin.sources.footprints import keep_srid, read_geoparquet, srid_of

# Names and forms that the format prescribes.
VERSION, FOOTER, GEOMETRY, BOX = "1.1.0", b"geo", "geometry", "bbox"
_SIDES = ("xmin", "ymin", "xmax", "ymax")
#: Rows of a row group.
GROUP_ROWS = 1 << 16
_CURVE_BITS = 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def system(srid: int | None) -> dict | None:
    """The coordinate system of a footer; degrees are the format's default, no srid is an unknown system."""
    if srid is None:
        return None
    kind = "GeographicCRS" if srid == 4326 else "ProjectedCRS"
    return {"type": kind, "name": f"EPSG:{srid}", "id": {"authority": "EPSG", "code": srid}}


def footer(box: Sequence[float] | None, kinds: Sequence[str], srid: int | None) -> bytes:
    """The ``geo`` entry of a file."""
    column = {"encoding": "WKB", "geometry_types": sorted(kinds), "covering": {"bbox": {s: [BOX, s] for s in _SIDES}}}
    if srid != 4326:
        column["crs"] = system(srid)
    if box is not None:
        column["bbox"] = list(box)
    return json.dumps({"version": VERSION, "primary_column": GEOMETRY, "columns": {GEOMETRY: column}}).encode()


def merged(boxes: Sequence[Sequence[float] | None]) -> list[float] | None:
    some = np.array([b for b in boxes if b is not None])
    return [*some[:, :2].min(0).tolist(), *some[:, 2:].max(0).tolist()] if len(some) else None


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written: its name, rows, bounds, geometry types and schema."""

    name: str
    rows: int
    box: list[float] | None
    kinds: list[str]
    schema: bytes


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.geometry, self.srid = options.get("geometry", "geom"), int(options["srid"]) if options.get("srid") else None
        self.group = int(options.get("grouprows", GROUP_ROWS))
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def _columns(self, batch: pa.RecordBatch, seen: list, kinds: set) -> pa.RecordBatch:
        geoms = batch.column(self.geometry).cast(wkb.GEOMETRY)
        box = wkb.boxes(geoms)
        full = np.isfinite(box).all(1)
        if full.any():
            seen.append([*box[full, :2].min(0).tolist(), *box[full, 2:].max(0).tolist()])
        parts = np.asarray(geoms.value_lengths().fill_null(-1))
        kinds.update(name for name, there in (("Polygon", (parts == 1).any()), ("MultiPolygon", ((parts >= 0) & (parts != 1)).any())) if there)
        sides = pa.StructArray.from_arrays([pa.array(box[:, k], pa.float64(), mask=~full) for k in range(4)], _SIDES)
        others = [n for n in batch.schema.names if n not in (self.geometry, GEOMETRY, BOX)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), wkb.encode(geoms), sides], names=[*others, GEOMETRY, BOX])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _opened(self.staging)
        files.create_dir(folder, recursive=True)
        name, writer, rows = f"part-{uuid.uuid4().hex}.parquet", None, 0
        seen: list[list[float]] = []
        kinds: set[str] = set()
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            nonlocal writer, rows
            table = pa.Table.from_batches(held)
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{name}", table.schema, filesystem=files)
            writer.write_table(table, row_group_size=len(table))
            rows += len(table)
            held.clear()

        for batch in iterator:
            for begin in range(0, batch.num_rows, self.group):
                held.append(self._columns(batch.slice(begin, self.group), seen, kinds))
                if sum(b.num_rows for b in held) >= self.group:
                    flush()
        if held:
            flush()
        if writer is None:
            return Written("", 0, None, [], b"")
        box = merged(seen)
        writer.add_key_value_metadata({FOOTER: footer(box, list(kinds), self.srid)})
        writer.close()
        return Written(name, rows, box, sorted(kinds), writer.schema.serialize().to_pybytes())

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.path)
        kept = [m for m in messages if m is not None and m.rows]
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if not old.base_name.startswith("_staging-"):
                    files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        staging = f"{folder}/{self.staging.rsplit('/', 1)[1]}"
        for m in kept:
            files.move(f"{staging}/{m.name}", f"{folder}/{m.name}")
        if kept:
            # What holds for the whole table, for readers that look for it in one place.
            whole = footer(merged([m.box for m in kept]), sorted({k for m in kept for k in m.kinds}), self.srid)
            schema = pa.ipc.read_schema(pa.py_buffer(kept[0].schema))
            pq.write_metadata(schema.with_metadata({FOOTER: whole}), f"{folder}/_common_metadata", filesystem=files)
        self.abort(messages)
        with files.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.staging)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class GeoParquet(DataSource):
    """``df.write.format("geoparquet").option("path", …)``; options: srid, geometry (column), grouprows."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def _spread(value: Column) -> Column:
    """The low bits of a number with a gap behind each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.call_function("shiftleft", value, F.lit(shift))).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def along_curve(df: DataFrame, geom_col: str = "geom") -> DataFrame:
    """The rows in ranges of a Z-order curve over their first vertices, sorted along it; one pass finds the extent."""
    spot = F.col(geom_col)[0][0][0]
    ends = df.agg(*(f(spot[axis]).alias(f"{name}_{axis}") for axis in ("x", "y") for name, f in (("low", F.min), ("high", F.max)))).first()

    def cell(axis: str) -> Column:
        low, high = ends[f"low_{axis}"] or 0.0, ends[f"high_{axis}"] or 0.0
        share = (spot[axis] - low) / (high - low) if high > low else F.lit(0.0)
        return F.coalesce(F.floor(share * (2**_CURVE_BITS - 1)), F.lit(0)).cast("bigint")

    placed = df.withColumn("_curve", _spread(cell("x")).bitwiseOR(F.call_function("shiftleft", _spread(cell("y")), F.lit(1))))
    return placed.repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve")


def write_geoparquet(df: DataFrame, path: str, mode: str = "error", geom_col: str = "geom", group_rows: int = GROUP_ROWS, clustered: bool = True) -> None:
    """Write footprints for any reader of the format: a ``geometry`` column, a ``bbox`` column, ``geo`` in each footer.

    The srid recorded on the geometry goes to the footers.  A null geometry has null sides, a given column named
    ``geometry`` or ``bbox`` is replaced.  ``mode``: error, append or overwrite.  Executors write through Arrow's file
    systems, so the path must be one that both reach.
    """
    if mode not in ("error", "append", "overwrite"):
        raise ValidationError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    if mode == "error":
        files, folder = _opened(path)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            raise ValidationError(f"{path} is there already")
    spark.dataSource.register(GeoParquet)
    srid = srid_of(df, geom_col)
    rows = along_curve(df, geom_col) if clustered else df
    out = rows.write.format("geoparquet").mode("overwrite" if mode == "overwrite" else "append").option("path", path).option("geometry", geom_col).option("grouprows", str(group_rows))
    (out if srid is None else out.option("srid", str(srid))).save()


def window(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float, srid: int | None = None) -> DataFrame:
    """Footprints whose boxes meet a window; row groups whose boxes don't are skipped by the reader."""
    raw = spark.read.parquet(path)
    side = {s: F.col(f"{BOX}.{s}") for s in _SIDES}
    near = (side["xmin"] <= xmax) & (side["xmax"] >= xmin) & (side["ymin"] <= ymax) & (side["ymax"] >= ymin)
    return read_geoparquet(spark, path, srid=srid, rows=raw.where(near))


def srid_of_files(path: str) -> int | None:
    """The srid that ``write_geoparquet`` left for the whole table."""
    files, folder = _opened(path)
    column = json.loads(pq.read_metadata(f"{folder}/_common_metadata", filesystem=files).metadata[FOOTER])["columns"][GEOMETRY]
    crs = column.get("crs", system(4326))
    return None if crs is None else crs["id"]["code"]


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_geoparquet`` wrote, with its srid."""
    return keep_srid(read_geoparquet(spark, path, srid=None), srid_of_files(path))
