"""Run catalogue: which runs exist, which table of a run to read, which version is the latest.

A run is a folder holding result tables named ``*.pq``; a table is a file or a folder of part files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.checks import ValidationError

# Fixed value: table preferred over the others of a run.
PREFERRED_TABLE = "Results.pq"
_TABLE = r"^(.*)/([^/]+\.pq)(?:/.*)?$"
_VERSION = r"(?:^|/)v?(\d+)\.(\d+)\.(\d+)(?:/|$)"


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """(path) of every file below ``base``; empty when the folder is missing.

    Contents are not read.  Large trees are listed in parallel.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")
    return files.select("path")


def tables_of(paths: DataFrame, base: str = "") -> DataFrame:
    """(run_id, table, table_path) of the result tables among file paths."""
    root = base.rstrip("/")
    folder, name = F.regexp_extract("path", _TABLE, 1), F.regexp_extract("path", _TABLE, 2)
    found = paths.select(folder.alias("folder"), name.alias("table")).where(F.col("table") != "").distinct()
    inside = F.col("folder")
    if root:
        # Listed paths carry a scheme, the base may not.
        inside = F.expr("substring(folder, locate(root, folder) + length(root) + 1)")
        found = found.withColumn("root", F.lit(root))
    return found.select(
        inside.alias("run_id"), "table", F.concat_ws("/", "folder", "table").alias("table_path")
    )


def list_runs(paths: DataFrame, base: str = "") -> DataFrame:
    """Sorted distinct run ids."""
    return tables_of(paths, base).select("run_id").distinct().orderBy("run_id")


def chosen_tables(paths: DataFrame, base: str = "") -> DataFrame:
    """Per run the table to read: the preferred one, else the first by name."""
    order = F.struct(F.col("table") != PREFERRED_TABLE, "table")
    chosen = F.min_by(F.struct("table", "table_path"), order)
    return tables_of(paths, base).groupBy("run_id").agg(chosen.alias("c")).select("run_id", "c.table", "c.table_path")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """One result table; only ``.pq`` is accepted."""
    if not path.rstrip("/").endswith(".pq"):
        raise ValidationError(f"unsupported table {path!r}")
    return spark.read.parquet(path)


def load_run(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """Result table of one run; unknown runs raise."""
    row = chosen_tables(list_files(spark, base), base).where(F.col("run_id") == run_id).first()
    if row is None:
        raise ValidationError(f"run not found: {run_id}")
    return load_table(spark, row["table_path"])


# --- versions -------------------------------------------------------------------------------


def version_of(path: Column) -> Column:
    """struct(major, minor, patch) of the version segment in a path; NULL without one."""
    numbers = [F.regexp_extract(path, _VERSION, i) for i in (1, 2, 3)]
    names = ("major", "minor", "patch")
    return F.when(
        numbers[0] != "", F.struct(*[n.try_cast("int").alias(k) for n, k in zip(numbers, names)])
    )


def version_text(version: Column) -> Column:
    return F.concat(F.lit("v"), F.concat_ws(".", version["major"], version["minor"], version["patch"]))


def with_versions(paths: DataFrame) -> DataFrame:
    """(run_name, version, table, path); the run name is what precedes the version."""
    return paths.select(
        F.regexp_extract("path", r"^(.*?)/v?\d+\.\d+\.\d+(?:/|$)", 1).alias("run_name"),
        version_of(F.col("path")).alias("version"),
        F.regexp_extract("path", r"([^/]+)\.pq(?:/.*)?$", 1).alias("table"),
        "path",
    ).where(F.col("version").isNotNull())


def latest_versions(paths: DataFrame) -> DataFrame:
    """Highest version per run, compared number by number: (run_name, latest_version)."""
    best = with_versions(paths).groupBy("run_name").agg(F.max("version").alias("v"))
    return best.select("run_name", version_text(F.col("v")).alias("latest_version"))


def next_versions(paths: DataFrame) -> DataFrame:
    """Version of the next publication: minor number up, patch back to zero."""
    best = with_versions(paths).groupBy("run_name").agg(F.max("version").alias("v"))
    bumped = F.struct(F.col("v.major").alias("major"), (F.col("v.minor") + 1).alias("minor"), F.lit(0).alias("patch"))
    return best.select("run_name", version_text(bumped).alias("next_version"))


def load_published(
    spark: SparkSession, base: str, run_name: str, table: str = "Results", version: str | None = None
) -> DataFrame:
    """One table of a published run: the given version, else the latest that is whole."""
    listed = with_versions(tables_of(list_files(spark, f"{base.rstrip('/')}/{run_name}")).select(F.col("table_path").alias("path")))
    rows = listed.select("table", version_text(F.col("version")).alias("name"), "version", "path")
    open_ones = unfinished_versions(spark, base, run_name)
    if open_ones:  # the writers at work just now, and those that died
        rows = rows.where(~F.col("name").isin(*open_ones))
    if version is not None:
        rows = rows.where(F.col("name") == "v" + version.removeprefix("v"))
    # The newest version first; inside it the wanted table must exist.
    newest = rows.agg(F.max("version").alias("v")).first()["v"]
    if newest is None:
        raise ValidationError(f"no version found for {run_name}")
    wanted = f"v{newest['major']}.{newest['minor']}.{newest['patch']}"
    hit = rows.where((F.col("name") == wanted) & (F.col("table") == table)).first()
    if hit is None:
        raise ValidationError(f"table {table!r} not found in {run_name} {wanted}")
    return load_table(spark, hit["path"])


# --- publishing -----------------------------------------------------------------------------

# Names that listings of tables pass over: what is being written, claimed numbers, and the mark of a whole version.
_STAGING, _CLAIMS, _DONE = ".staging-", "_claims", "_PUBLISHED"


def _files(spark: SparkSession, path: str):
    """(path, its file system) of the Hadoop layer."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where it is missing."""
    where, files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def _create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there: of several writers at once, exactly one gets True.

    Stores do this in one step; for the local file system only Java's own call does.
    """
    where, files = _files(spark, path)
    files.mkdirs(where.getParent())
    jvm = spark.sparkContext._jvm
    try:
        if files.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(where.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            files.create(where, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or files.exists(where):
            return False
        raise
    return True


def _numbers(names: Iterable[str]) -> list[tuple[int, int, int]]:
    found = (re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)", n) for n in names)
    return sorted(tuple(map(int, m.groups())) for m in found if m)


def publish(spark: SparkSession, base: str, run_name: str, tables: Mapping[str, DataFrame], part: str = "minor") -> str:
    """Write tables as the run's next version and return its name, such as ``v0.2.0``.

    Everything is written to a staging folder first.  Then the writer claims the number after the highest one by
    creating a file that must not exist yet; who loses takes the next number.  The staging folder moves to its
    version's place and is marked as whole, so readers never see a part of it, whatever the file system does while
    moving.  A writer that dies leaves a staging folder or an unused number behind, nothing else.
    ``part`` says which number goes up; those behind it go back to zero.
    """
    if part not in ("major", "minor", "patch"):
        raise ValidationError(f"unknown part {part!r} of a version")
    root = f"{base.rstrip('/')}/{run_name}"
    staging = f"{root}/{_STAGING}{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}.pq")
    place = ("major", "minor", "patch").index(part)
    while True:
        taken = _numbers([*_names(spark, root), *_names(spark, f"{root}/{_CLAIMS}")])
        last = taken[-1] if taken else (0, 0, 0)
        number = (*last[:place], last[place] + 1, *(0,) * (2 - place))
        version = "v" + ".".join(map(str, number))
        if _create_new(spark, f"{root}/{_CLAIMS}/{version}"):
            break
    source, files = _files(spark, staging)
    target, _ = _files(spark, f"{root}/{version}")
    if not files.rename(source, target):
        raise ValidationError(f"could not move {staging} to {root}/{version}")
    _create_new(spark, f"{root}/{version}/{_DONE}")
    return version


def unfinished_versions(spark: SparkSession, base: str, run_name: str) -> set[str]:
    """Versions that ``publish`` has claimed and not completed; versions written otherwise count as whole."""
    root = f"{base.rstrip('/')}/{run_name}"
    return {v for v in _names(spark, f"{root}/{_CLAIMS}") if _DONE not in _names(spark, f"{root}/{v}")}


def published_versions(spark: SparkSession, base: str, run_name: str) -> list[str]:
    """Whole versions of a run, lowest first."""
    root = f"{base.rstrip('/')}/{run_name}"
    open_ones = unfinished_versions(spark, base, run_name)
    names = [n for n in _names(spark, root) if _numbers([n]) and n not in open_ones]
    return sorted(names, key=lambda n: _numbers([n])[0])
