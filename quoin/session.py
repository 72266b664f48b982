"""Session defaults and durable materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quoin", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may do without one and gets a temporary folder; executors of a cluster would each write
    to their own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    Executors may be lost at any time, so expensive intermediates that several steps start from go to
    reliable storage, never to executor disks.  A columnar table also lets later steps read only the
    columns they need, tells Spark its size, and keeps their plans short.
    """
    return _stored(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Durable tables that are deleted when the block ends; what outlives it must be stored by ``durable``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}")
        return _stored(df, self.paths[-1])

    def __exit__(self, *_: object) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
