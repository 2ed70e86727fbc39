"""Session helpers: the shared work folder and short-lived tables written into it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    """One folder for this process; the session's settings stay as they are."""
    return tempfile.mkdtemp(prefix="parcelry-")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this package wrote, on whatever file system it is."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; nothing if it does not exist."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in system.listStatus(hadoop_path)]


@contextmanager
def no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside remove their shuffle files when they end.

    Else these stay until the driver happens to collect its garbage, and the disks hold those of
    a run's earlier steps as well as the tables that came of them.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def quote(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def quoted(qualified: str) -> str:
    """A qualified name such as ``catalog.database`` with each part quoted."""
    return ".".join(map(quote, qualified.split(".")))


@dataclass(frozen=True)
class StagedTable:
    frame: DataFrame
    rows: int
    bytes: int  # uncompressed size of the text columns


class Staging:
    """Writes intermediate results to the shared folder and removes them on exit.

    A staged table cuts the lineage, survives the loss of executors and has a
    known size, so the next step can be planned on facts. After ``keep_on_error``
    the folder stays if the step fails. ``codec`` compresses otherwise than the session does.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark = spark
        self.codec = codec
        self.folder = f"{work_folder(spark)}/staging-{uuid.uuid4().hex}"
        self._count = 0
        self._keep_on_error = False

    def keep_on_error(self) -> None:
        self._keep_on_error = True

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, error_type, error, trace) -> None:
        if self._count and not (error_type and self._keep_on_error):
            delete_folder(self.spark, self.folder)

    def write(self, frame: DataFrame) -> StagedTable:
        self._count += 1
        path = f"{self.folder}/{self._count}"
        seen = Observation()
        row_bytes = F.lit(0)
        for name, kind in frame.dtypes:
            row_bytes = row_bytes + (
                F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8)
            )
        counted = frame.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.sum(row_bytes.cast("bigint")).alias("bytes")
        )
        counted.write.mode("overwrite").parquet(path, compression=self.codec)
        staged = self.spark.read.schema(frame.schema).parquet(path)
        return StagedTable(staged, seen.get["rows"], seen.get["bytes"] or 0)
