"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEPT: dict[tuple[str, str, str], tuple[DataFrame, list[str]]] = {}
_PATHS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session that names none gets a temporary one."""
    folder = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, where: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(where)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends or with ``release``."""
    path = f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: int) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. This runs a job.

    The plan is cut there: what follows reads files that any executor can read, so the loss of
    one executor costs its running tasks only. ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite").options(**options)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the job's shuffle files again; the driver may keep them for long
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], store: bool = True, **options: int) -> DataFrame:
    """The table ``name`` made from the data folder: stored at its first use and read by all later ones of
    the session, made again if its files are gone. Data folders are taken not to change meanwhile; ``release``
    forgets all. With ``store`` off what
    ``build`` gives reads stored tables already."""
    own = spark.sparkContext.applicationId
    key = (own, folder.rstrip("/"), name)
    if key in _KEPT:
        table, paths = _KEPT[key]
        if all(files.exists(at) for at, files in (_path(spark, p) for p in paths)):
            return table
    before = len(_PATHS.get(own, []))
    table = stored(build(), name, **options) if store else build()
    _KEPT[key] = table, _PATHS.get(own, [])[before:]
    return table


def release(spark: SparkSession) -> int:
    """Deletes everything stored in this session so far; data frames that read it can't be used any more."""
    own = spark.sparkContext.applicationId
    paths = _PATHS.pop(own, [])
    for path in paths:
        at, files = _path(spark, path)
        files.delete(at, True)
    for key in [k for k in _KEPT if k[0] == own]:
        del _KEPT[key]
    return len(paths)
