"""Lineage cuts that survive executor loss.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``.
Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

_local_folder: str | None = None
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="pulseline-")
    return _local_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder per application, which
    can be removed as a whole once the application is done; inside ``scratch_scope``
    it goes with the scope."""
    folder = f"{shared_folder(spark)}/pulseline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    open_scopes = getattr(_scopes, "open", [])
    if open_scopes:
        open_scopes[-1].append(folder)
    return f"{folder}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end, so a job or a micro-batch
    leaves no scratch behind. Nothing lazy that reads it may leave the scope."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, folders = _scopes.open
        for folder in folders:
            remove(spark, folder)


def observed(seen: Observation) -> dict[str, int]:
    """Metrics of rows that were written; none where the optimizer found that there are no rows, as it
    drops the metrics with them, which has no row to convert."""
    try:
        return seen.get
    except Py4JJavaError as missing:
        if "toPyRow" not in str(missing):
            raise
        return {}


def materialise(df: DataFrame, name: str, *partition_by: str, within: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, ``within`` another session if given:
    that of a micro-batch does not adapt plans to sizes."""
    path = scratch(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return (within or df.sparkSession).read.schema(df.schema).parquet(path).select(*df.columns)
