"""Session set-up shared by tests, bench and command lines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def pin_utc(spark: SparkSession) -> SparkSession:
    """Every instant in this library is UTC; naive inputs are read as UTC. Workers get the
    package, as its functions run there too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship(spark)


def local_session(cpus: str | int = "*", memory: str = "8g", shuffle_partitions: int = 8,
                  app: str = "pulseline", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers this package, once per session, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_pulseline_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pulseline-ship-")) / "pulseline.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"pulseline/{source.relative_to(root)}")
    context.addPyFile(str(target))
    context._pulseline_shipped = True
    return spark
