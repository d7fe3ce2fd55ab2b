"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Runtime re-planning on, UTC timestamps; sizes are left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def local_session(cores: int | str = 8, name: str = "folioscope") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        configure(SparkSession.builder.master(f"local[{cores}]").appName(name))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A cluster names one in ``spark.checkpoint.dir``; only when neither that nor
    an earlier call set one (tests) a scratch folder is used.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), "folioscope")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "folioscope"))
    _shipped.add(app)
