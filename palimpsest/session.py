"""Session helpers.

The library never creates a session itself; jobs receive one. These helpers
exist for tests, the bench and small local runs, and for reading cluster
settings (checkpoint folder, broadcast limits) from whatever session is given.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "palimpsest") -> SparkSession:
    """A local session configured the way the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PALIMPSEST_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and is only read here.
    Only when it is unset and the master is local (tests) do we pick a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="palimpsest-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def broadcast_row_limit(spark: SparkSession, default: int = 2_000_000) -> int:
    """Largest row count we are willing to broadcast (``palimpsest.broadcast.maxRows``)."""
    value = spark.conf.get("palimpsest.broadcast.maxRows", None)
    return int(value) if value else default


def broadcast_byte_limit(spark: SparkSession, default: int = 128 << 20) -> int:
    """Largest size in bytes we are willing to broadcast (``palimpsest.broadcast.maxBytes``)."""
    value = spark.conf.get("palimpsest.broadcast.maxBytes", None)
    return int(value) if value else default


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (for the pandas
    operators), as ``--py-files`` would: zip it once and ``addPyFile`` it.
    Skipped when workers can already import it (``PALIMPSEST_INSTALLED=1``)."""
    if os.environ.get("PALIMPSEST_INSTALLED") == "1":
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="palimpsest-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "palimpsest"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="palimpsest")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def text_partitions(spark: SparkSession) -> int:
    """Partition count for shuffles that feed CPU-heavy per-row text work.

    Adaptive execution coalesces shuffle output by bytes, which squeezes a
    small-but-expensive text stage (a few MB of documents to tokenise, chunk
    or embed) into one task. Repartitioning with an explicit count keeps it
    spread: ``max(spark.sql.shuffle.partitions, 2 x default parallelism)``.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, 2 * spark.sparkContext.defaultParallelism)
