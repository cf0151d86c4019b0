"""Session helpers: a default local session and the lineage cut every module shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "plumbline", cores: str | int = "*", shuffle_partitions: int = 8,
                driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", driver_memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    A local session (tests) that names none gets a fresh temporary folder; anywhere else a missing
    setting is an error, because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="plumbline-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_free(df: DataFrame) -> DataFrame:
    """As :func:`cut`, and the shuffle files behind ``df`` are removed once it is written, not when the driver's garbage collector finds them.

    Later steps read the written rows only. The setting holds for DataFrames made while it is set, so ``df`` is selected once more.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Needed only by the few operators that run Python in tasks; an installed package makes it redundant.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-py-")) / "plumbline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("plumbline") / f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
