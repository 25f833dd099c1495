"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


FIRST_PARTITIONS = 1000
TASK_BYTES = 4 << 20  # a window task holds some hundred bytes in memory for each of these, once for every sort
SCAN_BYTES = 16 << 20  # bars are about as many as trades, so a scan holds most of what it reads while it combines
METHOD_BYTES = 8000  # HotSpot interprets longer methods for good


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes to an existing session.

    Only settings that change results (time zone), let Spark split hot groups at run
    time (AQE and its skew join) or keep generated code short enough to be compiled
    (wide feature tables) are touched.  Shuffles start with
    ``FIRST_PARTITIONS`` partitions, which AQE joins up to ``TASK_BYTES`` (compressed): a
    fixed number of them would let the memory of a task grow with the input.  Sizes that
    whoever owns the cluster has set stay.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    for name, value in (
        ("adaptive.coalescePartitions.initialPartitionNum", FIRST_PARTITIONS), ("adaptive.advisoryPartitionSizeInBytes", TASK_BYTES),
        ("files.maxPartitionBytes", SCAN_BYTES), ("codegen.hugeMethodLimit", METHOD_BYTES),
    ):
        if spark.conf.get(f"spark.sql.{name}", None) is None:
            spark.conf.set(f"spark.sql.{name}", str(value))
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once.

    Needed where it is neither installed nor on the workers' path, for instance when
    a job is started from another folder.  Spark serves the archive to executors itself,
    those that join later included.
    """
    app = spark.sparkContext.applicationId
    with _shipping:
        if app in _shipped:
            return
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tapeloom-")) / f"{package.name}-sources.zip"  # the driver serves it while it lives
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder for tables between steps, stream sinks and state.

    It lies below ``spark.checkpoint.dir``, shared storage that the cluster names.
    Without the setting a temporary folder serves a local master; on a cluster every
    executor would write to a disk of its own there, so that is an error.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/tapeloom-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tapeloom-")


_steps = threading.local()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    The table lies on shared storage (see :func:`work_dir`), so it outlives an
    executor, and the branches neither repeat nor carry the work behind it.
    """
    folder = work_dir(df.sparkSession)
    df.write.parquet(folder + "/table")
    for made in getattr(_steps, "open", [])[-1:]:
        made.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder + "/table")


@contextmanager
def steps(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside the block are deleted at its end, but for those put on the list.

    What is put there has to be a materialized table: a lazy result would read what is gone.
    """
    stack = _steps.__dict__.setdefault("open", [])
    made: list[str] = []
    kept: list[DataFrame] = []
    stack.append(made)
    try:
        yield kept
    finally:
        stack.pop()
        files = [f for df in kept for f in df.inputFiles()]
        stay = [folder for folder in made if any(folder.rsplit("/", 1)[-1] in f for f in files)]
        for folder in made:
            if folder not in stay:
                remove(spark, folder)
        for outer in stack[-1:]:
            outer += stay


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
