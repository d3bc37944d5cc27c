"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Rows and bytes of text that a Python worker is sent at a time, and what opening one of many small files
# counts as, in bytes, when files are dealt to tasks.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
SMALL_FILE = 1 << 16

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "instructset") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every column expression costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    a machine-local folder would be lost with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="instructset-")
    return _own_dirs[context.applicationId]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for the few functions that run in Python."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        # Only the driver reads this archive; Spark hands it on to the executors.
        base = Path(tempfile.mkdtemp(prefix="instructset-")) / root.name
        archive = shutil.make_archive(str(base), "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds a few MB at a time; smaller ones that are set stay."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for name, limit in limits.items():
        now = spark.conf.get(name)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= limit:
            spark.conf.set(name, str(limit))


def file_tasks(spark: SparkSession) -> int:
    """Tasks for work on many small files. Files, not bytes, are the work, so tasks aren't merged for holding few bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Jobs inside read thousands of small files in a task, where the usual few tens make more tasks than work."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(SMALL_FILE))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the written table.

    Unlike a checkpoint, the table keeps column pruning and filter push-down for every
    later pass, and it outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
