"""Session settings and the shared folder for written intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folders: dict[str, str] = {}


def build_session(app: str = "changeflow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans here hold many expressions; recording a call site for each costs more than the query's start.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in local mode with the setting unset."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="changeflow-")
    return _local_folders[application]


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, never reused between runs."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as each query ends. By default they stay until the driver happens to collect
    its garbage, so that disks hold the shuffles of many steps at once. For queries that run once, as every write does."""
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def write_parquet(rows: DataFrame, folder: str, mode: str = "error", codec: str | None = None) -> None:
    """Rows written to a folder, their shuffle files deleted; `codec` where Spark's own does not do."""
    writer = rows.write.mode(mode)
    with freed_shuffles(rows.sparkSession):
        (writer.option("compression", codec) if codec else writer).parquet(folder)
