"""Session settings, the shared scratch folder, and the two plan helpers built on them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame is broadcast by hint only if its caller can state a row bound below this.
BROADCAST_ROW_LIMIT = 100_000


def local_session(app: str = "driftline", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application so it can be dropped whole."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/driftline/{app}/{label}-{uuid.uuid4().hex}"
    open_scopes = getattr(_scopes, "open", [])
    if open_scopes:
        open_scopes[-1].append(path)
    return path


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what a job wrote below the shared folder when the job is done.

    Frames that read those tables are of no use afterwards, so a job returns rows or what it
    has stored elsewhere. A scope inside another one deletes its own tables only.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            _delete(spark, path)


@contextmanager
def recorded_paths() -> Iterator[list[str]]:
    """The list that collects what is written below the shared folder inside the block; nothing is deleted."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    own: list[str] = []
    _scopes.open.append(own)
    try:
        yield own
    finally:
        _scopes.open.pop()


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded tables that no frame in use reads any more."""
    for path in paths:
        _delete(spark, path)
    paths.clear()


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote below the shared folder."""
    _delete(spark, f"{shared_root(spark)}/driftline/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, fixes partition-dependent
    columns, and gives later readers column pruning, file statistics and a known size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key over four tasks for each core, before each of them is multiplied or worked on at
    length in its own task. How a table was cut into files, or a filter on it, then does not decide how many
    tasks share that work; the number is given, so small rows are not merged into few tasks again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def broadcast_bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint when the caller proves a small row bound; otherwise leave it to AQE,
    which measures the shuffled size before it chooses."""
    if rows is not None and rows <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df
