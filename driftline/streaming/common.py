"""Stream sources and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def stateful_session(spark: SparkSession, state_partitions: int) -> SparkSession:
    """A session of the same application whose stateful queries get this many partitions.

    The number is fixed for the life of a stream checkpoint, so it is an argument of every
    stateful job and not taken from a batch setting. State lives in RocksDB, outside the heap. A batch
    stores the changes of its state and not whole files of it, and no look-up is spent on every write to keep
    a count of the rows in the state, which only shows in metrics.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return own


def event_stream(
    spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, ts: str,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Append-only Parquet parts as a stream; event time becomes a zoned timestamp, since a
    watermark needs one."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(writer) -> int:
    """One scheduled run: process everything that has arrived, then stop.

    Returns how much came after the watermark and was left out, as far as Spark keeps the progress
    of its micro-batches: rows, or for counts the map-side sums of rows.
    """
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(
        state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"]
    )
