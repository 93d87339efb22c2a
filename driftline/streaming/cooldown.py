"""Rate-limited retrain decisions on a stream (T7), in three forms.

The stateful operator keeps one value per model and suits the usual few requests per model
and micro-batch. `cooldown_batches` runs the distributed batch job on every micro-batch and
has no limit on the requests of one model. `cooldown_in_event_time` runs the same job on what the
watermark has closed, so that its decisions do not depend on the borders of batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.decisions import retrain_cooldown
from driftline.session import drop_paths

OUTPUT = T.StructType(
    [
        T.StructField("model", T.LongType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("dispatched", T.BooleanType()),
    ]
)


def cooldown_processor(interval_micros: int):
    """Processor whose only state is the time of the last dispatch.

    The class is made here so that it travels with the query. Requests of a micro-batch are
    taken in time order; one that comes in a later batch than its successor is judged
    against the last dispatch known then.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Cooldown(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "at bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frames = [(f["at"].to_numpy(), f["request_id"].to_numpy()) for f in rows]
            at = np.concatenate([f[0] for f in frames])
            request = np.concatenate([f[1] for f in frames])
            order = np.lexsort((request, at))
            at, request = at[order], request[order]
            last = self.last.get()[0] if self.last.exists() else None
            sent = np.zeros(len(at), dtype=bool)
            for i, moment in enumerate(at.tolist()):
                if last is None or moment - last >= interval_micros or moment == last:
                    last, sent[i] = moment, True
            if last is not None:
                self.last.update((last,))
            yield pd.DataFrame({"model": key[0], "request_id": request, "at": at, "dispatched": sent})

        def close(self) -> None:
            pass

    return Cooldown()


def retrain_cooldown_stream(requests: DataFrame, interval_minutes: int) -> DataFrame:
    """Decisions for a stream of (model, request_id, at in microseconds)."""
    return requests.select("model", "request_id", "at").groupBy("model").transformWithStateInPandas(
        statefulProcessor=cooldown_processor(interval_minutes * 60 * 1_000_000),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )


def cooldown_batches(requests: DataFrame, interval_minutes: int, path: str, ts: str = "ts"):
    """Stream writer that decides each micro-batch with the distributed batch job.

    The last dispatch per model is kept as a small table per batch id. A repeated batch reads
    the state of the batch before it and replaces its own folders, so it gives the same rows.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = None if batch_id == 0 else spark.read.parquet(f"{path}/last/batch={batch_id - 1}")
        decided = retrain_cooldown(batch, ["model"], ts, interval_minutes, last)
        decided.write.mode("overwrite").parquet(f"{path}/decisions/batch={batch_id}")
        sent = spark.read.parquet(f"{path}/decisions/batch={batch_id}").filter("dispatched")
        newest = sent.select("model", F.col(ts).alias("last"))
        if last is not None:
            newest = newest.unionByName(last)
        newest.groupBy("model").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(
            f"{path}/last/batch={batch_id}"
        )

    return requests.writeStream.foreachBatch(decide)


def cooldown_in_event_time(
    requests: DataFrame, interval_minutes: int, lateness_minutes: int, path: str, ts: str = "ts"
):
    """Stream writer whose decisions depend on event time only, not on how requests came in batches.

    A request waits until the newest request seen is more than `lateness_minutes` after it; then no
    earlier one can come any more, and all requests up to that moment are decided by the distributed
    batch job. Requests that come after their moment was decided go to `late`, undecided. A request
    without a time can not be decided and goes there too. The state of a batch is a table of open
    requests, the last dispatch of each model, and two moments; older states are deleted.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        came = f"{path}/arrived/batch={batch_id}"
        batch.write.mode("overwrite").parquet(came)
        arrived = spark.read.schema(batch.schema).parquet(came)
        last, waiting, newest, decided_to = None, arrived.limit(0), None, None
        if batch_id > 0:
            last = spark.read.parquet(f"{path}/last/batch={batch_id - 1}")
            waiting = spark.read.schema(batch.schema).parquet(f"{path}/open/batch={batch_id - 1}")
            newest, decided_to = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()
        late = F.col(ts).isNull() if decided_to is None else F.col(ts).isNull() | (F.col(ts) < F.lit(decided_to))
        arrived.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        seen = [t for t in (newest, arrived.agg(F.max(ts)).first()[0]) if t is not None]
        newest = max(seen, default=None)
        border = newest and newest - timedelta(minutes=lateness_minutes)
        if border is not None and (decided_to is None or border > decided_to):
            decided_to = border
        pending = waiting.unionByName(arrived.where(~late))
        closed = F.lit(False) if decided_to is None else F.col(ts) < F.lit(decided_to)
        pending.where(~closed).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
        out = f"{path}/decisions/batch={batch_id}"
        retrain_cooldown(pending.where(closed), ["model"], ts, interval_minutes, last).write.mode("overwrite").parquet(out)
        sent = spark.read.parquet(out).where("dispatched").select("model", F.col(ts).alias("last"))
        known = sent if last is None else sent.unionByName(last)
        known.groupBy("model").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{path}/last/batch={batch_id}")
        kind = batch.schema[ts].dataType.simpleString()
        clock = spark.createDataFrame([(newest, decided_to)], f"newest {kind}, decided_to {kind}")
        clock.coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        drop_paths(spark, [f"{path}/{t}/batch={batch_id - 2}" for t in ("arrived", "open", "last", "clock")])

    return requests.writeStream.foreachBatch(decide)


def open_decisions(spark: SparkSession, path: str, interval_minutes: int, ts: str = "ts") -> DataFrame:
    """How the requests that still wait would be decided if no other one came."""
    batch = spark.read.parquet(f"{path}/clock").agg(F.max("batch")).first()[0]
    waiting = spark.read.parquet(f"{path}/open/batch={batch}")
    return retrain_cooldown(waiting, ["model"], ts, interval_minutes, spark.read.parquet(f"{path}/last/batch={batch}"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/decisions").drop("batch")
