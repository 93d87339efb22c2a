"""Check after every micro-batch, persisted and with its alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import DriftConfig
from driftline.operators.decisions import alert_feed
from driftline.plans.checks import ModelSpec, ReferenceBundle, drift_report
from driftline.plans.monitor import MonitorTables
from driftline.sources import sinks
from driftline.sources.tables import lookback_window
from driftline.streaming.day_parts import DayParts


def check_each_batch(
    stream: DataFrame,
    reference: DataFrame | None,
    spec: ModelSpec,
    tables: MonitorTables,
    model: str,
    hours: int = 24,
    config: DriftConfig | None = None,
    bundle: ReferenceBundle | None = None,
):
    """Stream writer: append the batch to the log, check the newest window, keep check and alert.

    The log is kept by day (`DayParts`), so a check opens the window's days only, in a number of
    parts that does not grow with the stream. Every output lies in a folder of its batch id that a
    repeated batch replaces, so a repeated run gives the same tables. With the model's bundle no
    batch reads the reference; intermediate tables go with each check.
    """
    log = DayParts(f"{tables.root}/log", open_days=-(-hours // 24))

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log.add(batch, F.to_date(spec.ts), batch_id)
        window = lookback_window(log.read(spark, -(-hours // 24)), spec.ts, hours)
        report = drift_report(reference, window, spec, config, bundle=bundle).withColumns(
            {"model": F.lit(model), "ts": F.col("window_end"), "batch_id": F.lit(batch_id)}
        )
        rows = sinks.drift_check_rows(report, ["model", "batch_id"])
        rows.write.mode("overwrite").parquet(f"{tables.checks}/batch={batch_id}")
        alerts = alert_feed(report).select("model", "ts", "status", "text")
        alerts.write.mode("overwrite").parquet(f"{tables.root}/alerts/batch={batch_id}")

    return stream.writeStream.foreachBatch(check)
