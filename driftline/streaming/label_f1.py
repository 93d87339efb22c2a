"""F1 on labels that arrive late, as a stream-stream interval join (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.streaming.common import run_available


def labelled_predictions(
    scores: DataFrame, labels: DataFrame, key: str, max_delay: str, lateness: str, unmatched: bool = False
) -> DataFrame:
    """Each score with its label, once both are there.

    With `unmatched`, a score whose label can no longer come is given too, with a NULL label, when
    the watermark drops it from the state.

    `scores` has (key, ts, score), `labels` (key, label_ts, label). A label can come up to
    `max_delay` after its score; both watermarks and that bound let Spark drop old state.
    """
    s = scores.withWatermark("ts", lateness).alias("s")
    known = labels.withColumnRenamed(key, "_key").withWatermark("label_ts", lateness).alias("l")
    on_time = (
        (F.col(f"s.{key}") == F.col("l._key"))
        & (F.col("l.label_ts") >= F.col("s.ts"))
        & (F.col("l.label_ts") <= F.col("s.ts") + F.expr(f"INTERVAL {max_delay}"))
    )
    return s.join(known, on_time, "left_outer" if unmatched else "inner").drop("_key")


def write_labelled(joined: DataFrame, path: str, checkpoint: str) -> None:
    """Append to a Parquet table; the file sink and its checkpoint make it exactly once."""
    run_available(
        joined.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def scores_by_day(scores: DataFrame, lateness: str) -> DataFrame:
    """(day, n_samples): a running count of the scores of each day."""
    counted = scores.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"))
    return counted.agg(F.count(F.lit(1)).alias("n_samples")).select(
        F.to_date("w.start").alias("day"), "n_samples"
    )
