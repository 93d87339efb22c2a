"""PSI of sliding windows over a stream.

The stream keeps counts per one-hour pane, feature and cell. A sliding window is a sum of
panes, so a reading updates one state row and not one per window it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.drift import psi_against_profile
from driftline.operators.profile import ReferenceProfile, cell, to_long
from driftline.streaming.common import run_available
from driftline.streaming.day_parts import DayParts, newest_wins

PANE_HOURS = 1


def pane_counts(
    stream: DataFrame, features: Sequence[str], profile: ReferenceProfile, ts: str, lateness: str
) -> DataFrame:
    """Counts per (pane, feature, cell): a static bounded broadcast and one stateful count."""
    watermarked = stream.withWatermark(ts, lateness)
    long = to_long(watermarked, features, [ts])
    return (
        long.join(profile.small_features(), "feature")
        .select(ts, "feature", cell().alias("cell"))
        .groupBy(F.window(ts, f"{PANE_HOURS} hours").alias("w"), "feature", "cell")
        .agg(F.count(F.lit(1)).alias("s"))
        .select(F.col("w.start").alias("pane"), "feature", "cell", "s")
    )


def write_running(
    counts: DataFrame, keys: list[str], value: str, moment: str, path: str, checkpoint: str
) -> int:
    """Keep running values of a stream in update mode as a table by day in which the newest wins.

    A batch writes what it has changed, and the watermark drops the state of what is closed, so
    neither grows with the stream. Returns how many counts came too late.
    """
    table = DayParts(path, newest_wins(keys, value))
    return run_available(
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: table.add(batch, F.to_date(moment), batch_id))
    )


def read_running(spark: SparkSession, keys: list[str], value: str, path: str) -> DataFrame:
    return DayParts(path, newest_wins(keys, value)).read(spark)


PANE_KEYS = ["pane", "feature", "cell"]


def write_panes(panes: DataFrame, path: str, checkpoint: str, output_mode: str = "update") -> int:
    """Write panes per micro-batch; a repeated batch replaces its own folder only.

    Update mode keeps panes as running values, one part for each closed day and a few for open
    ones. Append mode writes a pane once it is closed, to a folder of its batch.
    """
    if output_mode == "update":
        return write_running(panes, PANE_KEYS, "s", "pane", path, checkpoint)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_available(
        panes.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    """Each pane as the newest batch that wrote it in update mode has it."""
    return read_running(spark, PANE_KEYS, "s", path)


def sliding_psi(
    panes: DataFrame, profile: ReferenceProfile, window_hours: int = 24, slide_hours: int = 1
) -> DataFrame:
    """PSI of every sliding window from the pane counts."""
    back = F.expr(
        f"transform(sequence(0, {window_hours - PANE_HOURS}, {PANE_HOURS}), h -> pane - make_dt_interval(0, h))"
    )
    starts = panes.withColumn("window_start", F.explode(back))
    if slide_hours > PANE_HOURS:
        hours = F.floor(F.unix_timestamp(F.col("window_start").cast("timestamp")) / 3600)
        starts = starts.filter(hours % slide_hours == 0)
    counts = starts.groupBy("window_start", "feature", "cell").agg(F.sum("s").alias("s"))
    return psi_against_profile(counts, profile, ["window_start"])
