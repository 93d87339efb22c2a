"""Reports over the history tables: recency, trends, gauges, registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds in seconds of the duration histogram, and the trend bar scale.
DURATION_BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)
BAR_SCALE = 36.0
BAR_MINIMUM = 2.0
PSI_FLOOR = 0.001


def recent(df: DataFrame, ts: str = "ts", tie: Sequence[str] = ("id",), limit: int = 20) -> DataFrame:
    """The newest rows (a top-k report: each task keeps only `limit` rows)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in tie]).limit(limit)


def with_trend(recent_rows: DataFrame, ts: str, tie: Sequence[str], psi: str = "psi_max") -> DataFrame:
    """Change of PSI against the check before; the input is a limited recent list."""
    order = Window.orderBy(ts, *tie)
    return recent_rows.withColumn("psi_change", F.col(psi) - F.lag(psi).over(order))


def psi_trend(
    checks: DataFrame, ts: str = "ts", tie: Sequence[str] = ("id",), limit: int = 15
) -> DataFrame:
    """Bar heights of the newest checks, oldest first, scaled to the largest of them."""
    newest = recent(checks, ts, tie, limit)
    whole = Window.partitionBy()
    top = F.greatest(F.max("psi_max").over(whole), F.lit(PSI_FLOOR))
    height = F.greatest(F.lit(BAR_MINIMUM), F.lit(BAR_SCALE) * F.col("psi_max") / top)
    position = F.row_number().over(Window.orderBy(ts, *tie))
    return newest.withColumns({"height": height, "position": position})


def status_counts(checks: DataFrame, column: str = "status") -> DataFrame:
    return checks.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def latest_gauges(checks: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last PSI (0 when missing) and the last known F1 and drop of each key."""
    order = F.struct(ts, "id")

    def last_known(column: str) -> Column:
        known = F.when(F.col(column).isNotNull(), order)
        return F.max_by(column, known)

    return checks.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.coalesce("psi_max", F.lit(0.0)), order), F.lit(0.0)).alias(
            "last_psi_max"
        ),
        last_known("perf_f1").alias("last_f1"),
        last_known("perf_drop").alias("last_f1_drop"),
    )


def duration_histogram(
    df: DataFrame, seconds: str, buckets: Sequence[float] = DURATION_BUCKETS
) -> DataFrame:
    """Cumulative counts per upper bound, with count and sum; one aggregation, then one row
    per bucket."""
    counted = df.agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"le_{i}") for i, b in enumerate(buckets)],
        F.count(seconds).alias("le_inf"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_seconds"),
    )
    bounds = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n"))
        for i, b in enumerate(buckets)
    ]
    bounds.append(F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("n")))
    return counted.select(F.inline(F.array(*bounds)), "total_seconds")


def seconds_since_dispatch(audits: DataFrame, now: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds from the newest dispatched, pending or dry-run audit to `now`; NULL when there is none."""
    sent = F.col("decision").isin("dispatched", "pending", "dry_run")
    newest = audits.groupBy(*keys).agg(F.max(F.when(sent, F.col("ts"))).alias("last_dispatch"))
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(
        F.col("last_dispatch").cast("timestamp")
    )
    return newest.withColumn("seconds_since", micros / F.lit(1_000_000.0))


def current_aliases(moves: DataFrame) -> DataFrame:
    """(model, alias, version) after all moves: of each alias the newest move counts, by `seq`, whichever
    version it names; an alias whose newest move names none is gone. Combined map-side."""
    newest = moves.groupBy("model", "alias").agg(F.max_by(F.struct("version"), "seq").alias("_to"))
    return newest.select("model", "alias", F.col("_to.version").alias("version")).where(F.col("version").isNotNull())


def resolve_champions(registry: DataFrame, moves: DataFrame | None = None, model: str = "model") -> DataFrame:
    """Per model the version with the champion alias, else the numerically highest one.

    `moves` is the log of alias moves; an alias on a version that is not registered does not count.
    Without a log the alias column of the registry is read, of several versions the highest."""
    version = F.col("version").cast("bigint")
    latest = registry.groupBy(model).agg(
        F.max(version).alias("latest_version"), F.max(F.when(F.col("alias") == "champion", version)).alias("champion_version")
    )
    if moves is not None:
        champions = current_aliases(moves).where(F.col("alias") == "champion").select("model", "version")
        known = registry.select(F.col(model).alias("model"), "version").distinct()
        held = champions.join(known, ["model", "version"], "left_semi").select(
            F.col("model").alias(model), version.alias("champion_version")
        )
        latest = latest.drop("champion_version").join(held, model, "left")
    return latest.withColumn(
        "uri",
        F.when(
            F.col("champion_version").isNotNull(),
            F.concat(F.lit("models:/"), F.col(model), F.lit("@champion (v"), F.col("champion_version").cast("string"), F.lit(")")),
        ).otherwise(
            F.concat(F.lit("models:/"), F.col(model), F.lit("/"), F.col("latest_version").cast("string"))
        ),
    )


def checks_with_verdicts(checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every check with its verdict, if there is one. Both sides are joined on the check id;
    the plan is left to statistics, since either side may be large."""
    return checks.join(verdicts, checks["id"] == verdicts["drift_check_id"], "left")
