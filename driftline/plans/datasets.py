"""The supplied tables seen as monitored models, and the SQL that says the same.

`lineitem`: reference before 1999, production after, no label.
`events`: reference before 21 January 2024, production after, with a deterministic score and a
label that follows the same features plus hashed noise. `drifting_events` adds a shift and a
label flip that grow with the day of the production part.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import clip, hash_uniform, round_to
from driftline.operators.perturb import FLIP_RATE, Shift, inject_covariate_shift, inject_label_flip
from driftline.sources.tables import moment, read_table

LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_SPLIT = datetime(1999, 1, 1)
EVENT_FEATURES = ["value", "k"]
EVENT_SPLIT = datetime(2024, 1, 21)
DECISION_THRESHOLD = 0.65
SHIFTS = (Shift("value", scale=-0.35, offset=-40.0),)
SEED = 7


def split(df: DataFrame, ts: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Reference and production by event time; the literal reaches the scan."""
    cut = moment(at, df.schema[ts].dataType)
    return df.filter(F.col(ts) < cut), df.filter(F.col(ts) >= cut)


def lineitem_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return split(read_table(spark, folder, "lineitem"), "l_shipdate", LINEITEM_SPLIT)


def event_score(value: Column, k: Column) -> Column:
    raw = F.lit(0.5) + F.lit(0.004) * value - F.lit(0.005) * (k - F.lit(50.0))
    return round_to(clip(raw, 0.01, 0.99), 4)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, k, label."""
    raw = read_table(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("double")
    )
    signal = (
        F.lit(0.004) * F.col("value")
        - F.lit(0.005) * (F.col("k") - F.lit(50.0))
        + F.lit(0.3) * (hash_uniform(["event_id"], "label") - F.lit(0.5))
    )
    return raw.select(
        "event_id", "ts", "user_id", "event_type", "value", "k",
        (signal > F.lit(0.15)).cast("int").alias("label"),
    )


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", event_score(F.col("value"), F.col("k")))


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    return with_score(events(spark, folder))


def drifting_events(spark: SparkSession, folder: str) -> DataFrame:
    """Scored events whose production days drift more and more (intensity 0.1 to 1.0)."""
    df = events(spark, folder)
    late = F.col("ts") >= moment(EVENT_SPLIT, df.schema["ts"].dataType)
    day = (F.dayofmonth("ts") - F.lit(20)).cast("double") / F.lit(10.0)
    intensity = F.when(late, day).otherwise(F.lit(0.0))
    marked = df.withColumn("intensity", intensity)
    shifted = inject_covariate_shift(marked, SHIFTS, F.col("intensity"), ["event_id"], SEED)
    flipped = inject_label_flip(
        shifted, "label", F.col("value") > 50.0, F.col("intensity"), ["event_id"], SEED
    )
    return with_score(flipped.drop("intensity"))


# --- the same tables as DuckDB SQL ---------------------------------------------------------


def uniform_sql(key: str, seed: object, salt: str = "", digits: int = 8) -> str:
    tail = f" || '|{salt}'" if salt else ""
    text = f"CAST({key} AS VARCHAR) || '|{seed}'{tail}"
    return f"(CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT) / CAST({16**digits} AS DOUBLE))"


def score_sql(value: str = "value", k: str = "k") -> str:
    raw = (
        f"(CAST(0.5 AS DOUBLE) + CAST(0.004 AS DOUBLE) * {value} "
        f"- CAST(0.005 AS DOUBLE) * ({k} - 50.0::DOUBLE))"
    )
    clipped = f"least(greatest({raw}, 0.01::DOUBLE), 0.99::DOUBLE)"
    return f"(floor({clipped} * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE)"


EVENTS_SQL = f"""
  SELECT event_id, ts, user_id, event_type, value, k,
         CAST(0.004::DOUBLE * value - 0.005::DOUBLE * (k - 50.0::DOUBLE)
              + 0.3::DOUBLE * ({uniform_sql('event_id', 'label')} - 0.5::DOUBLE)
              > 0.15::DOUBLE AS INTEGER) AS label
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""

SCORED_SQL = f"SELECT *, {score_sql()} AS score FROM ({EVENTS_SQL})"

DRIFTING_SQL = f"""
  SELECT event_id, ts, user_id, event_type, value, k,
         CASE WHEN value > 50.0::DOUBLE
                   AND {uniform_sql('event_id', SEED, 'flip')} < {FLIP_RATE}::DOUBLE * i
              THEN 1 - label ELSE label END AS label,
         {score_sql()} AS score
  FROM (
    SELECT event_id, ts, user_id, event_type, k, label, i,
           value * (1.0::DOUBLE + (-0.35)::DOUBLE * i) + (-40.0)::DOUBLE * i AS value
    FROM (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-21'
                         THEN CAST(day(ts) - 20 AS DOUBLE) / 10.0::DOUBLE
                         ELSE 0.0::DOUBLE END AS i
          FROM ({EVENTS_SQL}))
  )
"""
