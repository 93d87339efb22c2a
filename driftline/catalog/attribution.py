"""Queries that localise drift in time and by segment, and rank features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import sql as q
from driftline.catalog.drift import DRIFT_PROD, DRIFT_REF, DRIFT_SELECT, drifting_sides, rounded_table
from driftline.operators import attribution as a
from driftline.operators.drift import feature_drift
from driftline.operators.profile import build_profile
from driftline.plans import datasets as ds

FEATURES = ds.EVENT_FEATURES
ALERT = 0.25


def _temporal(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = drifting_sides(spark, folder)
    return a.temporal_drift(prod, FEATURES, build_profile(ref, FEATURES), "ts", "event_id")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = drifting_sides(spark, folder)
    return a.segment_drift(ref, prod, FEATURES, "event_type")


def temporal_slices(spark: SparkSession, folder: str) -> DataFrame:
    _, prod = drifting_sides(spark, folder)
    return a.add_slice(prod, "ts", "event_id").select("event_id", "slice")


def temporal_drift(spark: SparkSession, folder: str) -> DataFrame:
    return _temporal(spark, folder).select("slice", "n", "ts_start", "ts_end", "psi_max")


def drift_sustained(spark: SparkSession, folder: str) -> DataFrame:
    return a.sustained(_temporal(spark, folder), ALERT)


def segment_drift(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder)


def drift_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Slices and segments of one window as rows, with the sustained flag on each."""
    temporal = _temporal(spark, folder)
    rows = temporal.select(
        F.lit("slice").alias("kind"), F.col("slice").cast("string").alias("part"), "n", "psi_max", F.lit("checked").alias("status")
    ).unionByName(
        _segments(spark, folder).select(
            F.lit("segment").alias("kind"), F.col("event_type").alias("part"), "n", "psi_max", "status"
        )
    )
    flag = a.sustained(temporal, ALERT).select("sustained", F.lit(1).alias("one"))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(flag), "one").drop("one")


def top_drifting_features(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = ds.lineitem_sides(spark, folder)
    table = feature_drift(ref, prod, ds.LINEITEM_FEATURES)
    return rounded_table(a.top_features(table, 3), [])


def inspect_feature(spark: SparkSession, folder: str) -> DataFrame:
    """A known and an unknown feature name."""
    ref, prod = drifting_sides(spark, folder)
    table = feature_drift(ref, prod, FEATURES)
    both = a.inspect_feature(table, "value").unionByName(a.inspect_feature(table, "nothing"))
    return rounded_table(both.withColumn("feature", F.col("wanted")), ["wanted", "available"]).drop("feature")


QUERIES = {
    "temporal_slices": temporal_slices,
    "temporal_drift": temporal_drift,
    "drift_sustained": drift_sustained,
    "segment_drift": segment_drift,
    "drift_attribution": drift_attribution,
    "top_drifting_features": top_drifting_features,
    "inspect_feature": inspect_feature,
}


def sliced_sql(production: str) -> str:
    """ntile over the whole window; the number of parts follows its row count."""
    tiles = " ".join(
        f"WHEN {k} THEN ntile({k}) OVER (ORDER BY ts, event_id) - 1" for k in (1, 2, 3)
    )
    return f"""SELECT *, CAST(CASE least(3, greatest(1, count(*) OVER () // 50)) {tiles} END AS INTEGER) AS slice
      FROM ({production})"""


def temporal_sql(reference: str, production: str, features) -> str:
    sliced = sliced_sql(production)
    return f"""WITH {q.psi_ctes(reference, sliced, features, windows=['slice'])}
      SELECT slice, n, ts_start, ts_end, psi_max
      FROM (SELECT slice, count(*) AS n, min(ts) AS ts_start, max(ts) AS ts_end FROM ({sliced}) GROUP BY slice)
      JOIN (SELECT slice, round(max(psi), 4) AS psi_max FROM psi GROUP BY slice) USING (slice)"""


def segment_sql(reference: str, production: str, features, segment: str) -> str:
    listed = f"""SELECT {segment}, count(*) AS n, CASE WHEN count(*) < 30 THEN 'insufficient_data'
          WHEN {segment} NOT IN (SELECT {segment} FROM ({reference})) THEN 'no_reference' ELSE 'checked' END AS status
        FROM ({production}) WHERE {segment} IS NOT NULL GROUP BY {segment}"""
    return f"""WITH {q.psi_ctes(reference, production, features, [segment])}
      SELECT {segment}, n, CASE WHEN status = 'checked' THEN psi_max END AS psi_max, status FROM ({listed})
      LEFT JOIN (SELECT {segment}, round(max(psi), 4) AS psi_max FROM psi GROUP BY {segment}) USING ({segment})"""


def sustained_sql(temporal: str, alert: float = ALERT) -> str:
    return f"""SELECT count(*) AS n_slices, count(*) FILTER (WHERE psi_max >= {alert}) AS n_breached,
      count(*) FILTER (WHERE psi_max >= {alert}) >= greatest(2, (count(*) + 1) // 2) AS sustained FROM ({temporal})"""


TEMPORAL = temporal_sql(DRIFT_REF, DRIFT_PROD, FEATURES)
SEGMENTS = segment_sql(DRIFT_REF, DRIFT_PROD, FEATURES, "event_type")
_INSPECT = "(SELECT string_agg(feature, ',' ORDER BY feature) FROM drift) AS available"
ORACLES = {
    "temporal_slices": f"SELECT event_id, slice FROM ({sliced_sql(DRIFT_PROD)})",
    "temporal_drift": TEMPORAL,
    "drift_sustained": sustained_sql(TEMPORAL),
    "segment_drift": SEGMENTS,
    "drift_attribution": f"""SELECT kind, part, n, psi_max, status, sustained FROM (
        SELECT 'slice' AS kind, CAST(slice AS VARCHAR) AS part, n, psi_max, 'checked' AS status FROM ({TEMPORAL})
        UNION ALL SELECT 'segment', event_type, n, psi_max, status FROM ({SEGMENTS}))
      CROSS JOIN (SELECT sustained FROM ({sustained_sql(TEMPORAL)}))""",
    "top_drifting_features": f"""WITH {q.drift_table_ctes("SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'",
        "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'", ds.LINEITEM_FEATURES)}
      SELECT {DRIFT_SELECT} FROM drift ORDER BY drift.psi DESC, feature LIMIT 3""",
    "inspect_feature": f"""WITH {q.drift_table_ctes(DRIFT_REF, DRIFT_PROD, FEATURES)}
      SELECT 'value' AS wanted, {_INSPECT}, * EXCLUDE (feature) FROM (SELECT {DRIFT_SELECT} FROM drift) WHERE feature = 'value'
      UNION ALL SELECT 'nothing', {_INSPECT}, {', '.join(['NULL'] * 11)}""",
}
