"""Rules over report tables: status, guards, retrain gate, cooldown, messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import DriftConfig
from driftline.functions.scalars import AUDIT_TEXT_LENGTH, clean_reason
from driftline.operators.ordered import neighbours
from driftline.session import materialise


# The gate messages, and the audit detail of each decision that passed the gate.
OFF_TEXT = "BLOCKED: retraining disabled (retrain_enabled is off)."
PSI_TEXT = "BLOCKED: psi_max=%.4f < {limit} — data-drift condition not met."
DROP_TEXT = "BLOCKED: f1_drop=%.4f < {limit} — performance-degradation condition not met."
RATE_TEXT = "BLOCKED: last retrain was %.1fm ago (< {limit}m rate limit)."
PASS_TEXT = "OK"
DETAIL = {"dry_run": "dry-run; not dispatched", "skipped": "no target configured", "dispatched": "204"}


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def status(
    psi_max: Column, perf_drop: Column, pred_psi: Column, config: DriftConfig | None = None
) -> Column:
    """alert, warn or ok. A drop below its band never gives a warning of its own."""
    c = config or DriftConfig()
    psi, drop, pred = _or_zero(psi_max), _or_zero(perf_drop), _or_zero(pred_psi)
    alert = (psi >= c.psi_alert) | (drop >= c.perf_drop_alert) | (pred >= c.pred_alert)
    warn = (psi >= c.psi_warn) | (pred >= c.pred_warn)
    return F.when(alert, "alert").when(warn, "warn").otherwise("ok")


def guarded_status(n_samples: Column, status_column: Column, min_samples: int) -> Column:
    """no_data and insufficient_data come before any classification."""
    n = F.coalesce(n_samples, F.lit(0))
    return (
        F.when(n == 0, "no_data").when(n < min_samples, "insufficient_data").otherwise(status_column)
    )


def gate_message(
    psi_max: Column,
    perf_drop: Column,
    seconds_since: Column,
    config: DriftConfig,
    enabled: Column | None = None,
) -> Column:
    """OK, or the first failing rule in the order: switch, drift, performance, rate limit."""
    psi, drop = _or_zero(psi_max), _or_zero(perf_drop)
    on = F.lit(config.retrain_enabled) if enabled is None else enabled
    minutes = config.retrain_min_interval_minutes
    limited = seconds_since.isNotNull() & (seconds_since < minutes * 60)
    return (
        F.when(~on, F.lit(OFF_TEXT))
        .when(psi < config.psi_alert, F.format_string(PSI_TEXT.format(limit=config.psi_alert), psi))
        .when(
            drop < config.perf_drop_alert,
            F.format_string(DROP_TEXT.format(limit=config.perf_drop_alert), drop),
        )
        .when(limited, F.format_string(RATE_TEXT.format(limit=minutes), seconds_since / F.lit(60.0)))
        .otherwise(F.lit(PASS_TEXT))
    )


def dispatch_decision(message: Column, dry_run: Column | bool, configured: Column | bool) -> Column:
    """blocked, dry_run, skipped (no target is configured) or dispatched."""
    dry = F.lit(dry_run) if isinstance(dry_run, bool) else dry_run
    ready = F.lit(configured) if isinstance(configured, bool) else configured
    return (
        F.when(message != PASS_TEXT, "blocked")
        .when(dry, "dry_run")
        .when(~ready, "skipped")
        .otherwise("dispatched")
    )


def audit_rows(
    requests: DataFrame, ts: str, reason: Column, message: Column, decision: Column
) -> DataFrame:
    """Audit record of every request, allowed or not; texts are cut to 500 characters."""
    detail = F.when(decision == "blocked", message)
    for name, text in DETAIL.items():
        detail = detail.when(decision == name, F.lit(text))
    return requests.withColumns(
        {
            "decision": decision,
            "reason": F.substring(clean_reason(reason), 1, AUDIT_TEXT_LENGTH),
            "detail": F.nullif(F.substring(detail, 1, AUDIT_TEXT_LENGTH), F.lit("")),
            "ts": F.col(ts),
        }
    )


# How the outcome of a dispatch is told.
SENT_STATUS = 204
ERROR_DETAIL = "dispatch error"
STATUS_DETAIL = "status %d"


def settle_outbox(audits: DataFrame, results: DataFrame, request: str = "id") -> DataFrame:
    """Audits whose dispatches have got the outcome that came back for them later.

    results: (request, attempt, status) with a NULL status where nothing answered. Attempts are folded
    per request: a request is `dispatched` once any attempt was accepted, `blocked` with the newest
    attempt's failure as detail if none was, and `pending` while no result has come. Results of
    requests that were never to be dispatched, and repeated ones, change nothing. A pending request
    holds later ones back like a dispatched one, a failed one does not."""
    folded = results.where(F.col(request).isNotNull()).groupBy(request).agg(
        F.coalesce(F.bool_or(F.col("status") == SENT_STATUS), F.lit(False)).alias("_sent"),
        F.max_by(F.struct("status"), "attempt").alias("_newest"),
    )
    failure = F.coalesce(F.format_string(STATUS_DETAIL, F.col("_newest.status").cast("bigint")), F.lit(ERROR_DETAIL))
    failure = F.when(F.col("_newest.status").isNull(), F.lit(ERROR_DETAIL)).otherwise(failure)
    asked = F.col("decision") == "dispatched"
    return audits.join(folded, request, "left").select(
        *[c for c in audits.columns if c not in ("decision", "detail")],
        F.when(asked & F.col("_sent").isNull(), "pending").when(asked & ~F.col("_sent"), "blocked").otherwise(F.col("decision")).alias("decision"),
        F.when(asked & F.col("_sent").isNull(), F.lit(None).cast("string")).when(asked & ~F.col("_sent"), failure).otherwise(F.col("detail")).alias("detail"),
    )


def retrain_cooldown(
    candidates: DataFrame,
    keys: Sequence[str],
    ts: str,
    interval_minutes: int,
    last_dispatch: DataFrame | None = None,
) -> DataFrame:
    """Which candidate requests are dispatched when a dispatch blocks its key for a while.

    A request is dispatched if no earlier dispatch of its key lies within the interval, so
    every decision depends on earlier decisions. No key is folded in one task:

    * a request at least one interval after the previous request of its key is always
      dispatched, because the last dispatch cannot be later than that request;
    * after a dispatch at t the next one is the first request at or after t + interval;
      following that link from the sure dispatches reaches all others. Links are doubled
      in each round, so a chain of n dispatches takes about log2(n) joins on unique keys.

    Requests of one key with the same time count once; all of them get its decision.
    `last_dispatch` (keys, last) carries earlier dispatches in; requests before them are
    blocked.
    """
    keys = list(keys)
    interval = interval_minutes * 60 * 1_000_000
    stamped = candidates.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    walked = stamped.select(*keys, "_at")
    if last_dispatch is not None:
        before = last_dispatch.select(*keys, F.unix_micros(F.col("last").cast("timestamp")).alias("_last"))
        walked = (
            walked.join(before, keys, "left")
            .filter(F.col("_last").isNull() | (F.col("_at") >= F.col("_last")))
            .select(*keys, "_at")
            .unionByName(before.select(*keys, F.col("_last").alias("_at")))
        )
    distinct = materialise(walked.distinct(), "cooldown")
    asking = distinct.withColumn("_probe", F.lit(False)).unionByName(
        distinct.select(*keys, (F.col("_at") + interval).alias("_at"), F.lit(True).alias("_probe"))
    )
    placed = materialise(neighbours(asking, keys, "_at", "_probe"), "placed")
    sure = placed.filter(
        ~F.col("_probe")
        & (F.col("previous").isNull() | (F.col("_at") - F.col("previous") >= interval))
    ).select(*keys, "_at")
    links = placed.filter(F.col("_probe") & F.col("following").isNotNull()).select(
        *keys, (F.col("_at") - interval).alias("_at"), F.col("following").alias("_to")
    )
    flags = _reachable(sure, links, keys).withColumn("dispatched", F.lit(True))
    return (
        stamped.join(flags, [*keys, "_at"], "left")
        .withColumn("dispatched", F.coalesce("dispatched", F.lit(False)))
        .drop("_at")
    )


def _reachable(start: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """All rows on the chains that begin at `start`; each row has at most one link.

    Links are doubled in every round, so chains of n rows need about log2(n) rounds, and a
    history without crowded requests needs none.
    """
    reached = start
    while True:
        step = reached.join(links, [*keys, "_at"]).select(*keys, F.col("_to").alias("_at"))
        new = materialise(step.distinct().join(reached, [*keys, "_at"], "left_anti"), "reached")
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        onward = links.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        links = materialise(
            links.join(onward, [*keys, "_to"]).select(*keys, "_at", F.col("_next").alias("_to")),
            "links",
        )


def decide_requests(
    requests: DataFrame, key: str, ts: str, config: DriftConfig, enabled: Column, dry_run: Column, configured: Column
) -> DataFrame:
    """`message` and `decision` of every request of a history, as one batch job.

    Only requests that were dispatched or run dry hold later ones back: one that is skipped for
    want of a target does not. A request inside the interval names the minutes since the last
    dispatch of its key. Requests of one key and time get one decision.
    """
    open_gate = gate_message(F.col("psi_max"), F.col("perf_drop"), F.lit(None).cast("double"), config, enabled)
    asked = materialise(
        requests.withColumns({"message": open_gate, "_dry": dry_run, "_ready": configured}), "requests"
    )
    counts = (F.col("message") == PASS_TEXT) & (F.col("_dry") | F.col("_ready"))
    judged = retrain_cooldown(
        asked.filter(counts).select(key, ts).distinct(), [key], ts, config.retrain_min_interval_minutes
    )
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    sent = judged.filter("dispatched").select(key, micros.alias("_at"), F.lit(False).alias("_probe"))
    passed = asked.filter(F.col("message") == PASS_TEXT).select(key, micros.alias("_at"), F.lit(True).alias("_probe"))
    last = (
        neighbours(sent.unionByName(passed.distinct()), [key], "_at", "_probe")
        .filter("_probe")
        .select(key, F.col("_at").alias("_asked"), ((F.col("_at") - F.col("previous")) / F.lit(1e6)).alias("seconds_since"))
    )
    timed = asked.withColumn("_asked", micros).join(materialise(last, "last"), [key, "_asked"], "left")
    full = gate_message(F.col("psi_max"), F.col("perf_drop"), F.col("seconds_since"), config, enabled)
    return timed.withColumn("message", full).withColumn(
        "decision", dispatch_decision(F.col("message"), F.col("_dry"), F.col("_ready"))
    ).drop("_asked", "_dry", "_ready")


def alert_message(report_columns: dict[str, str] | None = None) -> Column:
    """Text of an alert from the columns of a report row."""
    names = {
        "status": "status",
        "psi_max": "psi_max",
        "perf_drop": "perf_drop",
        "pred": "prediction_drift_psi",
        "drifted": "drifted_features",
        "n": "n_samples",
        "labelled": "n_labeled",
        **(report_columns or {}),
    }
    # The layout of the message.
    drifted = F.coalesce(F.nullif(F.array_join(names["drifted"], ", "), F.lit("")), F.lit("none"))
    return F.format_string(
        ":warning: Model monitor — *%s*\n• psi_max: %.3f  • F1 drop: %.3f  • pred-PSI: %.3f\n"
        "• drifted features: %s\n• samples: %d (labeled %d)",
        F.upper(F.coalesce(F.col(names["status"]), F.lit("?"))),
        _or_zero(F.col(names["psi_max"])),
        _or_zero(F.col(names["perf_drop"])),
        _or_zero(F.col(names["pred"])),
        drifted,
        F.coalesce(F.col(names["n"]), F.lit(0)),
        F.coalesce(F.col(names["labelled"]), F.lit(0)),
    )


def alert_feed(checks: DataFrame) -> DataFrame:
    """Checks that need attention, with their message text."""
    return checks.filter(F.col("status").isin("warn", "alert")).withColumn("text", alert_message())


def threshold_violations(thresholds: DataFrame) -> DataFrame:
    """Rows of a per-model threshold table that break an invariant, with the broken rules.

    A NULL threshold breaks its rule.
    """

    def broken(rule: Column, name: str) -> Column:
        return F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))

    c = F.col
    rules = [
        broken((c("psi_warn") > 0) & (c("psi_warn") < c("psi_alert")), "psi_band"),
        broken((c("pred_warn") > 0) & (c("pred_warn") < c("pred_alert")), "pred_band"),
        broken((c("perf_drop_alert") > 0) & (c("perf_drop_alert") < 1), "perf_drop"),
        broken(c("min_samples") >= 1, "min_samples"),
        broken(c("label_delay_days") >= 0, "label_delay"),
    ]
    checked = thresholds.withColumn(
        "violations", F.filter(F.array(*rules), lambda r: r.isNotNull())
    )
    return checked.filter(F.size("violations") > 0)


def gate_confusion(decided: DataFrame, allowed: str, expected: str) -> DataFrame:
    """Confusion counts and rates over all scenarios (the rates divide by every scenario)."""
    a, e = F.col(allowed), F.col(expected)
    counted = decided.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a & e).alias("tp"),
        F.count_if(~a & ~e).alias("tn"),
        F.count_if(a & ~e).alias("fp"),
        F.count_if(~a & e).alias("fn"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    return counted.withColumns(
        {
            "accuracy": (F.col("tp") + F.col("tn")) / n,
            "false_trigger_rate": F.col("fp") / n,
            "missed_trigger_rate": F.col("fn") / n,
        }
    )
