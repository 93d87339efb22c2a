"""Whole runs that read and append tables: a check, a retrain request, a promotion."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import DriftConfig
from driftline.operators import models as ml
from driftline.operators.decisions import (
    PASS_TEXT,
    alert_feed,
    audit_rows,
    dispatch_decision,
    gate_message,
)
from driftline.operators.history import checks_with_verdicts, recent, seconds_since_dispatch
from driftline.operators.performance import label_slice
from driftline.operators.verdicts import extract_verdicts
from driftline.plans.checks import ModelSpec, ReferenceBundle, build_bundle, drift_report
from driftline.session import materialise, scratch_scope
from driftline.sources import sinks
from driftline.sources.tables import latest, lookback_window

RUN_METRICS = ("psi_max", "psi_mean", "ks_features_flagged", "perf_f1", "perf_drop")


@dataclass(frozen=True)
class MonitorTables:
    """Folders of the append tables, on storage that all executors share."""

    root: str

    @property
    def checks(self) -> str:
        return f"{self.root}/drift_checks"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def audits(self) -> str:
        return f"{self.root}/retrain_audits"

    @property
    def verdicts(self) -> str:
        return f"{self.root}/verdicts"

    @property
    def registry(self) -> str:
        return f"{self.root}/model_registry"

    @property
    def aliases(self) -> str:
        return f"{self.root}/model_aliases"


def run_check(
    reference: DataFrame | None,
    log: DataFrame,
    spec: ModelSpec,
    tables: MonitorTables,
    model: str,
    checked_at: datetime,
    hours: int = 24,
    config: DriftConfig | None = None,
    partition: str | None = None,
    bundle: ReferenceBundle | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Check the newest window, persist it, and return the report and its alert, if any.

    Guarded windows are recorded too; their status says so. With the model's bundle the
    reference is not needed. A repeated run replaces its own rows.
    """
    window = lookback_window(log, spec.ts, hours, partition)
    report = drift_report(reference, window, spec, config, bundle=bundle).withColumns(
        {"model": F.lit(model), "ts": F.lit(checked_at)}
    )
    rows = sinks.drift_check_rows(report, ["model", "ts"])
    sinks.put_rows(rows, tables.checks, f"{model}|{checked_at}")
    keyed = report.withColumns(
        {"id": F.concat_ws("|", "model", F.col("ts").cast("string")), "drift_status": F.col("status")}
    )
    run = sinks.run_rows(keyed, F.col("id"), RUN_METRICS, ["drift_status", "window_start", "window_end"])
    sinks.put_rows(run, tables.runs, f"{model}|{checked_at}")
    return report, alert_feed(report)


def record_verdicts(texts: DataFrame, check_id: str, text: str, tables: MonitorTables) -> DataFrame:
    """Take the verdict object out of each text and keep it under its check's id. The verdicts of a
    check that come again replace the ones before."""
    found = extract_verdicts(texts, check_id, text).select(
        F.col(check_id).alias("drift_check_id"), "diagnosis", "recommendations",
        F.col("trigger_retraining").alias("triggered_retraining"),
    )
    rows = materialise(sinks.verdict_rows(found), "verdicts")
    # A folder for each check, and only those of this call are replaced.
    named = rows.withColumn("event", F.md5("drift_check_id"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event").parquet(tables.verdicts)
    return rows


def report_list(spark: SparkSession, tables: MonitorTables, limit: int = 20) -> DataFrame:
    """The newest stored checks with their verdicts."""
    newest = recent(spark.read.parquet(tables.checks), "ts", limit=limit)
    return checks_with_verdicts(newest, spark.read.parquet(tables.verdicts).drop("event"))


def performance_view(checks: DataFrame, limit: int = 20) -> DataFrame:
    """Quality of the newest stored checks, from the reports kept with them."""
    field = lambda name, kind: F.get_json_object("report", f"$.{name}").cast(kind).alias(name)
    return recent(checks, "ts", limit=limit).select(
        "id", "ts", "status", "perf_f1", "perf_drop", field("baseline_f1", "double"), field("perf_roc_auc", "double"),
        field("label_coverage", "double"), field("n_samples", "bigint"), field("n_labeled", "bigint"), field("concept_drift", "boolean"),
    )


def request_retrain(
    report: DataFrame,
    reason: str,
    audits: DataFrame | None,
    tables: MonitorTables,
    now: datetime,
    config: DriftConfig | None = None,
    configured: bool = True,
) -> DataFrame:
    """Run one request through the gate and keep its audit row, whatever the outcome. The same request,
    by model and time, replaces its row, and its own row does not hold it back."""
    config = config or DriftConfig()
    requests = report.withColumns({"asked": F.lit(reason), "asked_at": F.lit(now)})
    if audits is None:
        since = requests.withColumn("seconds_since", F.lit(None).cast("double"))
    else:
        earlier = audits.where(F.col("ts") < F.lit(now))
        waited = seconds_since_dispatch(earlier, F.lit(now), ["model"]).select("model", "seconds_since")
        since = requests.join(waited, "model", "left")
    message = gate_message(F.col("psi_max"), F.col("perf_drop"), F.col("seconds_since"), config)
    judged = since.withColumn("message", message)
    decision = dispatch_decision(F.col("message"), config.retrain_dry_run, configured)
    rows = materialise(
        audit_rows(judged, "asked_at", F.col("asked"), F.col("message"), decision)
        .withColumn("allowed", F.col("message") == PASS_TEXT)
        .select("model", "ts", "decision", "reason", "psi_max", "perf_drop", "detail", "allowed"),
        "audit",
    )
    models = "|".join(sorted(str(r.model) for r in rows.select("model").collect()))
    sinks.put_rows(rows.drop("allowed"), tables.audits, f"{models}|{now}")
    return rows


def train_and_persist(
    spark: SparkSession,
    training: DataFrame,
    features: list[str],
    label: str,
    key: str,
    tables: MonitorTables,
    model: str,
    version: int,
    segment: str | None = None,
    fingerprint: DataFrame | None = None,
    alias: str | None = "champion",
    trees: int = ml.TREES,
) -> ml.TrainedModel:
    """Train on a table, keep the model with the bundle of its scored reference and the reference
    rows as a version, log the run and register the version."""
    trained = ml.train(training, features, label, key, trees=trees)
    keep_version(spark, training, trained, label, key, tables, model, version, segment, fingerprint, alias)
    return trained


def keep_version(
    spark: SparkSession,
    training: DataFrame,
    trained: ml.TrainedModel,
    label: str,
    key: str,
    tables: MonitorTables,
    model: str,
    version: int,
    segment: str | None = None,
    fingerprint: DataFrame | None = None,
    alias: str | None = "champion",
) -> None:
    """Everything of a version, its registry row last: a version counts once it is registered. A try that
    failed anywhere before is run again over what it left; a registered version is not touched."""
    if sinks.is_registered(spark, tables.registry, model, version):
        return
    path = f"{tables.root}/models/{model}/v={version}"
    ml.save_model(spark, trained, path)
    spec = ModelSpec(trained.features, "", key, trained.threshold, label=label, segment=segment)
    with scratch_scope(spark):
        columns = dict.fromkeys([key, label, *trained.features, *([segment] if segment else [])])
        scored = ml.batch_score(training.select(*columns), trained).filter("NOT quarantined")
        build_bundle(scored, spec, fingerprint).save(f"{path}/reference")
    reference = sinks.save_reference(training, f"{tables.root}/reference/{model}", version, again=True)
    log_run(spark, tables, f"{model}|v={version}", trained, {"model": model, "version": str(version), "kind": "train"})
    if alias is not None:
        sinks.move_alias(spark, tables.aliases, model, alias, version, f"register v={version}")
    sinks.register_version(spark, tables.registry, model, version, alias, reference)


def log_run(spark: SparkSession, tables: MonitorTables, run_id: str, trained: ml.TrainedModel, tags: dict[str, str]) -> None:
    metrics = {
        "f1": trained.baseline_f1, "f1_default": trained.f1_default, "roc_auc": trained.auc,
        "decision_threshold": trained.threshold, "n_train": float(trained.n_train), "n_test": float(trained.n_test),
    }
    row = spark.createDataFrame(
        [(run_id, metrics, tags)], "run_id string, metrics map<string, double>, tags map<string, string>"
    )
    sinks.put_rows(row, tables.runs, run_id)


def evaluate_and_promote(
    spark: SparkSession,
    training: DataFrame,
    log: DataFrame,
    features: list[str],
    label: str,
    key: str,
    ts: str,
    tables: MonitorTables,
    model: str,
    version: int,
    champion_path: str | None = None,
    epsilon: float = 0.0,
    hours: int = 24 * 30,
    label_delay_days: int = 0,
    trees: int = ml.TREES,
    segment: str | None = None,
    fingerprint: DataFrame | None = None,
) -> DataFrame:
    """Train a challenger, compare it with the champion on the newest labelled window, and
    save and register it if it is at least as good.

    Both models score the window in one union, and their F1 comes from one aggregation.
    """
    challenger = ml.train(training, features, label, key, trees=trees)
    sides = [("challenger", challenger)]
    if champion_path is not None:
        sides.append(("champion", ml.load_model(spark, champion_path)))
    window = lookback_window(log, ts, hours)
    newest = latest(window, ts)
    if newest is not None:
        window = label_slice(window, ts, newest, label_delay_days)
    window = window.select(key, F.col(label).alias("label"), *features)
    scored = None
    for name, side in sides:
        part = ml.batch_score(window, side).select(F.lit(name).alias("version"), "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    versions = spark.createDataFrame(
        [(name, side.baseline_f1, side.n_test) for name, side in sides],
        "version string, baseline_f1 double, n_heldout bigint",
    )
    decision = materialise(ml.promotion_decision(scored, versions, epsilon), "promotion")
    outcome = decision.first()
    tags = {"model": model, "version": str(version), "kind": "promotion", "reason": outcome["reason"]}
    log_run(spark, tables, f"{model}|v={version}|promotion", challenger, tags)
    if outcome["promoted"]:
        keep_version(spark, training, challenger, label, key, tables, model, version, segment, fingerprint)
    return decision


