"""Drift checks as one job: a single report with attribution, or one row per (model, window)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import ROWS_PER_SLICE, TEMPORAL_SLICES, DriftConfig
from driftline.functions.scalars import f1_from_counts
from driftline.operators import attribution as a
from driftline.operators import sketches as sk
from driftline.operators.decisions import guarded_status, status
from driftline.operators.drift import NEUTRAL_FEATURE, compare, drift_summary, feature_psi
from driftline.operators.performance import (
    arrived,
    confusion_counts,
    f1_at_threshold,
    binned_auc,
    performance_vs_baseline,
    roc_auc,
)
from driftline.operators.profile import ReferenceProfile, build_profile, load_profile, reference_long, value_counts
from driftline.session import materialise, scratch_scope
from driftline.sources.tables import moment


@dataclass(frozen=True)
class ModelSpec:
    """Names of the columns of a scored log, and the operating point of the model."""

    features: tuple[str, ...]
    ts: str
    row_key: str
    threshold: float
    score: str = "score"
    label: str = "label"
    segment: str | None = None


_KINDS = {bool: "boolean", float: "double", str: "string"}
_FEATURE = ", ".join(f"{name}: {_KINDS[type(value)]}" for name, value in NEUTRAL_FEATURE.items())
# The columns of every report, whether the window was checked or guarded; `time` is the log's type.
REPORT = {
    "status": "string", "psi_max": "double", "psi_mean": "double", "ks_features_flagged": "bigint",
    "max_missing_rate_delta": "double", "max_abs_missing_rate_delta": "double", "drifted_features": "array<string>",
    "by_feature": f"array<struct<feature: string, {_FEATURE}>>", "prediction_drift_psi": "double",
    "n_slices": "bigint", "n_breached": "bigint", "sustained": "boolean",
    "temporal": "array<struct<slice: int, n: bigint, psi_max: double>>",
    "segments": "array<struct<segment: string, n: bigint, psi_max: double, status: string>>",
    "n_samples": "bigint", "n_labeled": "bigint", "n_unscored": "bigint", "label_coverage": "double",
    "baseline_f1": "double", "perf_f1": "double", "perf_drop": "double", "perf_roc_auc": "double",
    "concept_drift": "boolean", "decision_threshold": "double", "n_ref_rows": "bigint", "reference_hash": "bigint",
    "window_start": "time", "window_end": "time",
    "mode": "string", "psi_error": "double", "ks_error": "double", "auc_error": "double",
}
# What a window that was not measured shows; all other measures are NULL.
UNMEASURED = {"psi_max": 0.0, "psi_mean": 0.0, "ks_features_flagged": 0, "n_labeled": 0, "n_unscored": 0}


def as_report(row: DataFrame, kind: str) -> DataFrame:
    """Exactly the columns of REPORT; those that the row lacks are NULL."""
    types = {c: kind if t == "time" else t for c, t in REPORT.items()}
    return row.select(
        *[(F.col(c) if c in row.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    )


def history(
    reference: DataFrame,
    log: DataFrame,
    spec: ModelSpec,
    model: str,
    window: str,
    config: DriftConfig,
    expected: DataFrame | None = None,
) -> DataFrame:
    """One drift check per (model, window) of a log that carries both as columns.

    `expected` holds the (model, window) pairs that must have a check; those without rows get
    `no_data`. A model without a reference has the status `no_reference`. Windows that were not
    measured show the same neutral values as a guarded report.

    The reference profile is built once per model. The log is scanned once for the cell
    counts of all features and the score, and once for confusion counts and times; both combine
    map-side, so what is shuffled grows with models and windows, not with rows.
    """
    columns = [*spec.features, spec.score]
    profile = build_profile(reference, columns, [model], numeric=[spec.score])
    psi = feature_psi(log, columns, profile, [window])
    is_score = F.col("feature") == spec.score
    drift = psi.groupBy(model, window).agg(
        F.max(F.when(~is_score, F.col("psi"))).alias("psi_max"),
        F.avg(F.when(~is_score, F.col("psi"))).alias("psi_mean"),
        F.max(F.when(is_score, F.col("psi"))).alias("prediction_drift_psi"),
        F.array_sort(
            F.collect_list(
                F.when(~is_score & (F.col("psi") >= config.psi_alert), F.col("feature"))
            )
        ).alias("drifted_features"),
    )
    baseline = f1_at_threshold(reference, spec.threshold, [model], score=spec.score, label=spec.label)
    counts = confusion_counts(
        log,
        spec.threshold,
        [model, window],
        score=spec.score,
        label=spec.label,
        carry=[F.min(spec.ts).alias("window_start"), F.max(spec.ts).alias("window_end")],
    )
    if expected is not None:
        counts = expected.select(model, window).distinct().join(counts, [model, window], "left").fillna(
            0, ["n_samples", "n_labeled", "n_unscored", "tp", "fp", "fn", "tn"]
        )
    measured = performance_vs_baseline(
        counts.join(baseline.select(model, F.col("f1").alias("_base")), model, "left"), F.col("_base"), config
    )
    verdict = F.when(F.col("_base").isNull(), "no_reference").otherwise(
        status(F.col("psi_max"), F.col("perf_drop"), F.col("prediction_drift_psi"), config)
    )
    checked = (
        measured.join(drift, [model, window], "left")
        .withColumn("status", guarded_status(F.col("n_samples"), verdict, config.min_samples))
        .withColumn("ts", F.col("window_end"))
        .withColumn("id", F.concat_ws("|", F.col(model), F.col(window).cast("string")))
    )
    seen = ~F.col("status").isin("no_data", "insufficient_data", "no_reference")
    neutral = {c: F.when(seen, F.col(c)).otherwise(F.lit(UNMEASURED.get(c)).cast(checked.schema[c].dataType))
               for c in ("psi_max", "psi_mean", "prediction_drift_psi", "n_labeled", "n_unscored",
                         "perf_f1", "perf_drop", "concept_drift", "label_coverage")}
    none = F.array().cast("array<string>")
    return checked.withColumns({**neutral, "drifted_features": F.when(seen, F.col("drifted_features")).otherwise(none)}).drop(
        "_base", "tp", "fp", "fn", "tn"
    )


@dataclass(frozen=True)
class ReferenceBundle:
    """What a check needs of a reference, as kept with its model.

    `counts` holds the distinct readings of the features and the score with their number,
    `segments` a profile for each segment, `baseline` F1 and rows, `fingerprint` the hash.
    """

    counts: DataFrame
    segments: ReferenceProfile | None
    baseline: tuple[float, int]
    fingerprint: int | None = None

    def save(self, path: str) -> None:
        spark = self.counts.sparkSession
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        if self.segments is not None:
            self.segments.save(f"{path}/segments")
        spark.createDataFrame(
            [(*self.baseline, self.fingerprint, self.segments.keys[0] if self.segments else None)],
            "f1 double, n_rows bigint, fingerprint bigint, segment string",
        ).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> ReferenceBundle:
    meta = spark.read.parquet(f"{path}/meta").first()
    segments = load_profile(spark, f"{path}/segments", [meta["segment"]]) if meta["segment"] else None
    counts = spark.read.parquet(f"{path}/counts")
    return ReferenceBundle(counts, segments, (meta["f1"], meta["n_rows"]), meta["fingerprint"])


def build_bundle(reference: DataFrame, spec: ModelSpec, fingerprint: DataFrame | None = None) -> ReferenceBundle:
    """The bundle of a scored reference; nothing is lost, so checks from it are exact."""
    counts = value_counts(reference_long(reference, [*spec.features, spec.score]), None)
    segments = build_profile(reference, list(spec.features), [spec.segment]) if spec.segment else None
    base = confusion_counts(reference, spec.threshold, score=spec.score, label=spec.label).select(
        f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "n_samples"
    ).first()
    known = None if fingerprint is None else fingerprint.first()["fingerprint"]
    return ReferenceBundle(
        counts.select("feature", "value", "n_ref"), segments, (base["f1"], base["n_samples"]), known
    )


def drift_report(
    reference: DataFrame | None,
    production: DataFrame,
    spec: ModelSpec,
    config: DriftConfig | None = None,
    fingerprint: DataFrame | None = None,
    baseline: tuple[float, int] | None = None,
    bundle: ReferenceBundle | None = None,
    mode: str = "exact",
) -> DataFrame:
    """The whole check of one production window as one row.

    `mode="approximate"` takes all distributions from sketches: each side is scanned once, and what is
    shuffled does not grow with the rows. `psi_error`, `ks_error` and `auc_error` bound the difference to
    the exact report (0 there): of the largest PSI of a feature, of a KS statistic, and of the AUC.
    Categories are decided on the whole reference also inside segments, and slices end near, not
    exactly at, equal parts. It needs the reference's rows, so no bundle.

    With a `bundle` the reference is not read and may be None. `baseline` is (F1, reference
    rows); without it or a bundle both are measured on the reference.

    A window that is empty or too small gives the same columns with its guard status, so
    that every run leaves a record. The work is done when this returns: the one row of the result
    is held by the driver, and the intermediate tables are deleted.
    """
    spark = production.sparkSession
    if mode not in ("exact", "approximate") or (mode == "approximate" and bundle is not None):
        raise ValueError("mode is exact, or approximate without a bundle")
    with scratch_scope(spark):
        row = _report(reference, production, spec, config or DriftConfig(), fingerprint, baseline, bundle, mode)
        return spark.createDataFrame(row.collect(), row.schema)


def _report(
    reference: DataFrame | None,
    production: DataFrame,
    spec: ModelSpec,
    config: DriftConfig,
    fingerprint: DataFrame | None,
    baseline: tuple[float, int] | None,
    bundle: ReferenceBundle | None,
    mode: str = "exact",
) -> DataFrame:
    spark = production.sparkSession
    if bundle is not None:
        baseline = bundle.baseline
        kept = bundle.segments.keys[0] if bundle.segments is not None else None
        if spec.segment and kept != spec.segment:
            raise ValueError(f"the bundle has no profile by {spec.segment}, but by {kept}")
    # Each side is scanned once, for the needed columns; all that follows reads the slim copies.
    needed = [*spec.features, spec.score, spec.label, *([spec.segment] if spec.segment else [])]
    production = materialise(production.select(*dict.fromkeys([spec.ts, spec.row_key, *needed])), "window")
    facts = production.agg(
        F.count(F.lit(1)).alias("n"), F.min(spec.ts).alias("start"), F.max(spec.ts).alias("end")
    )
    n, start, end = facts.first()
    kind = production.schema[spec.ts].dataType
    if n < config.min_samples:
        return _guard_row(spark, kind.simpleString(), n, start, end)

    features = list(spec.features)
    if bundle is None:
        reference = materialise(reference.select(*dict.fromkeys(needed)), "reference")
    if mode == "approximate":
        parts, segments = _sketched(reference, production, spec, config, n)
    else:
        parts, segments = _measured(reference, production, spec, config, bundle)

    in_time = arrived(F.col(spec.ts), moment(end, kind), config.label_delay_days)
    counts = confusion_counts(
        production, spec.threshold, score=spec.score, label=spec.label, labelled=in_time
    )
    labelled = production.filter(in_time) if config.label_delay_days > 0 else production
    auc = binned_auc if mode == "approximate" else roc_auc
    area = auc(labelled, score=spec.score, label=spec.label)
    area = area.select("roc_auc", *([] if mode == "exact" else ["auc_error"]))
    if baseline is not None:
        base = spark.createDataFrame([baseline], "_base double, n_ref_rows bigint")
    else:
        base = confusion_counts(
            reference, spec.threshold, score=spec.score, label=spec.label
        ).select(
            f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")).alias("_base"),
            F.col("n_samples").alias("n_ref_rows"),
        )
    parts += [counts, area, base]
    if segments is not None:
        parts.append(
            segments.agg(
                F.array_sort(
                    F.collect_list(
                        F.struct(F.col(spec.segment).cast("string").alias("segment"), "n", "psi_max", "status")
                    )
                ).alias("segments")
            )
        )
    if bundle is not None:
        parts.append(spark.createDataFrame([(bundle.fingerprint,)], "reference_hash bigint"))
    elif fingerprint is not None:
        parts.append(fingerprint.select(F.col("fingerprint").alias("reference_hash")))
    joined = _one_row(parts)
    measured = performance_vs_baseline(joined, F.col("_base"), config)
    row = measured.withColumns(
        {
            "perf_roc_auc": F.when(F.col("perf_f1").isNotNull(), F.col("roc_auc")),
            "status": status(F.col("psi_max"), F.col("perf_drop"), F.col("prediction_drift_psi"), config),
            "decision_threshold": F.lit(spec.threshold),
            "mode": F.lit(mode),
            **({} if mode == "approximate" else {c: F.lit(0.0) for c in ("psi_error", "ks_error", "auc_error")}),
            "window_start": moment(start, kind),
            "window_end": moment(end, kind),
        }
    )
    return as_report(row, kind.simpleString())


def _measured(
    reference: DataFrame | None, production: DataFrame, spec: ModelSpec, config: DriftConfig, bundle: ReferenceBundle | None
) -> tuple[list[DataFrame], DataFrame | None]:
    """One-row parts of the report on distributions, and the segments, exactly."""
    features = list(spec.features)
    found, profile = compare(
        reference, production, [*features, spec.score], config, numeric=[spec.score],
        saved=bundle.counts if bundle else None,
    )
    table = materialise(found, "drift")
    is_score = F.col("feature") == spec.score
    summary = drift_summary(table.filter(~is_score))
    score_psi = table.filter(is_score).select(F.col("psi").alias("prediction_drift_psi"))
    sliced = a.add_slice(production, spec.ts, spec.row_key)
    by_slice = feature_psi(sliced, features, profile, ["slice"])
    temporal = materialise(
        a.slice_bounds(sliced, spec.ts).join(
            by_slice.groupBy("slice").agg(F.round(F.max("psi"), 4).alias("psi_max")), "slice"
        ),
        "temporal",
    )
    sustained = a.sustained(temporal, config.psi_alert)
    slices = temporal.agg(F.array_sort(F.collect_list(F.struct("slice", "n", "psi_max"))).alias("temporal"))

    segments = None
    if spec.segment:
        segments = a.segment_drift(
            reference, production, features, spec.segment, profile=bundle.segments if bundle else None
        )
    return [summary, sustained, slices, score_psi], segments


def _sketched(
    reference: DataFrame, production: DataFrame, spec: ModelSpec, config: DriftConfig, n: int
) -> tuple[list[DataFrame], DataFrame | None]:
    """The same from sketches by slice and segment, which merge into those of the whole window."""
    columns = [*spec.features, spec.score]
    own = [spec.segment] if spec.segment else []
    count = min(TEMPORAL_SLICES, max(1, n // ROWS_PER_SLICE))
    micros = F.unix_micros(F.col(spec.ts).cast("timestamp"))
    shares = [k / count for k in range(1, count)]
    cuts = production.agg(F.percentile_approx(micros, shares, 10_000)).first()[0] if shares else []
    number = F.lit(0)
    for cut in cuts:
        number = number + (micros > cut).cast("int")
    sliced = production.withColumn("slice", number)
    keys = ["slice", *own]
    prod = materialise(sk.sketch(sliced, columns, keys), "window_sketches")
    ref = materialise(sk.sketch(reference, columns, own, quarantine=True), "reference_sketches")
    categorical = sk.categorical_names(ref, [spec.score])
    prod_values = materialise(sk.value_table(sliced, categorical, keys), "window_values")
    ref_values = materialise(sk.value_table(reference, categorical, own, quarantine=True), "reference_values")

    def compared(by: list[str], ref_by: list[str]) -> DataFrame:
        counted = lambda rows, k: rows.groupBy(*k, "feature", "value").agg(F.sum("n").alias("n"))
        return sk.sketch_drift(
            sk.merge(ref, ref_by), sk.merge(prod, by), counted(ref_values, ref_by), counted(prod_values, by), categorical, config, by,
            len(columns) if not ref_by else None,
        )

    is_score = F.col("feature") == spec.score
    table = materialise(compared([], []), "drift")
    errors = table.agg(
        F.max(F.greatest(F.col("psi_high") - F.col("psi"), F.col("psi") - F.col("psi_low"))).alias("psi_error"), F.max("ks_error").alias("ks_error")
    )
    score_psi = table.filter(is_score).select(F.col("psi").alias("prediction_drift_psi"))
    by_slice = compared(["slice"], []).filter(~is_score).groupBy("slice").agg(F.round(F.max("psi"), 4).alias("psi_max"))
    temporal = materialise(a.slice_bounds(sliced, spec.ts).join(by_slice, "slice"), "temporal")
    slices = temporal.agg(F.array_sort(F.collect_list(F.struct("slice", "n", "psi_max"))).alias("temporal"))
    segments = None
    if own:
        known = ref.select(*own).distinct()
        listed = a.segment_list(production, known, spec.segment)
        worst = compared(own, own).filter(~is_score).groupBy(*own).agg(F.round(F.max("psi"), 4).alias("psi_max"))
        worst = materialise(worst, "by_segment")
        found = listed.join(worst, spec.segment, "left")
        segments = found.select(spec.segment, "n", F.when(F.col("status") == "checked", F.col("psi_max")).alias("psi_max"), "status")
    return [drift_summary(table.filter(~is_score)), a.sustained(temporal, config.psi_alert), slices, score_psi, errors], segments


def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Put single-row results side by side, by a join on a constant key."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    joined = keyed[0]
    for part in keyed[1:]:
        joined = joined.join(part, "_one")
    return joined.drop("_one")


def _guard_row(spark, kind: str, n: int, start, end) -> DataFrame:
    row = spark.createDataFrame([(n, start, end)], f"n_samples bigint, window_start {kind}, window_end {kind}").withColumns(
        {c: F.lit(v) for c, v in UNMEASURED.items()}
    )
    small = F.when(F.col("n_samples") == 0, "no_data").otherwise("insufficient_data")
    return as_report(row.withColumns({"status": small, "drifted_features": F.array()}), kind)
