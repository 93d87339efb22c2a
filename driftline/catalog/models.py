"""Queries on perturbation, backtests, training, promotion, the full report and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import sql as q
from driftline.catalog.attribution import segment_sql, sustained_sql, temporal_sql
from driftline.catalog.drift import DRIFT_PROD, DRIFT_REF, EV_PROD, EV_REF, fingerprint_sql
from driftline.config import DriftConfig
from driftline.functions.scalars import hash_uniform, out
from driftline.operators import models as ml
from driftline.operators import perturb as x
from driftline.operators.profile import dataset_fingerprint
from driftline.operators.verdicts import extract_verdicts
from driftline.plans import backtest as bt
from driftline.plans import datasets as ds
from driftline.plans.checks import ModelSpec, build_bundle, drift_report, load_bundle
from driftline.session import materialise, scratch_path
from driftline.sources.tables import lookback_window, read_table

SPEC = ModelSpec(tuple(ds.EVENT_FEATURES), "ts", "event_id", ds.DECISION_THRESHOLD, segment="event_type")
REPORT_HOURS = 168
REPORT_DELAY_DAYS = 2
BACKTEST_SHIFTS = (
    x.Shift("value", scale=-0.35, offset=-40.0, uniform_width=30.0),
    x.Shift("k", offset=18.0, uniform_width=4.0, low=0.0, high=99.0),
)
SHIFTS = (
    x.Shift("value", scale=-0.35, offset=-40.0, normal_sd=15.0),
    x.Shift("k", scale=-0.5, low=0.0, high=60.0, rounded=True),
    x.Shift("hour", poisson_rate=1.5, low=0.0, high=20.0),
)
INTENSITY = 0.8
SEEDS = tuple(range(30))


def inject_covariate_shift(spark: SparkSession, folder: str) -> DataFrame:
    ev = ds.events(spark, folder).withColumn("hour", F.hour("ts").cast("double"))
    shifted = x.inject_covariate_shift(ev, SHIFTS, INTENSITY, ["event_id"], 11)
    return shifted.select("event_id", out(F.col("value"), 4).alias("value"), "k", "hour")


def inject_label_flip(spark: SparkSession, folder: str) -> DataFrame:
    ev = ds.events(spark, folder)
    flipped = x.inject_label_flip(ev, "label", F.col("value") > 50.0, INTENSITY, ["event_id"], 11)
    return flipped.select("event_id", "label")


def bootstrap_jitter(spark: SparkSession, folder: str) -> DataFrame:
    """As many draws as the pool has rows."""
    pool = ds.events(spark, folder).select("event_id", "value", "k")
    n = pool.count()
    drawn = x.bootstrap_jitter(pool, n, "event_id", ["value", "k"], ["k"], seed=5)
    return drawn.select("draw_id", "source_event_id", out(F.col("value"), 4).alias("value"), "k")


def _batches(spark: SparkSession, folder: str, scenarios, seeds) -> tuple[DataFrame, DataFrame]:
    ref, prod = ds.split(ds.scored_events(spark, folder), "ts", ds.EVENT_SPLIT)
    fanned = bt.scenario_batches(
        prod, scenarios, seeds, BACKTEST_SHIFTS, F.col("value") > 30.0, "event_id", "label"
    )
    return ref, ds.with_score(fanned)


RATES = [
    "data_drift_detection_rate", "warn_or_alert_rate", "concept_drift_detection_rate",
    "any_alert_rate", "mean_psi_max", "mean_f1_drop",
]


def detector_backtest(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = ds.split(ds.scored_events(spark, folder), "ts", ds.EVENT_SPLIT)
    rows = bt.factorised_trials(ref, prod, SPEC, bt.SCENARIOS, SEEDS, BACKTEST_SHIFTS, F.col("value") > 30.0, ds.with_score)
    rates = bt.detection_rates(rows)
    return rates.select(
        "mode", "intensity", "trials", *[out(F.col(c)).alias(c) for c in RATES],
        "expected_data_drift", "expected_concept_drift",
    )


def detector_comparison(spark: SparkSession, folder: str) -> DataFrame:
    measured = list(dict.fromkeys(bt.standing_for(bt.COMPARISON).values()))
    ref, batches = _batches(spark, folder, measured, SEEDS[:1])
    return bt.detector_comparison(ref, batches, ds.EVENT_FEATURES)


def _fingerprint(ref: DataFrame) -> DataFrame:
    return dataset_fingerprint(
        ref,
        [
            *[F.col(c).cast("string") for c in ("event_id", "user_id", "event_type", "label")],
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            *[F.col(c).cast("decimal(18,4)").cast("string") for c in ("value", "k", "score")],
        ],
    )


def report_frame(spark: SparkSession, folder: str, hours: int = REPORT_HOURS) -> DataFrame:
    log = ds.drifting_events(spark, folder)
    ref, prod = ds.split(log, "ts", ds.EVENT_SPLIT)
    window = lookback_window(prod, "ts", hours)
    config = DriftConfig(label_delay_days=REPORT_DELAY_DAYS)
    return drift_report(ref, window, SPEC, config, _fingerprint(ref))


REPORT_FLOATS = [
    "psi_max", "psi_mean", "max_missing_rate_delta", "prediction_drift_psi", "perf_f1", "perf_drop",
    "perf_roc_auc", "baseline_f1", "label_coverage", "decision_threshold",
]


def _parts(column: str, name: str):
    return F.array_join(
        F.transform(column, lambda p: F.concat_ws(":", p[name].cast("string"), p["n"].cast("string"), F.format_number(p["psi_max"], 4))), ";"
    )


def drift_report_query(spark: SparkSession, folder: str) -> DataFrame:
    return _report_columns(report_frame(spark, folder))


def drift_report_from_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The same report from what is kept with the model: saved, loaded, and without the reference."""
    ref, prod = ds.split(ds.drifting_events(spark, folder), "ts", ds.EVENT_SPLIT)
    path = scratch_path(spark, "bundle")
    build_bundle(ref, SPEC, _fingerprint(ref)).save(path)
    window = lookback_window(prod, "ts", REPORT_HOURS)
    config = DriftConfig(label_delay_days=REPORT_DELAY_DAYS)
    return _report_columns(drift_report(None, window, SPEC, config, bundle=load_bundle(spark, path)))


def drift_report_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """A window below the least number of rows: the same columns, with the guard's status."""
    ref, prod = ds.split(ds.drifting_events(spark, folder), "ts", ds.EVENT_SPLIT)
    rows = prod.count()
    return _report_columns(drift_report(ref, prod, SPEC, DriftConfig(min_samples=rows + 1)))


# The measures that the approximate report is held against, and the error it states for each.
APPROXIMATED = {"psi_max": "psi_error", "prediction_drift_psi": "psi_error", "perf_roc_auc": "auc_error", "perf_f1": None, "max_missing_rate_delta": None}


def drift_report_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """The report from sketches next to the exact one: the exact measures, and whether the approximate
    ones are within the error that their own report states (which has to be small itself)."""
    log = ds.drifting_events(spark, folder)
    ref, prod = ds.split(log, "ts", ds.EVENT_SPLIT)
    window = lookback_window(prod, "ts", REPORT_HOURS)
    config = DriftConfig(label_delay_days=REPORT_DELAY_DAYS)
    exact, rough = (drift_report(ref, window, SPEC, config, mode=m) for m in ("exact", "approximate"))
    sides = exact.select([F.col(c).alias(f"e_{c}") for c in APPROXIMATED] + [F.lit(1).alias("one")]).join(
        rough.select(*[F.col(c).alias(f"a_{c}") for c in APPROXIMATED], "psi_error", "ks_error", "auc_error", F.lit(1).alias("one")), "one"
    )
    small = F.expr("psi_error <= 0.05 + 0.1 * a_psi_max AND ks_error <= 0.01 AND auc_error <= 0.01")

    def held(name: str, error: str | None):
        allowed = (F.col(error) if error else F.lit(0.0)) + F.lit(1e-9)
        close = F.abs(F.col(f"a_{name}") - F.col(f"e_{name}")) <= allowed
        return F.struct(F.lit(name).alias("measure"), out(F.col(f"e_{name}")).alias("exact"), (close & small).alias("within"))

    return sides.select(F.inline(F.array(*[held(*x) for x in APPROXIMATED.items()])))


def _report_columns(report: DataFrame) -> DataFrame:
    return report.select(
        "status", *[out(F.col(c)).alias(c) for c in REPORT_FLOATS], "ks_features_flagged",
        F.array_join("drifted_features", ",").alias("drifted_features"), "sustained", "concept_drift",
        "n_samples", "n_labeled", "n_ref_rows", "reference_hash", "window_start", "window_end",
        _parts("temporal", "slice").alias("temporal"), _parts("segments", "segment").alias("segments"),
    )


def _scored_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two deterministic scores on the last 30 days: the usual one, and one without `k`, which is
    missing for one row in twenty."""
    log = lookback_window(ds.drifting_events(spark, folder), "ts", 24 * 30)
    simple = ds.round_to(F.lit(0.3) + F.lit(0.006) * F.col("value"), 4)
    scored_by = hash_uniform(["event_id"], "unscored") >= 0.05
    both = F.array(
        F.struct(F.lit("champion").alias("version"), F.col("score").alias("s"), F.lit(ds.DECISION_THRESHOLD).alias("t")),
        F.struct(F.lit("challenger").alias("version"), F.when(scored_by, simple).alias("s"), F.lit(0.6).alias("t")),
    )
    scored = log.select("label", F.inline(both)).select(
        "version", "label", (F.col("s") >= F.col("t")).cast("int").alias("prediction")
    )
    ref, _ = ds.split(ds.drifting_events(spark, folder), "ts", ds.EVENT_SPLIT)
    held = ref.agg(F.count(F.lit(1)).alias("n_heldout"))
    versions = held.select(
        F.explode(F.array(F.lit("champion"), F.lit("challenger"))).alias("version"),
        F.lit(0.7).alias("baseline_f1"), "n_heldout",
    )
    return scored, versions


def champion_challenger(spark: SparkSession, folder: str) -> DataFrame:
    scored, versions = _scored_versions(spark, folder)
    found = ml.promotion_decision(scored, versions)
    return found.withColumns({c: out(F.col(c)) for c in ("champion_f1", "challenger_f1")})


def _training_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ds.events(spark, folder).select("event_id", "ts", "value", "k", "label")


def train_baseline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on the events. The trees are MLlib's own, so of the measures the query gives
    what must hold whatever the trees are."""
    model = ml.train(_training_rows(spark, folder), ["value", "k"], "label", "event_id")
    facts = (
        model.n_train, model.n_test, 0.0 < model.baseline_f1 <= 1.0, model.baseline_f1 >= model.f1_default,
        0.5 < model.auc <= 1.0, 0.0 < model.threshold < 1.0,
    )
    return spark.createDataFrame(
        [facts],
        "n_train bigint, n_test bigint, f1_in_range boolean, tuned_is_best boolean, auc_above_chance boolean, threshold_in_range boolean",
    )


def batch_score(spark: SparkSession, folder: str) -> DataFrame:
    """Train on the reference part, save, load, and score every event; one event in fifty has an
    infinite reading and is quarantined."""
    rows = _training_rows(spark, folder)
    ref, _ = ds.split(rows, "ts", ds.EVENT_SPLIT)
    path = scratch_path(spark, "model")
    ml.save_model(spark, ml.train(ref, ["value", "k"], "label", "event_id"), path)
    broken = hash_uniform(["event_id"], "infinite") < 0.02
    model = ml.load_model(spark, path)
    scored = ml.batch_score(rows.withColumn("value", F.when(broken, float("inf")).otherwise(F.col("value"))), model)
    decided = F.col("prediction") == (F.col("score") >= model.threshold).cast("int")
    return scored.select(
        "event_id", "quarantined", F.col("score").between(0.0, 1.0).alias("score_in_range"), decided.alias("decided_by_threshold")
    )


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with JSON added by role and turn: a verdict, a bare object before
    one, a broken one, or nothing."""
    c = read_table(spark, folder, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    verdict = F.format_string(
        ' Result: {"diagnosis": "case %s", "recommendations": [{"action": "retrain", "priority": "high", "reason": "psi"}], '
        '"trigger_retraining": %s} done',
        key, (F.col("turn") == 1).cast("string"),
    )
    bare = F.lit(' first {"note": {"a": 1}} then')
    text = (
        F.when((F.col("role") == "assistant") & (F.col("turn") == 1), F.concat("text", verdict))
        .when(F.col("role") == "assistant", F.concat(bare, F.col("text"), verdict))
        .when(F.col("turn") == 0, F.concat(bare, F.col("text")))
        .otherwise(F.concat(F.col("text"), F.lit(' {"diagnosis": broken} {')))
    )
    return c.select(key.alias("key"), text.alias("text"))


def verdict_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of every transcript that has one, with the digest of its object."""
    found = extract_verdicts(materialise(_transcripts(spark, folder), "texts"), "key", "text")
    return found.select("key", "blob_md5", "diagnosis", "trigger_retraining", F.size("recommendations").alias("n_recommendations"))


QUERIES = {
    "inject_covariate_shift": inject_covariate_shift,
    "inject_label_flip": inject_label_flip,
    "bootstrap_jitter": bootstrap_jitter,
    "detector_backtest": detector_backtest,
    "detector_comparison": detector_comparison,
    "drift_report": drift_report_query,
    "drift_report_guarded": drift_report_guarded,
    "drift_report_from_bundle": drift_report_from_bundle,
    "drift_report_approximate": drift_report_approximate,
    "champion_challenger": champion_challenger,
    "train_baseline_metrics": train_baseline_metrics,
    "batch_score": batch_score,
    "verdict_extract": verdict_extract,
}


def normal_sql(key: str, seed: object, salt: str) -> str:
    u1 = f"(1.0::DOUBLE - {ds.uniform_sql(key, seed, salt + '-a')})"
    return f"(sqrt((-2.0)::DOUBLE * ln({u1})) * cos({2 * 3.141592653589793}::DOUBLE * {ds.uniform_sql(key, seed, salt + '-b')}))"


def poisson_sql(u: str, rate: float) -> str:
    """Number of k whose distribution value is at most u."""
    return f"""list_sum(list_transform(range(0, 40), lambda j: CAST({u} >= list_sum(list_transform(range(0, j + 1),
      lambda m: exp(-{rate}::DOUBLE) * pow({rate}::DOUBLE, m) / gamma(m + 1))) AS INTEGER)))::DOUBLE"""


def scenario_sql(scenarios, seeds) -> str:
    """The backtest batches: the value noise and the flips depend on the seed."""
    grid = ", ".join(f"('{m}', {float(i)}::DOUBLE)" for m, i in scenarios)
    seed = "' || seed || '"
    return f"""SELECT *, {ds.score_sql()} AS score FROM (
      SELECT mode, intensity, seed, event_id, value, k,
             CASE WHEN value > 30.0::DOUBLE AND {ds.uniform_sql('event_id', seed, 'flip')} < 0.35::DOUBLE * c
                  THEN 1 - label ELSE label END AS label
      FROM (SELECT mode, intensity, seed, c, event_id, label,
          value * (1.0::DOUBLE + (-0.35)::DOUBLE * i) + (-40.0)::DOUBLE * i
            + ({ds.uniform_sql('event_id', seed, 'value')} - 0.5::DOUBLE) * 30.0::DOUBLE AS value,
          least(greatest(k * (1.0::DOUBLE + 0.0::DOUBLE * i) + 18.0::DOUBLE * i
            + ({ds.uniform_sql('event_id', seed, 'k')} - 0.5::DOUBLE) * 4.0::DOUBLE, 0.0::DOUBLE), 99.0::DOUBLE) AS k
        FROM ({EV_PROD}),
          (SELECT *, CASE WHEN mode IN ('covariate', 'both') THEN intensity ELSE 0.0::DOUBLE END AS i,
                  CASE WHEN mode IN ('concept', 'both') THEN intensity ELSE 0.0::DOUBLE END AS c
           FROM (VALUES {grid}) AS g(mode, intensity)),
          (SELECT unnest({list(seeds)}) AS seed)))"""


GROUPS = ["mode", "intensity", "seed"]
BATCHES = scenario_sql(bt.SCENARIOS, SEEDS)
T = str(ds.DECISION_THRESHOLD)
WINDOW = f"""SELECT * FROM ({ds.DRIFTING_SQL}) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {REPORT_HOURS} HOUR
  AND ts >= TIMESTAMP '2024-01-21'"""
LABELLED = f"SELECT * FROM ({WINDOW}) WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL {REPORT_DELAY_DAYS} DAY"
TEMPORAL = temporal_sql(DRIFT_REF, WINDOW, ds.EVENT_FEATURES)
SEGMENTS = segment_sql(DRIFT_REF, WINDOW, ds.EVENT_FEATURES, "event_type")
# A missing score counts as not predicted.
CHALLENGER = f"""SELECT label, CASE WHEN {ds.uniform_sql('event_id', 'unscored')} >= 0.05::DOUBLE
  THEN floor((0.3::DOUBLE + 0.006::DOUBLE * value) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM log"""
LOG30 = f"SELECT * FROM ({ds.DRIFTING_SQL}) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {24 * 30} HOUR"
COMPARE_REF = " UNION ALL ".join(f"SELECT '{m}@{float(i)}' AS scenario, * FROM ({EV_REF})" for m, i in bt.COMPARISON)
COMPARE_PROD = f"SELECT mode || '@' || CAST(intensity AS VARCHAR) AS scenario, * FROM ({scenario_sql(bt.COMPARISON, SEEDS[:1])})"
_E = f"{INTENSITY}::DOUBLE"
REFERENCE_HASH = fingerprint_sql(f"({DRIFT_REF})", [
    *[f"CAST({c} AS VARCHAR)" for c in ("event_id", "user_id", "event_type", "label")], "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')",
    *[f"CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)" for c in ("value", "k", "score")],
])

# The same transcripts as text; their objects are found by patterns over that text.
VERDICT_SQL = r"""WITH t AS (
    SELECT conv_id || '-' || turn AS key, role, turn,
      ' Result: {"diagnosis": "case ' || conv_id || '-' || turn || '", "recommendations": [{"action": "retrain", "priority": "high", "reason": "psi"}], '
        || '"trigger_retraining": ' || CASE WHEN turn = 1 THEN 'true' ELSE 'false' END || '} done' AS verdict,
      ' first {"note": {"a": 1}} then' AS bare, text FROM conversations),
  texts AS (
    SELECT key, CASE WHEN role = 'assistant' AND turn = 1 THEN text || verdict WHEN role = 'assistant' THEN bare || text || verdict
                     WHEN turn = 0 THEN bare || text ELSE text || ' {"diagnosis": broken} {' END AS text FROM t),
  objects AS (
    SELECT key, coalesce(nullif(regexp_extract(text, '\{"diagnosis": "[^{}]*\[\{[^{}]*\}\][^{}]*\}'), ''),
                         nullif(regexp_extract(text, '\{"note": \{[^{}]*\}\}'), '')) AS blob FROM texts)
  SELECT key, md5(blob) AS blob_md5, coalesce(blob ->> '$.diagnosis', '') AS diagnosis,
         coalesce(CAST(blob ->> '$.trigger_retraining' AS BOOLEAN), false) AS trigger_retraining,
         CAST(coalesce(json_array_length(blob, '$.recommendations'), 0) AS INTEGER) AS n_recommendations
  FROM objects WHERE blob IS NOT NULL"""

ORACLES = {
    "inject_covariate_shift": f"""SELECT event_id,
        round(value * (1.0::DOUBLE + (-0.35)::DOUBLE * {_E}) + (-40.0)::DOUBLE * {_E} + {normal_sql('event_id', 11, 'value')} * 15.0::DOUBLE, 4) + 0.0::DOUBLE AS value,
        round_even(least(greatest(k * (1.0::DOUBLE + (-0.5)::DOUBLE * {_E}), 0.0::DOUBLE), 60.0::DOUBLE), 0) AS k,
        least(greatest(hour(ts)::DOUBLE + {poisson_sql(ds.uniform_sql('event_id', 11, 'hour'), 1.5 * INTENSITY)}, 0.0::DOUBLE), 20.0::DOUBLE) AS hour
      FROM ({ds.EVENTS_SQL})""",
    "inject_label_flip": f"""SELECT event_id, CASE WHEN value > 50.0::DOUBLE
        AND {ds.uniform_sql('event_id', 11, 'flip')} < 0.35::DOUBLE * {_E} THEN 1 - label ELSE label END AS label FROM ({ds.EVENTS_SQL})""",
    "bootstrap_jitter": f"""WITH pool AS (SELECT event_id, value, k, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM ({ds.EVENTS_SQL})),
      facts AS (SELECT count(*) AS n, stddev_samp(value) AS sv, stddev_samp(k) AS sk FROM pool),
      draws AS (SELECT unnest(range(0, (SELECT n FROM facts))) AS draw_id),
      picked AS (SELECT draw_id, CAST(floor({ds.uniform_sql('draw_id', 5, 'draw', 13)} * n::DOUBLE) AS BIGINT) AS rn, sv, sk FROM draws, facts)
      SELECT draw_id, event_id AS source_event_id,
             round(value + {normal_sql('draw_id', 5, 'value')} * (0.01::DOUBLE * sv), 4) + 0.0::DOUBLE AS value,
             greatest(round_even(k + {normal_sql('draw_id', 5, 'k')} * (0.01::DOUBLE * sk), 0), 0.0::DOUBLE) + 0.0::DOUBLE AS k
      FROM picked JOIN pool USING (rn)""",
    "detector_backtest": f"""WITH {q.psi_ctes(EV_REF, BATCHES, ['value', 'k', 'score'], windows=GROUPS, numeric=['score'])},
      base AS ({q.confusion_sql(EV_REF, T)}), perf AS ({q.confusion_sql(BATCHES, T, GROUPS)}),
      drift AS (SELECT mode, intensity, seed, max(psi) FILTER (WHERE feature <> 'score') AS psi_max,
                       max(psi) FILTER (WHERE feature = 'score') AS pred_psi FROM psi GROUP BY ALL),
      trial AS (SELECT mode, intensity, seed, psi_max, pred_psi, greatest(b.f1 - p.f1, 0.0::DOUBLE) AS f1_drop
                FROM drift JOIN perf p USING (mode, intensity, seed) CROSS JOIN base b)
      SELECT mode, intensity, count(*) AS trials,
        round(avg(CAST(psi_max >= 0.25 AS INTEGER)), 6) + 0.0::DOUBLE AS data_drift_detection_rate,
        round(avg(CAST(psi_max >= 0.10 AS INTEGER)), 6) + 0.0::DOUBLE AS warn_or_alert_rate,
        round(avg(CAST(f1_drop >= 0.05 AS INTEGER)), 6) + 0.0::DOUBLE AS concept_drift_detection_rate,
        round(avg(CAST(psi_max >= 0.25 OR f1_drop >= 0.05 OR pred_psi >= 0.25 AS INTEGER)), 6) + 0.0::DOUBLE AS any_alert_rate,
        round(avg(psi_max), 6) + 0.0::DOUBLE AS mean_psi_max, round(avg(f1_drop), 6) + 0.0::DOUBLE AS mean_f1_drop,
        mode IN ('covariate', 'both') AS expected_data_drift, mode IN ('concept', 'both') AS expected_concept_drift
      FROM trial GROUP BY mode, intensity""",
    "detector_comparison": f"""WITH {q.drift_table_ctes(COMPARE_REF, COMPARE_PROD, ds.EVENT_FEATURES, ['scenario'])}
      SELECT scenario, feature, drifted AS psi_flag, ks_pvalue < 0.01 AND ks_statistic >= 0.1 AS ks_flag,
             drifted = (ks_pvalue < 0.01 AND ks_statistic >= 0.1) AS agree FROM drift""",
    "drift_report": f"""WITH {q.drift_table_ctes(DRIFT_REF, WINDOW, ds.EVENT_FEATURES)},
      summary AS (SELECT max(psi) AS psi_max, avg(psi) AS psi_mean, max(missing_rate_delta) AS max_missing_rate_delta,
        count(*) FILTER (WHERE ks_pvalue < 0.01 AND ks_statistic >= 0.1) AS ks_features_flagged,
        coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE drifted), '') AS drifted_features FROM drift),
      pred AS (SELECT psi AS prediction_drift_psi FROM (WITH {q.psi_ctes(DRIFT_REF, WINDOW, ['score'], numeric=['score'])} SELECT psi FROM psi)),
      base AS ({q.confusion_sql(DRIFT_REF, T)}), perf AS ({q.confusion_sql(LABELLED, T)}), auc AS ({q.auc_sql(LABELLED)}),
      win AS (SELECT count(*) AS n_samples, min(ts) AS window_start, max(ts) AS window_end FROM ({WINDOW})),
      hash AS (SELECT fingerprint AS reference_hash FROM ({REFERENCE_HASH})),
      sus AS ({sustained_sql(TEMPORAL)}),
      tmp AS (SELECT string_agg(slice || ':' || n || ':' || printf('%.4f', psi_max), ';' ORDER BY slice) AS temporal FROM ({TEMPORAL})),
      seg AS (SELECT string_agg(event_type || ':' || n || coalesce(':' || printf('%.4f', psi_max), ''), ';' ORDER BY event_type) AS segments FROM ({SEGMENTS})),
      flat AS (
        SELECT summary.*, pred.*, win.*, hash.*, sus.sustained, tmp.*, seg.*, perf.f1 AS perf_f1, base.f1 AS baseline_f1,
               greatest(base.f1 - perf.f1, 0.0::DOUBLE) AS perf_drop, auc.roc_auc AS perf_roc_auc, perf.n_samples AS n_labeled,
               perf.n_samples / win.n_samples::DOUBLE AS label_coverage, base.n_samples AS n_ref_rows, {T}::DOUBLE AS decision_threshold
        FROM summary, pred, base, perf, auc, win, hash, sus, tmp, seg)
      SELECT CASE WHEN psi_max >= 0.25 OR perf_drop >= 0.05 OR prediction_drift_psi >= 0.25 THEN 'alert'
                  WHEN psi_max >= 0.10 OR prediction_drift_psi >= 0.10 THEN 'warn' ELSE 'ok' END AS status,
             {q.rounded(*REPORT_FLOATS)}, ks_features_flagged, drifted_features, sustained,
             perf_drop >= 0.05 AS concept_drift, n_samples, n_labeled, n_ref_rows, reference_hash,
             window_start, window_end, temporal, segments FROM flat""",
    "drift_report_guarded": f"""SELECT 'insufficient_data' AS status, 0.0::DOUBLE AS psi_max, 0.0::DOUBLE AS psi_mean,
        {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in REPORT_FLOATS[2:])}, 0::BIGINT AS ks_features_flagged, '' AS drifted_features,
        CAST(NULL AS BOOLEAN) AS sustained, CAST(NULL AS BOOLEAN) AS concept_drift, count(*) AS n_samples, 0::BIGINT AS n_labeled,
        CAST(NULL AS BIGINT) AS n_ref_rows, CAST(NULL AS BIGINT) AS reference_hash, min(ts) AS window_start, max(ts) AS window_end,
        CAST(NULL AS VARCHAR) AS temporal, CAST(NULL AS VARCHAR) AS segments FROM ({DRIFT_PROD})""",
    "champion_challenger": f"""WITH log AS ({LOG30}),
      a AS ({q.confusion_sql('SELECT * FROM log', T)}),
      b AS ({q.confusion_sql(CHALLENGER, '0.6')})
      SELECT round(a.f1, 6) + 0.0::DOUBLE AS champion_f1, round(b.f1, 6) + 0.0::DOUBLE AS challenger_f1, b.n_samples AS eval_n,
             'production_window' AS eval_basis, b.f1 >= a.f1 AS promoted,
             CASE WHEN b.f1 >= a.f1 THEN 'challenger >= champion' ELSE 'challenger worse than champion' END AS reason FROM a, b""",
    "verdict_extract": VERDICT_SQL,
}
ORACLES["drift_report_from_bundle"] = ORACLES["drift_report"]
ORACLES["train_baseline_metrics"] = f"""SELECT CAST(sum(n - t) AS BIGINT) AS n_train, CAST(sum(t) AS BIGINT) AS n_test,
    true AS f1_in_range, true AS tuned_is_best, true AS auc_above_chance, true AS threshold_in_range
  FROM (SELECT count(*) AS n, floor(count(*) * 0.2::DOUBLE + 0.5::DOUBLE) AS t FROM ({ds.EVENTS_SQL}) GROUP BY label)"""
ORACLES["batch_score"] = f"""SELECT event_id, bad AS quarantined, CASE WHEN NOT bad THEN true END AS score_in_range,
    CASE WHEN NOT bad THEN true END AS decided_by_threshold
  FROM (SELECT event_id, {ds.uniform_sql('event_id', 'infinite')} < 0.02::DOUBLE AS bad FROM events)"""

ORACLES["drift_report_approximate"] = f"""SELECT unnest([{', '.join(f"'{c}'" for c in APPROXIMATED)}]) AS measure,
  unnest([{', '.join(APPROXIMATED)}]) AS exact, true AS within FROM ({ORACLES['drift_report']})"""
