"""Queries on model quality over the scored events and the real document labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import sql as q
from driftline.catalog.drift import DRIFT_PROD, DRIFT_REF, drifting_sides
from driftline.config import DriftConfig
from driftline.functions.scalars import hash_uniform, out, round_to
from driftline.operators import performance as m
from driftline.operators.models import stratified_split
from driftline.plans import datasets as ds
from driftline.sources.tables import latest, read_table

THRESHOLD = ds.DECISION_THRESHOLD
DELAY_DAYS = 3


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the labels that exist; the score follows the length."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labels = read_table(spark, folder, "labels")
    length = F.col("n_chars").cast("double")
    score = round_to(length / (length + F.lit(1000.0)), 4)
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", score.alias("score"), F.col("quality").alias("label")
    )


DOCS_SQL = """SELECT doc_id, lang, quality AS label,
  floor((n_chars::DOUBLE / (n_chars::DOUBLE + 1000.0::DOUBLE)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score
  FROM documents LEFT JOIN labels USING (doc_id)"""


# One score in twenty is missing, chosen by hash.
UNSCORED_SQL = f"""SELECT * REPLACE (CASE WHEN {ds.uniform_sql('event_id', 'unscored')} >= 0.05::DOUBLE THEN score END AS score)
  FROM ({ds.DRIFTING_SQL})"""


def f1_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    scored = F.when(hash_uniform(["event_id"], "unscored") >= 0.05, F.col("score"))
    log = ds.drifting_events(spark, folder).withColumn("score", scored)
    found = m.f1_at_threshold(log, THRESHOLD, ["event_type"])
    return found.withColumn("f1", out(F.col("f1")))


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    found = m.roc_auc(ds.drifting_events(spark, folder), ["event_type"])
    return found.withColumn("roc_auc", out(F.col("roc_auc")))


def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = m.pr_curve(labelled_documents(spark, folder))
    return curve.select("threshold", "tp", "fp", "fn", *[out(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def tune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    best = m.tune_threshold(ds.scored_events(spark, folder), ["event_type"])
    return best.withColumn("f1", out(F.col("f1")))


def performance_vs_baseline(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = drifting_sides(spark, folder)
    base = m.f1_at_threshold(ref, THRESHOLD, ["event_type"]).select("event_type", F.col("f1").alias("base"))
    counts = m.confusion_counts(prod, THRESHOLD, ["event_type"])
    measured = m.performance_vs_baseline(counts.join(base, "event_type"), F.col("base"), DriftConfig())
    return measured.select(
        "event_type", "n_samples", *[out(F.col(c)).alias(c) for c in ("baseline_f1", "perf_f1", "perf_drop")], "concept_drift"
    )


def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    counts = m.confusion_counts(labelled_documents(spark, folder), 0.5, ["lang"])
    return counts.select("lang", "n_samples", "n_labeled", out(F.col("n_labeled") / F.col("n_samples")).alias("label_coverage"))


def label_latency_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Production rows whose label is known at the end of the window, three days late."""
    _, prod = drifting_sides(spark, folder)
    known = m.label_slice(prod, "ts", latest(prod, "ts"), DELAY_DAYS)
    return known.select("event_id", "ts", "label")


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = stratified_split(ds.events(spark, folder), "event_id", "label", 0.2, 42)
    return rows.select("event_id", "label", "is_test")


QUERIES = {
    "f1_at_threshold": f1_at_threshold,
    "roc_auc": roc_auc,
    "pr_curve": pr_curve,
    "tune_threshold": tune_threshold,
    "performance_vs_baseline": performance_vs_baseline,
    "label_coverage": label_coverage,
    "label_latency_slice": label_latency_slice,
    "stratified_split": split_rows,
}


def _curve_sql(source: str, key: str) -> str:
    """Curve points per key by comparing running sums from the top score down."""
    return f"""SELECT {key}, score AS threshold, tp, fp, p - tp AS fn,
        tp / (tp + fp)::DOUBLE AS precision, CASE WHEN p = 0 THEN 1.0::DOUBLE ELSE tp / p::DOUBLE END AS recall,
        coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + (p - tp), 0), 0.0::DOUBLE) AS f1
      FROM (SELECT {key}, score, CAST(sum(pos) OVER (PARTITION BY {key} ORDER BY score DESC) AS BIGINT) AS tp,
                   CAST(sum(neg) OVER (PARTITION BY {key} ORDER BY score DESC) AS BIGINT) AS fp,
                   CAST(sum(pos) OVER (PARTITION BY {key}) AS BIGINT) AS p
            FROM (SELECT {key}, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
                  FROM ({source}) WHERE label IS NOT NULL GROUP BY ALL))"""


ORACLES = {
    "f1_at_threshold": f"SELECT * REPLACE (round(f1, 6) + 0.0::DOUBLE AS f1) FROM ({q.confusion_sql(UNSCORED_SQL, str(THRESHOLD), ['event_type'])})",
    "roc_auc": f"SELECT * REPLACE (round(roc_auc, 6) + 0.0::DOUBLE AS roc_auc) FROM ({q.auc_sql(ds.DRIFTING_SQL, ['event_type'])})",
    "pr_curve": f"""SELECT threshold, tp, fp, fn, {q.rounded('precision', 'recall', 'f1')}
      FROM ({_curve_sql('SELECT *, 1 AS one FROM (' + DOCS_SQL + ')', 'one')})""",
    "tune_threshold": f"""SELECT event_type, threshold, round(f1, 6) + 0.0::DOUBLE AS f1
      FROM ({_curve_sql(ds.SCORED_SQL, 'event_type')})
      QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY f1 DESC, threshold) = 1""",
    "performance_vs_baseline": f"""WITH b AS ({q.confusion_sql(DRIFT_REF, str(THRESHOLD), ['event_type'])}),
      c AS ({q.confusion_sql(DRIFT_PROD, str(THRESHOLD), ['event_type'])})
      SELECT event_type, c.n_samples, round(b.f1, 6) + 0.0::DOUBLE AS baseline_f1, round(c.f1, 6) + 0.0::DOUBLE AS perf_f1,
             round(greatest(b.f1 - c.f1, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS perf_drop,
             greatest(b.f1 - c.f1, 0.0::DOUBLE) >= 0.05 AS concept_drift
      FROM b JOIN c USING (event_type)""",
    "label_coverage": f"""SELECT lang, count(*) AS n_samples, count(label) AS n_labeled,
        round(count(label) / count(*)::DOUBLE, 6) + 0.0::DOUBLE AS label_coverage FROM ({DOCS_SQL}) GROUP BY lang""",
    "label_latency_slice": f"""SELECT event_id, ts, label FROM ({DRIFT_PROD})
      WHERE ts <= (SELECT max(ts) FROM ({DRIFT_PROD})) - INTERVAL {DELAY_DAYS} DAY""",
    "stratified_split": f"""SELECT event_id, label, rn <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM (
        SELECT event_id, label, count(*) OVER (PARTITION BY label) AS n,
               row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS rn
        FROM ({ds.EVENTS_SQL}))""",
}
