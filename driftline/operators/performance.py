"""Model quality from counts: F1, ROC AUC, precision-recall, threshold tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT_DECISION_THRESHOLD, DriftConfig
from driftline.functions.scalars import f1_from_counts
from driftline.operators.ordered import Runs, lay_out, running_totals
from driftline.sources.tables import moment


def predicted(score: str, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.col(score) >= limit).cast("int")


def confusion_counts(
    df: DataFrame,
    threshold: Column | float,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    labelled: Column | None = None,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """n, n_labeled, n_unscored, tp, fp, fn, tn per key in one map-side-combined aggregation.

    A row with a label but without a score is counted as unscored and not as labelled, so the
    four counts always add up to n_labeled. `carry` adds aggregates to the same pass."""
    given = F.col(label).isNotNull()
    if labelled is not None:
        given = given & labelled
    known = given & F.col(score).isNotNull()
    hit, actual = predicted(score, threshold) == 1, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(known).alias("n_labeled"),
        F.count_if(given & F.col(score).isNull()).alias("n_unscored"),
        F.count_if(known & hit & actual).alias("tp"),
        F.count_if(known & hit & ~actual).alias("fp"),
        F.count_if(known & ~hit & actual).alias("fn"),
        F.count_if(known & ~hit & ~actual).alias("tn"),
        *carry,
    )


def f1_at_threshold(
    df: DataFrame, threshold: Column | float, keys: Sequence[str] = (), **columns
) -> DataFrame:
    counts = confusion_counts(df, threshold, keys, **columns)
    return counts.withColumn("f1", f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")))


def score_counts(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Positives and negatives per distinct score, combined before the shuffle."""
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )


def _score_runs(df, keys, score, label) -> Runs:
    return lay_out(score_counts(df, keys, score, label), keys, ["score"], ["pos", "neg"])


def roc_auc(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Rank AUC with half credit for ties; 0 when only one class is present."""
    ranked = running_totals(_score_runs(df, keys, score, label))
    won = F.col("pos") * (F.col("neg_prior").cast("double") + F.col("neg") / F.lit(2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.coalesce(F.sum(won) / F.nullif(pairs, F.lit(0.0)), F.lit(0.0)).alias("roc_auc"),
    )


def binned_auc(df: DataFrame, score: str = "score", label: str = "label", bins: int = 4096) -> DataFrame:
    """AUC from counts in `bins` equal bins of [0, 1], and `auc_error`, the most it can be off.

    No score is shuffled. Inside a bin each pair counts half, so the error is half of the pairs that
    share a bin; scores outside [0, 1] fall into the outer bins."""
    bin_ = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins))
    counts = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(bin_.alias("b"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    one = counts.agg(
        F.array_sort(F.collect_list(F.struct("b", "pos", "neg"))).alias("_bins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    walked = F.expr("""aggregate(_bins, named_struct('below', 0L, 'won', 0.0D, 'tied', 0.0D),
      (a, x) -> named_struct('below', a.below + x.neg, 'won', a.won + x.pos * (a.below + x.neg / 2.0D), 'tied', a.tied + x.pos * x.neg / 2.0D))""")
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return one.withColumn("_w", walked).select(
        "n_pos", "n_neg",
        F.coalesce(F.col("_w.won") / pairs, F.lit(0.0)).alias("roc_auc"),
        F.coalesce(F.col("_w.tied") / pairs, F.lit(0.0)).alias("auc_error"),
    )


def pr_curve(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """One point per distinct score taken as the threshold (score >= threshold is positive)."""
    runs = _score_runs(df, keys, score, label)
    whole = Window.partitionBy(*keys)
    # The totals table has one row per (key, run), so this window stays small.
    sized = runs.totals.withColumns(
        {"all_pos": F.sum("pos_run").over(whole), "all_neg": F.sum("neg_run").over(whole)}
    )
    joined = running_totals(runs, sized)
    tp = F.col("all_pos") - F.col("pos_prior")
    fp = F.col("all_neg") - F.col("neg_prior")
    fn = F.col("pos_prior")
    return joined.select(
        *keys,
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        (tp / (tp + fp)).alias("precision"),
        F.when(F.col("all_pos") == 0, F.lit(1.0)).otherwise(tp / F.nullif(F.col("all_pos"), F.lit(0))).alias("recall"),
        f1_from_counts(tp, fp, fn).alias("f1"),
    )


def tune_threshold(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Score with the highest F1; the lowest threshold wins a tie; 0.5 when there is none."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("_neg"))).alias("_best")
    curve = pr_curve(df, keys, score, label).groupBy(*keys).agg(best)
    return curve.select(
        *keys,
        F.coalesce(-F.col("_best._neg"), F.lit(DEFAULT_DECISION_THRESHOLD)).alias("threshold"),
        F.coalesce(F.col("_best.f1"), F.lit(0.0)).alias("f1"),
    )


def arrived(ts: Column, window_end: Column, delay_days: int) -> Column:
    """Whether the label of a row is known at window_end; no delay means always."""
    if delay_days <= 0:
        return F.lit(True)
    return ts <= window_end - F.make_dt_interval(days=F.lit(delay_days))


def label_slice(df: DataFrame, ts: str, window_end, delay_days: int) -> DataFrame:
    """Rows whose label has arrived; the cutoff is a literal, so it reaches the scan."""
    if delay_days <= 0:
        return df
    end = moment(window_end, df.schema[ts].dataType)
    return df.filter(arrived(F.col(ts), end, delay_days))


def performance_vs_baseline(
    counts: DataFrame, baseline: Column, config: DriftConfig | None = None
) -> DataFrame:
    """F1, drop and flag against a baseline. Without labelled rows or a positive baseline the
    F1 is NULL and the drop 0, so no drift is ever invented."""
    config = config or DriftConfig()
    usable = (F.col("n_labeled") > 0) & (F.coalesce(baseline, F.lit(0.0)) > 0)
    f1 = f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    drop = F.when(usable, F.greatest(baseline - f1, F.lit(0.0))).otherwise(F.lit(0.0))
    return (
        counts.withColumn("baseline_f1", baseline)
        .withColumn("perf_f1", F.when(usable, f1))
        .withColumn("perf_drop", drop)
        .withColumn("concept_drift", F.col("perf_drop") >= config.perf_drop_alert)
        .withColumn("label_coverage", F.col("n_labeled") / F.nullif(F.col("n_samples"), F.lit(0)))
    )
