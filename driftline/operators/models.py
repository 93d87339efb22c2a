"""Training, scoring and promotion with MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import DEFAULT_DECISION_THRESHOLD
from driftline.functions.scalars import f1_from_counts, is_unusable
from driftline.operators.ordered import lay_out, rows_at_ranks
from driftline.operators.performance import confusion_counts, roc_auc, tune_threshold
from driftline.operators.profile import to_long
from driftline.session import materialise

# The published training settings.
TREES = 150
DEPTH = 3
STEP = 0.1
BINS = 32
TEST_SHARE = 0.2
SEED = 42


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Exact split inside every label by hashed key order; adds is_test.

    Per label the rank of the last test row is looked up through the range layout, which
    moves only label, hash and key. The rows themselves are then marked by comparison with
    that boundary: one row per label, written, so that its real size decides how it is joined.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_hash", digest)

    def last_test_rank(total):
        size = F.floor(total * F.lit(test_share) + F.lit(0.5))
        return F.when(size > 0, F.array(size - 1)).otherwise(F.array().cast("array<bigint>"))

    known = hashed.filter(F.col(label).isNotNull())
    runs = lay_out(
        known.select(label, "_hash", key).withColumn("n", F.lit(1).cast("bigint")),
        [label],
        ["_hash", key],
        ["n"],
    )
    cut = rows_at_ranks(runs, "n", last_test_rank).select(
        label, F.col("_hash").alias("_cut_hash"), F.col(key).alias("_cut_key")
    )
    inside = (F.col("_hash") < F.col("_cut_hash")) | (
        (F.col("_hash") == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key"))
    )
    return (
        hashed.join(materialise(cut, "cuts"), label, "left")
        .withColumn("is_test", F.coalesce(inside, F.lit(False)))
        .drop("_hash", "_cut_hash", "_cut_key")
    )


@dataclass(frozen=True)
class TrainedModel:
    """A fitted pipeline with its operating point and held-out quality."""

    pipeline: PipelineModel
    features: tuple[str, ...]
    threshold: float
    baseline_f1: float
    f1_default: float
    auc: float
    n_train: int
    n_test: int


def split_points(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """For each feature the values at which a tree may cut it: those at BINS - 1 equal steps of its
    readings and of its distinct values. So a feature with few values, or rare ones beside one that
    most rows have, is cut between them all or nearly so. Exact, over all rows; the driver holds at
    most 2 * (BINS - 1) numbers for a feature.
    """
    counted = to_long(df, features).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    runs = lay_out(counted.withColumn("one", F.lit(1).cast("bigint")), ["feature"], ["value"], ["n", "one"])

    def steps(total):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda j: F.floor(total * j / BINS)))

    found = {f: set() for f in features}
    for weight in ("n", "one"):
        for r in rows_at_ranks(runs, weight, steps).select("feature", "value").collect():
            found[r.feature].add(r.value)
    return {f: sorted(v for v in values if abs(v) != float("inf")) for f, values in found.items()}


def make_bins(points: dict[str, list[float]]) -> Bucketizer:
    """A stage that replaces each feature by the number of its bin, [point, next point)."""
    ends = float("-inf"), float("inf")
    return Bucketizer(
        splitsArray=[[ends[0], *(points[f] or [0.0]), ends[1]] for f in points],
        inputCols=list(points), outputCols=[f"_bin_{f}" for f in points], handleInvalid="error",
    )


def make_pipeline(features: Sequence[str], label: str, trees: int, depth: int) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"_bin_{f}" for f in features], outputCol="_raw", handleInvalid="error"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=False, withStd=True),
            GBTClassifier(
                featuresCol="_scaled", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth,
                maxBins=2 * BINS, stepSize=STEP, seed=SEED, checkpointInterval=10,
            ),
        ]
    )


def fit_binned(df: DataFrame, features: Sequence[str], label: str, trees: int, depth: int) -> PipelineModel:
    """Boosted trees on the rows counted by label and bins, each count the weight of one row.

    A tree only sees the bins of a row, so the counts hold all that it learns from. They are taken in
    one pass over the rows that combines map-side; the 150 trees, each of which passes several times over
    its input, pass over the counts. With f features these are at most 2 * (2 * BINS) ** f rows, and never
    more than the rows themselves.
    """
    bins = make_bins(split_points(df, features))
    binned = bins.transform(df.select(label, *[F.col(f).cast("double").alias(f) for f in features]))
    counted = binned.groupBy(label, *[f"_bin_{f}" for f in features]).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    fitted = make_pipeline(features, label, trees, depth).fit(materialise(counted, "binned"))
    return PipelineModel(stages=[bins, *fitted.stages])


def probability(scored: DataFrame, score: str = "score") -> DataFrame:
    made = ("_raw", "_scaled", "rawPrediction", "probability", "prediction")
    keep = [c for c in scored.columns if c not in made and not c.startswith("_bin_")]
    return scored.select(*keep, vector_to_array("probability")[1].alias(score))


def train(
    df: DataFrame, features: Sequence[str], label: str, key: str, trees: int = TREES, depth: int = DEPTH
) -> TrainedModel:
    """Fit on 80 %, tune the threshold and measure on the other 20 %."""
    # Written, as bins, counts, number of rows and held-out scores each read it.
    parts = materialise(stratified_split(df.select(key, label, *features), key, label), "parts")
    fit_rows, test_rows = parts.filter("NOT is_test"), parts.filter("is_test")
    model = fit_binned(fit_rows, features, label, trees, depth)
    # Written, as four measures read it; else split and trees would run for each of them.
    scored = materialise(probability(model.transform(test_rows)).select(label, "score"), "held-out")
    threshold = tune_threshold(scored, label=label).first()["threshold"]
    counts = confusion_counts(scored, threshold, label=label)
    at_default = confusion_counts(scored, DEFAULT_DECISION_THRESHOLD, label=label)
    f1 = f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    row = counts.select(f1.alias("f1"), "n_samples").first()
    default = at_default.select(f1.alias("f1")).first()
    return TrainedModel(
        model, tuple(features), threshold, row["f1"], default["f1"],
        roc_auc(scored, label=label).first()["roc_auc"], fit_rows.count(), row["n_samples"],
    )


def batch_score(df: DataFrame, model: TrainedModel) -> DataFrame:
    """Probability and decision of every row; rows with an unusable feature are kept, unscored,
    in the quarantined part of the result."""
    bad = F.lit(False)
    for f in model.features:
        bad = bad | is_unusable(F.col(f).cast("double"))
    marked = df.withColumn("quarantined", bad)
    scored = probability(model.pipeline.transform(marked.filter(~F.col("quarantined"))))
    unscored = marked.filter("quarantined").withColumn("score", F.lit(None).cast("double"))
    both = scored.unionByName(unscored)
    return both.withColumn("prediction", (F.col("score") >= F.lit(model.threshold)).cast("int"))


def save_model(spark: SparkSession, model: TrainedModel, path: str) -> None:
    """Pipeline folder and a one-row metadata table next to it; what a failed try left is replaced."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    row = (
        list(model.features), model.threshold, model.baseline_f1, model.f1_default, model.auc,
        model.n_train, model.n_test,
    )
    spark.createDataFrame(
        [row],
        "features array<string>, threshold double, baseline_f1 double, f1_default double, "
        "auc double, n_train bigint, n_test bigint",
    ).write.mode("overwrite").parquet(f"{path}/meta")


META_DEFAULTS = {
    "threshold": DEFAULT_DECISION_THRESHOLD, "baseline_f1": 0.0, "f1_default": 0.0, "auc": 0.0,
    "n_train": 0, "n_test": 0,
}


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Load a saved model; metadata that an older one lacks gets its default."""
    meta = spark.read.parquet(f"{path}/meta").first().asDict()

    def known(name: str):
        value = meta.get(name)
        return META_DEFAULTS[name] if value is None else value

    return TrainedModel(
        PipelineModel.load(f"{path}/pipeline"), tuple(meta["features"]), known("threshold"),
        known("baseline_f1"), known("f1_default"), known("auc"), known("n_train"), known("n_test"),
    )


def promotion_decision(
    scored: DataFrame,
    versions: DataFrame,
    epsilon: float = 0.0,
) -> DataFrame:
    """Champion against challenger on one window.

    `scored` holds (version, label, prediction) for both; `versions` holds one row per
    version: version ('champion' or 'challenger'), baseline_f1, n_heldout. Without a labelled
    window both sides fall back to their held-out F1. No champion, or one without a positive
    baseline, means the challenger is promoted. A row that a version could not score counts as not
    predicted, so missing scores never help a version.
    """
    hit = F.coalesce(F.col("prediction") == 1, F.lit(False))
    counts = scored.filter(F.col("label").isNotNull()).groupBy("version").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit & (F.col("label") == 1)).alias("tp"),
        F.count_if(hit & (F.col("label") != 1)).alias("fp"),
        F.count_if(~hit & (F.col("label") == 1)).alias("fn"),
    )
    f1 = f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    window = counts.select("version", "n", f1.alias("f1"))
    sides = versions.join(window, "version", "left")

    def of(version: str, column: str):
        return F.max(F.when(F.col("version") == version, F.col(column)))

    flat = sides.agg(
        of("champion", "baseline_f1").alias("champ_base"),
        of("challenger", "baseline_f1").alias("chal_base"),
        of("challenger", "n_heldout").alias("n_heldout"),
        of("champion", "f1").alias("champ_window"),
        of("challenger", "f1").alias("chal_window"),
        of("challenger", "n").alias("n_window"),
    )
    incumbent = F.coalesce(F.col("champ_base"), F.lit(0.0)) > 0
    head_to_head = F.col("champ_window").isNotNull() & F.col("chal_window").isNotNull()
    on_window = incumbent & head_to_head
    champion = F.when(~incumbent, F.lit(0.0)).when(on_window, F.col("champ_window")).otherwise(F.col("champ_base"))
    challenger = F.when(on_window, F.col("chal_window")).otherwise(F.col("chal_base"))
    return flat.select(
        champion.alias("champion_f1"),
        challenger.alias("challenger_f1"),
        F.when(~incumbent, F.lit(0)).when(on_window, F.col("n_window")).otherwise(F.col("n_heldout")).cast("bigint").alias("eval_n"),
        F.when(on_window, F.lit("production_window")).otherwise(F.lit("heldout")).alias("eval_basis"),
        (~incumbent | (challenger >= champion - F.lit(epsilon))).alias("promoted"),
        F.when(~incumbent, F.lit("no incumbent champion"))
        .when(challenger >= champion - F.lit(epsilon), F.lit("challenger >= champion"))
        .otherwise(F.lit("challenger worse than champion"))
        .alias("reason"),
    )
