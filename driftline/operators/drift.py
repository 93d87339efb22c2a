"""Population stability, two-sample KS and the per-feature drift table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import KS_ALPHA, KS_FLOOR, DriftConfig
from driftline.functions.scalars import KS_EXACT_ROWS, reading
from driftline.operators.profile import (
    ReferenceProfile,
    build_profile,
    cell,
    cell_grid,
    lay_out_values,
    order_statistics,
    profile_from_runs,
    reference_long,
    to_long,
    value_counts,
)
from driftline.session import broadcast_bounded


def psi_from_counts(
    cells: DataFrame, keys: Sequence[str], ref: str, prod: str, carry: Sequence[Column] = ()
) -> DataFrame:
    """PSI over the cells of each key: add 1 to every count, normalise, sum (q-p) ln(q/p).

    With R and S the smoothed totals, the sum equals
    sum((s+1) ln((s+1)/(r+1))) / S - sum((r+1) ln((s+1)/(r+1))) / R, so one aggregation is
    enough and no window over the cells is needed. `carry` adds aggregates to the output.
    """
    ratio = f"(ln({prod} + 1.0D) - ln({ref} + 1.0D))"
    sums = cells.groupBy(*keys).agg(
        F.expr(f"sum({ref} + 1.0D) AS _r"),
        F.expr(f"sum({prod} + 1.0D) AS _s"),
        F.expr(f"sum(({prod} + 1.0D) * {ratio}) AS _a"),
        F.expr(f"sum(({ref} + 1.0D) * {ratio}) AS _b"),
        F.expr(f"sum({ref}) = 0 OR sum({prod}) = 0 AS _empty"),
        *carry,
    )
    scored = sums.withColumn("psi", F.expr("IF(_empty, 0.0D, _a / _s - _b / _r)"))
    return scored.drop("_r", "_s", "_a", "_b", "_empty")


def production_cells(
    production: DataFrame, profile: ReferenceProfile, windows: Sequence[str] = ()
) -> DataFrame:
    """Cell counts of long production rows per (windows, keys, feature).

    One scan: the profile is joined as a bounded broadcast and the counts combine map-side,
    so only (windows x features x cells) rows are shuffled. Groups without a reference drop out.
    """
    by = [*profile.keys, "feature"]
    return (
        production.join(profile.small_features(), by)
        .select(*windows, *by, cell().alias("cell"))
        .groupBy(*windows, *by, "cell")
        .agg(F.count(F.lit(1)).alias("s"))
    )


def psi_against_profile(
    counts: DataFrame, profile: ReferenceProfile, windows: Sequence[str] = ()
) -> DataFrame:
    """PSI of each production group against the whole cell grid of its reference.

    The grid is not repeated for each window. Its sums for empty cells are taken once per
    feature, and each counted production cell adds the difference it makes. So any number of
    windows costs one pass over their own cells.
    """
    by = [*profile.keys, "feature"]
    r1 = F.col("r").cast("double") + 1.0
    base = profile.cells.groupBy(*by).agg(
        F.sum(r1).alias("_r"),
        F.count(F.lit(1)).alias("_cells"),
        F.sum(-F.log(r1)).alias("_a0"),
        F.sum(-r1 * F.log(r1)).alias("_b0"),
    )
    ref_cells = profile.small_cells().select(
        *by, F.col("cell").alias("_cell"), F.col("r").alias("_ref"), F.lit(1).alias("_known")
    )
    matched = counts.withColumnRenamed("feature", "_f").join(
        ref_cells.withColumnRenamed("feature", "_g").withColumnsRenamed(
            {k: f"_k_{k}" for k in profile.keys}
        ),
        (F.col("_f") == F.col("_g"))
        & F.col("cell").eqNullSafe(F.col("_cell"))
        & _all_equal(profile.keys),
        "left",
    ).withColumnRenamed("_f", "feature")
    ref1 = F.coalesce(F.col("_ref"), F.lit(0)).cast("double") + 1.0
    s = F.col("s").cast("double")
    change = matched.groupBy(*windows, *by).agg(
        F.sum(s).alias("_s"),
        F.count_if(F.col("_known").isNull()).alias("_new"),
        F.sum((s + 1.0) * F.log(s + 1.0) - s * F.log(ref1)).alias("_da"),
        F.sum(ref1 * F.log(s + 1.0)).alias("_db"),
    )
    joined = change.join(broadcast_bounded(base, profile.max_rows), by)
    prod_total = F.col("_s") + F.col("_cells") + F.col("_new")
    ref_total = F.col("_r") + F.col("_new")
    value = (F.col("_a0") + F.col("_da")) / prod_total - (F.col("_b0") + F.col("_db")) / ref_total
    return joined.select(*windows, *by, value.alias("psi"))


def _all_equal(keys: Sequence[str]):
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_k_{k}"))
    return condition


def feature_psi(
    production: DataFrame,
    features: Sequence[str],
    profile: ReferenceProfile,
    windows: Sequence[str] = (),
) -> DataFrame:
    """PSI per (windows, keys, feature) of a wide production frame."""
    long = to_long(production, features, [*windows, *profile.keys])
    return psi_against_profile(production_cells(long, profile, windows), profile, windows)


def numeric_psi(reference: DataFrame, production: DataFrame, features: Sequence[str]) -> DataFrame:
    """D5 for every feature, never categorical; 0 when a side is empty or the reference has
    no present reading."""
    profile = build_profile(reference, features, numeric=features)
    found = feature_psi(production, features, profile).join(
        broadcast_bounded(profile.features.select("feature", "present_ref"), len(features)), "feature"
    )
    scored = found.select(
        "feature", F.when(F.col("present_ref") > 0, F.col("psi")).otherwise(F.lit(0.0)).alias("psi")
    )
    return _every_feature(scored, features, {"psi": 0.0})


def _every_feature(found: DataFrame, features: Sequence[str], defaults: dict) -> DataFrame:
    names = found.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    filled = names.join(found, "feature", "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def categorical_psi(
    reference: DataFrame, production: DataFrame, columns: Sequence[str], as_text: bool = False
) -> DataFrame:
    """Cells are the values seen on either side and a missing cell that always exists.

    One aggregation over the tagged union: no join, and a hot value combines map-side.
    """

    def side(df: DataFrame, r: int, p: int) -> DataFrame:
        slim = df.select(
            *[(F.col(c).cast("string") if as_text else reading(c)).alias(c) for c in columns]
        )
        return slim.unpivot([], list(columns), "feature", "cell").withColumns(
            {"r": F.lit(r).cast("bigint"), "s": F.lit(p).cast("bigint")}
        )

    tagged = side(reference, 1, 0).unionByName(side(production, 0, 1))
    missing = tagged.sparkSession.createDataFrame([(c,) for c in columns], "feature string").select(
        "feature",
        F.lit(None).cast("string" if as_text else "double").alias("cell"),
        F.lit(0).cast("bigint").alias("r"),
        F.lit(0).cast("bigint").alias("s"),
    )
    cells = (
        tagged.unionByName(missing)
        .groupBy("feature", "cell")
        .agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    )
    return psi_from_counts(cells, ["feature"], "r", "s")


def ks_two_sample(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    exact_rows: int = KS_EXACT_ROWS,
) -> DataFrame:
    """KS statistic and p-value per feature, and per value of `keys` where some are given.

    The p-value is exact while neither side has more than `exact_rows` present readings, else
    asymptotic; `ks_method` names it. A feature without readings on a side has the statistic 0,
    the p-value 1 and the method `none`; with keys, only keys that have rows are listed.
    """
    counts = value_counts(reference_long(reference, features, keys), to_long(production, features, keys), keys)
    found = order_statistics(lay_out_values(counts, keys), exact_rows).select(
        *keys,
        "feature",
        F.col("present_ref").alias("n_ref"),
        F.col("present_prod").alias("n_prod"),
        "ks_statistic",
        "ks_pvalue",
        "ks_method",
    )
    if keys:
        return found
    return _every_feature(
        found, features, {"n_ref": 0, "n_prod": 0, "ks_statistic": 0.0, "ks_pvalue": 1.0, "ks_method": "none"}
    )


# A feature without rows on a side, as the drift table reports it.
NEUTRAL_FEATURE = {
    "psi": 0.0,
    "ks_statistic": 0.0,
    "ks_pvalue": 1.0,
    "ks_method": "none",
    "ref_mean": 0.0,
    "prod_mean": 0.0,
    "ref_std": 0.0,
    "prod_std": 0.0,
    "missing_rate_delta": 0.0,
    "is_categorical": True,
    "drifted": False,
}


def feature_drift(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str],
    config: DriftConfig | None = None,
    keys: Sequence[str] = (),
    max_groups: int | None = None,
) -> DataFrame:
    """The per-feature drift table, optionally per key (one comparison per key value).

    Per key there is a `status`: a key that only production has is listed with NULL measures
    and `no_reference`, one that only the reference has with `no_production`."""
    table, _ = compare(reference, production, features, config, keys, max_groups)
    return table


def compare(
    reference: DataFrame | None,
    production: DataFrame,
    features: Sequence[str],
    config: DriftConfig | None = None,
    keys: Sequence[str] = (),
    max_groups: int | None = None,
    numeric: Sequence[str] = (),
    saved: DataFrame | None = None,
) -> tuple[DataFrame, ReferenceProfile]:
    """Drift table and the reference profile it was made with, for further windows.

    With `saved`, the value counts of a reference as kept with its model, `reference` is not read.

    One scan of each side: readings are counted by distinct value, laid out in order and
    written once; edges, cells, KS and moments all come from that table. The deviations are
    taken around the means in the pass that counts the cells, which keeps them accurate when
    the mean is far from zero. The drifted flag uses PSI only; KS is a diagnostic. Features
    in `numeric` are never treated as categories.
    """
    config = config or DriftConfig()
    by = [*keys, "feature"]
    groups = 1 if not keys else max_groups
    max_rows = None if groups is None else groups * len(features)
    known = reference_long(reference, features, keys) if saved is None else saved
    counts = value_counts(known, to_long(production, features, keys), keys)
    runs = lay_out_values(counts, keys)
    profile = profile_from_runs(runs, keys, max_rows, numeric)
    small = profile.small_features()
    counted = (
        runs.rows.join(small, by)
        .groupBy(*by, cell().alias("cell"))
        .agg(
            F.expr("sum(n_ref) AS r"),
            F.expr("sum(n_prod) AS s"),
            F.expr("sum((value - mean_ref) * (value - mean_ref) * f_ref) AS sq_ref"),
            F.expr("sum((value - mean_prod) * (value - mean_prod) * f_prod) AS sq_prod"),
        )
    )
    grid = cell_grid(profile.features, keys).selectExpr(
        "*", "0L AS r", "0L AS s", "cast(NULL AS double) AS sq_ref", "cast(NULL AS double) AS sq_prod"
    )
    # The grid repeats cells that were counted, so the two are added up before smoothing.
    cells = (
        counted.unionByName(grid)
        .groupBy(*by, "cell")
        .agg(*[F.sum(c).alias(c) for c in ("r", "s", "sq_ref", "sq_prod")])
    )
    psi = psi_from_counts(cells, by, "r", "s", [F.sum(c).alias(c) for c in ("sq_ref", "sq_prod")])

    def missing(side: str) -> str:
        return f"coalesce(({side}_rows - present_{side}) / nullif({side}_rows, 0), 0.0D)"

    table = psi.join(small, by).selectExpr(
        *by,
        "psi",
        "ks_statistic",
        "ks_pvalue",
        "ks_method",
        "coalesce(mean_ref, 0.0D) AS ref_mean",
        "coalesce(mean_prod, 0.0D) AS prod_mean",
        "coalesce(sqrt(sq_ref / nullif(present_ref, 0)), 0.0D) AS ref_std",
        "coalesce(sqrt(sq_prod / nullif(present_prod, 0)), 0.0D) AS prod_std",
        f"{missing('prod')} - {missing('ref')} AS missing_rate_delta",
        "is_categorical",
        f"psi >= {config.psi_alert}D AS drifted",
    )
    if not keys:
        return _every_feature(table, features, NEUTRAL_FEATURE), profile
    sides = runs.rows.groupBy(*by).agg(F.sum("n_ref").alias("_r"), F.sum("n_prod").alias("_s")).dropna(subset=list(keys))
    state = F.when(F.col("_r") == 0, "no_reference").when(F.col("_s") == 0, "no_production").otherwise("compared")
    return sides.join(table, by, "left").withColumn("status", state).drop("_r", "_s"), profile


def ks_flag():
    return (F.col("ks_pvalue") < KS_ALPHA) & (F.col("ks_statistic") >= KS_FLOOR)


def drift_summary(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: maxima, mean, KS count and the sorted lists of features.

    The lists hold one entry per configured feature, never per data row.
    """
    record = F.struct("feature", *NEUTRAL_FEATURE)
    return table.groupBy(*keys).agg(
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("psi_max"),
        F.coalesce(F.avg("psi"), F.lit(0.0)).alias("psi_mean"),
        F.count_if(ks_flag()).alias("ks_features_flagged"),
        F.coalesce(F.max("missing_rate_delta"), F.lit(0.0)).alias("max_missing_rate_delta"),
        F.coalesce(F.max(F.abs("missing_rate_delta")), F.lit(0.0)).alias(
            "max_abs_missing_rate_delta"
        ),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias(
            "drifted_features"
        ),
        F.array_sort(F.collect_list(record)).alias("by_feature"),
    )


def psi_summary(psi: DataFrame, keys: Sequence[str], alert: float) -> DataFrame:
    """psi_max, psi_mean and drifted features from a PSI-only table."""
    return psi.groupBy(*keys).agg(
        F.max("psi").alias("psi_max"),
        F.avg("psi").alias("psi_mean"),
        F.array_sort(F.collect_list(F.when(F.col("psi") >= alert, F.col("feature")))).alias(
            "drifted_features"
        ),
    )


def prediction_psi(
    reference: DataFrame, production: DataFrame, score: str = "score"
) -> DataFrame:
    """Numeric PSI of the score column."""
    return numeric_psi(reference, production, [score]).select(
        F.col("psi").alias("prediction_drift_psi")
    )
