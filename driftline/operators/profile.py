"""Reference profile: quantile edges, bins, categories, moments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import BINS, CATEGORICAL_LIMIT
from driftline.functions.scalars import KS_EXACT_ROWS, is_infinite, ks_method, ks_pvalue, reading
from driftline.operators.ordered import RUN, Runs, lay_out, running_totals
from driftline.session import broadcast_bounded, materialise

# The quantile points as decimal literals (i * 0.1 would miss some of them).
QUANTILES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
DEGENERATE_MARGIN = 1e-6


def to_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value): one row per reading; the scan keeps only these columns."""
    slim = df.select(*keys, *[reading(f).alias(f) for f in features])
    return slim.unpivot(list(keys), list(features), "feature", "value")


def reference_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form of a reference table; infinite readings are quarantined from it."""
    long = to_long(df, features, keys)
    return long.filter(F.col("value").isNull() | ~is_infinite(F.col("value")))


def value_counts(
    reference: DataFrame, production: DataFrame | None, keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct readings with their count on each side; combined map-side before the shuffle.

    The reference is in long form, or its saved counts with a column `n_ref`. `f_ref` and
    `f_prod` are the same counts with missing readings left out.
    """
    counted_before = F.col("n_ref") if "n_ref" in reference.columns else F.lit(1)
    tagged = reference.select(*keys, "feature", "value", counted_before.alias("_r"), F.lit(0).alias("_p"))
    if production is not None:
        tagged = tagged.unionByName(production.withColumns({"_r": F.lit(0), "_p": F.lit(1)}))
    counted = tagged.groupBy(*keys, "feature", "value").agg(
        F.sum("_r").alias("n_ref"), F.sum("_p").alias("n_prod")
    )
    present = F.col("value").isNotNull()
    return counted.withColumns(
        {
            "f_ref": F.when(present, F.col("n_ref")).otherwise(F.lit(0)),
            "f_prod": F.when(present, F.col("n_prod")).otherwise(F.lit(0)),
        }
    )


def lay_out_values(counts: DataFrame, keys: Sequence[str] = ()) -> Runs:
    return lay_out(counts, [*keys, "feature"], ["value"], ["f_ref", "f_prod"])


# The quantile points as SQL, and the 0-based ranks that linear interpolation needs at them.
POINTS_SQL = "array(" + ", ".join(f"{q}D" for q in QUANTILES) + ")"
RANKS_SQL = f"""
  IF(present_ref > 0,
     array_distinct(flatten(transform({POINTS_SQL}, q -> array(
       floor((present_ref - 1) * q), least(floor((present_ref - 1) * q) + 1, present_ref - 1))))),
     cast(array() AS array<bigint>))"""
EDGES_SQL = f"""
  IF(present_ref > 0, array_sort(array_distinct(transform({POINTS_SQL}, q ->
       try_element_at(_at, floor((present_ref - 1) * q))
       + (try_element_at(_at, least(floor((present_ref - 1) * q) + 1, present_ref - 1))
          - try_element_at(_at, floor((present_ref - 1) * q)))
         * ((present_ref - 1) * q - floor((present_ref - 1) * q))))), NULL)"""


def order_statistics(runs: Runs, exact_rows: int = KS_EXACT_ROWS) -> DataFrame:
    """Exact quantile edges of the reference side and the two-sample KS statistic per key.

    Both come from one pass over as few runs as possible. A run is read and sorted only if
    it contains a rank some quantile needs, or if it can hold the largest gap between the
    two distribution functions: the gap at the end of every run is known from the totals
    alone and gives a lower bound, and a run whose totals cannot exceed that bound is
    skipped. The collected list has at most 22 entries per key. The p-value is exact up to
    `exact_rows` readings on a side, `ks_method` tells which.
    """
    keys = list(runs.keys)
    part = f"OVER (PARTITION BY {', '.join(keys)})"
    both = "present_ref > 0 AND present_prod > 0"
    bounded = (
        runs.totals.selectExpr(
            "*",
            f"sum(f_ref_run) {part} AS present_ref",
            f"sum(f_prod_run) {part} AS present_prod",
            f"min({RUN}) {part} AS _first",
        )
        .selectExpr(
            "*",
            f"{RANKS_SQL} AS _ranks",
            f"IF({both}, f_ref_before / nullif(present_ref, 0), NULL) AS _ref_lo",
            f"IF({both}, (f_ref_before + f_ref_run) / nullif(present_ref, 0), NULL) AS _ref_hi",
            f"IF({both}, f_prod_before / nullif(present_prod, 0), NULL) AS _prod_lo",
            f"IF({both}, (f_prod_before + f_prod_run) / nullif(present_prod, 0), NULL) AS _prod_hi",
        )
        .selectExpr(
            "*",
            "greatest(_ref_hi - _prod_lo, _prod_hi - _ref_lo) AS _reach",
            f"max(abs(_ref_hi - _prod_hi)) {part} AS _floor",
        )
    )
    wanted = bounded.filter(
        "exists(_ranks, r -> f_ref_before <= r AND r < f_ref_before + f_ref_run) "
        "OR coalesce(_reach > _floor, false)"
    )
    # Cheap test that a quantile point can lie in the row at all; it stays in codegen, and
    # only the few rows that pass it run the lambda.
    steps = f"{BINS}.0D / nullif(present_ref - 1, 0)"
    near = (
        f"coalesce(floor(f_ref_upto * {steps} + 1e-6D) >= ceil((f_ref_prior - 1) * {steps} - 1e-6D), true)"
    )
    inner = (
        running_totals(runs, wanted)
        .selectExpr(
            *keys,
            "value",
            f"IF({both}, abs(f_ref_upto / nullif(present_ref, 0) - f_prod_upto / nullif(present_prod, 0)), NULL) AS _gap",
            f"IF({near}, filter(_ranks, r -> f_ref_prior <= r AND r < f_ref_upto), NULL) AS _covered",
        )
        .groupBy(*keys)
        .agg(
            F.expr("max(_gap) AS _inner"),
            F.expr("collect_list(IF(size(_covered) > 0, struct(_covered AS at, value), NULL)) AS _found"),
        )
    )
    # One row per key without another shuffle: the windows above already gathered each key.
    outer = bounded.filter(f"{RUN} = _first").select(*keys, "present_ref", "present_prod", "_floor")
    looked_up = "flatten(transform(_found, f -> transform(f.at, rank -> struct(rank, f.value))))"
    margin = f"cast({DEGENERATE_MARGIN} AS double)"
    return (
        outer.join(inner, keys, "left")
        .selectExpr(
            *keys, "present_ref", "present_prod",
            "coalesce(greatest(_floor, _inner), 0.0D) AS ks_statistic",
            f"map_from_entries({looked_up}) AS _at",
        )
        .selectExpr("*", f"{EDGES_SQL} AS _edges")
        .selectExpr(
            *keys, "present_ref", "present_prod", "ks_statistic",
            f"IF(size(_edges) < 2, array(_edges[0] - {margin}, _edges[0] + {margin}), _edges) AS edges",
        )
        .withColumn("ks_method", ks_method("ks_statistic", "present_ref", "present_prod", exact_rows))
        .withColumn("ks_pvalue", ks_pvalue("ks_statistic", "present_ref", "present_prod", "ks_method"))
    )


def quantile_edges(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """D1 for every feature that has a present reading."""
    runs = lay_out_values(value_counts(reference_long(reference, features), None))
    return order_statistics(runs).filter("edges IS NOT NULL").select("feature", "edges")


def approximate_edges(
    reference: DataFrame, keys: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Sketch-based edges: one map-side-combined pass, relative rank error 1/accuracy."""
    cuts = F.percentile_approx("value", F.array(*[F.lit(q) for q in QUANTILES]), accuracy)
    return (
        reference.groupBy(*keys, "feature")
        .agg(F.array_sort(F.array_distinct(cuts)).alias("_edges"))
        .filter(F.col("_edges").isNotNull())
        .select(
            *keys,
            "feature",
            F.when(
                F.size("_edges") < 2,
                F.array(
                    F.element_at("_edges", 1) - DEGENERATE_MARGIN,
                    F.element_at("_edges", 1) + DEGENERATE_MARGIN,
                ),
            )
            .otherwise(F.col("_edges"))
            .alias("edges"),
        )
    )


def add_bin_columns(profile: DataFrame) -> DataFrame:
    """n_bins and the interior edges b1..b9 as plain columns (NULL where edges collapsed)."""
    interior = [f"IF({i} < size(edges) - 1, get(edges, {i}), NULL) AS b{i}" for i in range(1, BINS)]
    return profile.selectExpr("*", "size(edges) - 1 AS n_bins", *interior)


def cell(value: str = "value") -> Column:
    """Histogram cell: the value itself for a categorical feature, its bin otherwise, NULL
    for a missing reading.

    A bin is [e_i, e_i+1), the last one closed; readings outside the reference support fall
    into the outer bins. Plain comparisons with the interior edges keep this in codegen.
    """
    above = " + ".join(f"coalesce(cast({value} >= b{i} AS int), 0)" for i in range(1, BINS))
    return F.expr(
        f"CASE WHEN {value} IS NULL THEN NULL WHEN is_categorical THEN {value} "
        f"ELSE cast(1 + {above} AS double) END"
    )


class ReferenceProfile:
    """What a production window is compared with.

    `features` has one row per (keys, feature): edges, bins, categorical flag. `cells` is the
    full cell grid with the reference counts. Both are written once, so that any number of
    checks reads two small tables instead of the reference, and Spark knows their size.
    """

    def __init__(
        self, features: DataFrame, cells: DataFrame, keys: Sequence[str], max_rows: int | None
    ) -> None:
        self.features = features
        self.keys = tuple(keys)
        self.max_rows = max_rows
        self._cells = cells

    @cached_property
    def cells(self) -> DataFrame:
        return materialise(self._cells, "cells")

    def small_features(self) -> DataFrame:
        return broadcast_bounded(self.features, self.max_rows)

    def small_cells(self) -> DataFrame:
        # A feature has at most 10 bins or 15 categories, and the missing cell.
        bound = None if self.max_rows is None else self.max_rows * (CATEGORICAL_LIMIT + 1)
        return broadcast_bounded(self.cells, bound)

    def save(self, path: str) -> None:
        """Keep the profile next to the model; a check then needs no reference scan."""
        self.features.write.mode("overwrite").parquet(f"{path}/features")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")


def load_profile(
    spark: SparkSession, path: str, keys: Sequence[str] = (), max_rows: int | None = None
) -> ReferenceProfile:
    loaded = ReferenceProfile(
        spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/cells"), keys, max_rows
    )
    loaded.__dict__["cells"] = loaded._cells
    return loaded


def cell_grid(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every cell that must exist even when empty: all bins, and the missing cell."""
    missing = "array(cast(NULL AS double))"
    bins = "transform(sequence(1, n_bins), b -> cast(b AS double))"
    return profile.selectExpr(
        *keys,
        "feature",
        f"explode(IF(is_categorical OR n_bins IS NULL, {missing}, concat({bins}, {missing}))) AS cell",
    )


def profile_from_runs(
    runs: Runs,
    keys: Sequence[str] = (),
    max_rows: int | None = None,
    numeric: Sequence[str] = (),
) -> ReferenceProfile:
    """Profile of the reference side of laid-out value counts.

    A feature with at most 15 distinct reference values is categorical, unless it is listed
    in `numeric` (scores always are).
    """
    by = [*keys, "feature"]
    stats = runs.rows.groupBy(*by).agg(
        F.expr("count_if(f_ref > 0) AS n_distinct"),
        F.expr("sum(n_ref) AS ref_rows"),
        F.expr("sum(n_prod) AS prod_rows"),
        *[
            F.expr(f"sum(value * f_{s}) / nullif(sum(f_{s}), 0) AS mean_{s}") for s in ("ref", "prod")
        ],
    ).filter("ref_rows > 0")
    flag = F.col("n_distinct") <= CATEGORICAL_LIMIT
    if numeric:
        flag = flag & ~F.col("feature").isin(list(numeric))
    features = materialise(
        add_bin_columns(
            stats.withColumn("is_categorical", flag).join(order_statistics(runs), by, "left")
        ),
        "profile",
    )
    counted = (
        runs.rows.filter("n_ref > 0")
        .join(broadcast_bounded(features, max_rows), by)
        .select(*by, cell().alias("cell"), F.col("n_ref").alias("r"))
    )
    grid = cell_grid(features, keys).withColumn("r", F.lit(0).cast("bigint"))
    cells = counted.unionByName(grid).groupBy(*by, "cell").agg(F.sum("r").alias("r"))
    return ReferenceProfile(features, cells, tuple(keys), max_rows)


def build_profile(
    reference: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    max_groups: int | None = None,
    numeric: Sequence[str] = (),
) -> ReferenceProfile:
    """Profile of a reference table; `max_groups` is the proven bound on distinct `keys`."""
    groups = 1 if not keys else max_groups
    max_rows = None if groups is None else groups * len(features)
    runs = lay_out_values(value_counts(reference_long(reference, features, keys), None, keys), keys)
    return profile_from_runs(runs, keys, max_rows, numeric)


def approximate_profile(
    reference: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    max_groups: int | None = None,
    accuracy: int = 10_000,
) -> ReferenceProfile:
    """Profile without any value-level shuffle: sketches for edges and distinct counts.

    Two map-side-combined passes over the reference. The categorical cut stays exact: the
    set of distinct values is kept only up to one more than the limit by the sketch check,
    so features whose sketch is near the limit are counted exactly.
    """
    by = [*keys, "feature"]
    groups = 1 if not keys else max_groups
    max_rows = None if groups is None else groups * len(features)
    long = reference_long(reference, features, keys)
    stats = long.groupBy(*by).agg(
        F.approx_count_distinct("value", 0.02).alias("n_sketch"),
        F.count(F.lit(1)).alias("ref_rows"),
        F.count("value").alias("present_ref"),
    )
    near = stats.filter(F.col("n_sketch") <= 4 * CATEGORICAL_LIMIT).select(*by)
    exact = (
        long.join(broadcast_bounded(near, max_rows), by, "left_semi")
        .groupBy(*by)
        .agg(F.count_distinct("value").alias("n_exact"))
    )
    features_frame = materialise(
        add_bin_columns(
            stats.join(exact, by, "left")
            .withColumn("n_distinct", F.coalesce("n_exact", "n_sketch"))
            .withColumn("is_categorical", F.col("n_distinct") <= CATEGORICAL_LIMIT)
            .drop("n_sketch", "n_exact")
            .join(approximate_edges(long, keys, accuracy), by, "left")
        ),
        "profile",
    )
    counted = (
        long.join(broadcast_bounded(features_frame, max_rows), by)
        .select(*by, cell().alias("cell"), F.lit(1).cast("bigint").alias("r"))
    )
    grid = cell_grid(features_frame, keys).withColumn("r", F.lit(0).cast("bigint"))
    cells = counted.unionByName(grid).groupBy(*by, "cell").agg(F.sum("r").alias("r"))
    return ReferenceProfile(features_frame, cells, tuple(keys), max_rows)


def moments(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of present readings (0 if none), and the missing rate."""
    return long.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_present"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"),
        F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"),
    )


def categorical_features(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct present readings and the categorical decision, exact.

    Grouping by value first lets the distinct step combine map-side and spreads a hot value.
    """
    values = long.filter("value IS NOT NULL").groupBy(*keys, "feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        values.groupBy(*keys, "feature")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
        .withColumn("is_categorical", F.col("n_distinct") <= CATEGORICAL_LIMIT)
    )


def dataset_fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Row count and two order-free hashes over 60 bits of each row's md5: their sum modulo
    2 ** 60, which keeps repeated rows, and their xor.

    A field is written with its length and a missing one as `-`, so neither NULLs nor separators
    inside values can make two rows look alike. Combined map-side; the columns must be rendered
    to text the caller fixes (decimals for doubles), because engines print doubles differently.
    """
    fields = [F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in map(_column, columns)]
    digest = F.conv(F.substring(F.md5(F.concat(*fields)), 1, 15), 16, 10).cast("bigint")
    # Summed as decimals: 60-bit numbers of 10 ** 18 rows fit.
    total = F.coalesce(F.sum(F.col("_h").cast("decimal(19,0)")), F.lit(0).cast("decimal(29,0)"))
    return df.select(digest.alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.pmod(total, F.lit(2**60).cast("decimal(29,0)")).cast("bigint").alias("fingerprint"),
        F.coalesce(F.bit_xor("_h"), F.lit(0).cast("bigint")).alias("xor_check"),
    )


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
