"""Drift from mergeable sketches: quantile and distinct-count sketches per date, without any
shuffle of single readings (approximate D1, D5-D14).

A sketch row holds, for (keys, feature), exact counts and moments, a KLL quantile sketch and an HLL
distinct sketch; rows merge by aggregation, so what is stored per date answers for any span of
dates. For evaluation a quantile sketch becomes POINTS equally likely values, whose distribution
function is nowhere further than `reach` from the true one. All statistics come from these values,
and carry the error that follows:

* KS differs from the exact statistic by at most the reach of both sides.
* PSI lies between the bounds `psi_low` and `psi_high`: every exact edge lies between the quantiles
  one reach and two readings below and above its own, which bounds the share below it on each side. Of
  the reference at most the edge's own share lies below it. So the readings of each cell are bounded; a
  cell's term is convex in the two shares, so its extremes are at the corners, or 0 where the shares can
  be equal. Where the sketch holds all readings, edges are the exact ones.

The reach holds with the confidence that the sketch states for its rank error, 99 %. Features with at
most 15 distinct reference values are counted by value, exactly; their PSI has no error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import CATEGORICAL_LIMIT, DriftConfig
from driftline.functions.scalars import is_infinite, ks_asymptotic
from driftline.operators.drift import psi_from_counts
from driftline.operators.profile import QUANTILES, to_long
from driftline.session import broadcast_bounded

SKETCH_SIZE = 4096
POINTS = SKETCH_SIZE  # every reading of a side that the sketch holds whole is among the points
DISTINCT_BITS = 12
DATE = "event_date"
MEASURES = ("n_rows", "n_present", "mean", "squares", "low", "high", "quantiles", "distinct")


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The rank error that a quantile sketch of this size keeps in 99 of 100 cases (published fit)."""
    return max(2.446 / size**0.9433, 2.296 / size**0.9723)


def reach(n: Column, size: int = SKETCH_SIZE) -> Column:
    """How far the distribution of the points may be from the one of n readings, anywhere. A sketch
    with room for all readings keeps them all."""
    return F.lit(0.5 / POINTS) + F.when(n > size, rank_error(size)).otherwise(0.0)


def sketch(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), quarantine: bool = False, size: int = SKETCH_SIZE) -> DataFrame:
    """One row per (keys, feature). One scan; every task sends one small row for each key and feature.

    `quarantine` leaves infinite readings out, as for a reference."""
    long = to_long(df, features, keys)
    if quarantine:
        long = long.where(F.col("value").isNull() | ~is_infinite(F.col("value")))
    value = F.col("value")
    return long.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_present"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("squares"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.kll_sketch_agg_double(value, F.lit(size)).alias("quantiles"),
        F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), DISTINCT_BITS).alias("distinct"),
    )


def merge(rows: DataFrame, keys: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Sketch rows of parts to those of their union, per (keys, feature)."""
    by = [*keys, "feature"]
    n = F.col("n_present")
    whole = F.sum(n * F.col("mean")) / F.nullif(F.sum(n), F.lit(0))
    # Squares around the common mean: those around each part's mean, and the means' own distances. The
    # list has a row for each part, a date or a slice, never one for each reading.
    found = rows.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(n).alias("n_present"),
        whole.alias("mean"),
        F.sum("squares").alias("_inside"),
        F.collect_list(F.struct(n.alias("n"), F.col("mean").alias("m"))).alias("_parts"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", F.lit(size)).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    between = F.aggregate(
        "_parts", F.lit(0.0),
        lambda acc, p: acc + F.coalesce(p["n"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")), F.lit(0.0)),
    )
    return found.withColumn("squares", F.coalesce("_inside", F.lit(0.0)) + between).select(*by, *MEASURES)


def value_table(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), quarantine: bool = False) -> DataFrame:
    """Counts of single values of features that are known to be categorical; missing ones are a value."""
    if not features:
        return df.sparkSession.createDataFrame([], _value_schema(df, keys))
    long = to_long(df, features, keys)
    if quarantine:
        long = long.where(F.col("value").isNull() | ~is_infinite(F.col("value")))
    return long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _value_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return f"{kinds}feature string, value double, n bigint"


def categorical_names(sketches: DataFrame, numeric: Sequence[str] = ()) -> list[str]:
    """Features with at most 15 distinct readings over all their sketch rows. The distinct sketch
    stores so few values one by one, so the count is exact; at most one name for each feature."""
    merged = sketches.groupBy("feature").agg(F.hll_union_agg("distinct").alias("distinct"))
    few = merged.where(F.hll_sketch_estimate("distinct") <= CATEGORICAL_LIMIT)
    return sorted(r.feature for r in few.collect() if r.feature not in numeric)


def store_dates(df: DataFrame, features: Sequence[str], ts: str, path: str, categorical: Sequence[str] = (), quarantine: bool = False) -> None:
    """Keep the sketches and value counts of every date of df; a date that comes again replaces
    its own folder, so late rows are taken in by sketching their date anew, and a retry changes nothing."""
    dated = df.withColumn(DATE, F.to_date(ts))
    for name, rows in (
        ("sketches", sketch(dated, features, [DATE], quarantine)),
        ("values", value_table(dated, list(categorical), [DATE], quarantine)),
    ):
        rows.repartition(DATE).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(DATE).parquet(f"{path}/{name}")


def load_dates(spark: SparkSession, path: str, first, last) -> tuple[DataFrame, DataFrame]:
    """Merged sketches and value counts from `first` to `last`, both included; only their folders are read."""
    inside = F.col(DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    sketches = spark.read.parquet(f"{path}/sketches").where(inside)
    values = spark.read.schema(f"feature string, value double, n bigint, {DATE} date").parquet(f"{path}/values").where(inside)
    return merge(sketches), values.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def with_points(sketches: DataFrame) -> DataFrame:
    """sketches with `points`, the values at POINTS equally spaced ranks, and NULL without readings."""
    # One literal: thousands of them would be analysed again with every step of the plan.
    ranks = ",".join(str((k + 0.5) / POINTS) for k in range(POINTS))
    points = F.expr(f"kll_sketch_get_quantile_double(quantiles, cast(split('{ranks}', ',') AS array<double>))")
    filled = sketches.where("n_present > 0").withColumn("points", points)
    empty = sketches.where("n_present = 0").withColumn("points", F.lit(None).cast("array<double>"))
    return filled.unionByName(empty).withColumn("reach", reach(F.col("n_present")))


def with_edges(sketches: DataFrame) -> DataFrame:
    """sketches of with_points() with `edges`: for each inner quantile its share, value, and the least and
    most that the exact one can be. The value is interpolated between two neighbouring readings."""
    shares = f"array({', '.join(f'{q}D' for q in QUANTILES[1:-1])})"

    def at(rank: str) -> str:
        return f"get(points, cast(least(greatest(floor(({rank}) * {POINTS}), 0), {POINTS - 1}) AS int))"

    place = "floor((n_present - 1) * q)"
    lower, upper = (at(f"({place} + {half}D) / n_present") for half in (0.5, 1.5))
    value = f"({lower} + ({upper} - {lower}) * ((n_present - 1) * q - {place}))"
    low, high = at("q - reach - 1.0D / n_present"), at("q + reach + 2.0D / n_present")
    whole = f"n_present <= {SKETCH_SIZE}"
    edge = (
        f"named_struct('q', q, 'e', {value}, 'low', IF({whole}, {value}, least({low}, {value})), "
        f"'high', IF({whole}, {value}, greatest({high}, {value})))"
    )
    return sketches.withColumn("edges", F.expr(f"IF(n_present > 0, transform({shares}, q -> {edge}), NULL)"))


# One row per feature below this line, so lambdas are cheap.
_GAP = """aggregate(
  array_sort(concat(transform(ref_points, x -> struct(x AS v, 1 AS r, 0 AS p)), transform(prod_points, x -> struct(x AS v, 0 AS r, 1 AS p)))),
  named_struct('v', cast(NULL AS double), 'r', 0, 'p', 0, 'd', 0),
  (a, x) -> named_struct('v', x.v, 'r', a.r + x.r, 'p', a.p + x.p, 'd', IF(a.v = x.v, a.d, greatest(a.d, abs(a.r - a.p)))),
  a -> a.d)"""


def _below(points: str, edge: str) -> str:
    """Share of readings below an edge."""
    return f"(size(filter({points}, x -> x < {edge})) / {POINTS}.0D)"


def numeric_rows(joined: DataFrame) -> DataFrame:
    """PSI with its bounds, and the KS statistic with its error, of the features with readings on both sides."""
    # Edges that fall together are one, and those on the ends of the support are none.
    kept = "filter(ref_edges, (x, i) -> x.e > ref_bottom AND x.e < ref_top AND (i = 0 OR x.e <> ref_edges[greatest(i - 1, 0)].e))"
    frame = joined.withColumn("edges", F.expr(kept)).withColumn("cells", F.size("edges") + 1)

    def shares(of: str) -> str:
        return f"concat(array(0.0D), transform(edges, e -> {of}), array(1.0D))"

    for side in ("ref", "prod"):
        points, reach_ = f"{side}_points", f"{side}_reach"
        frame = frame.withColumn(f"{side}_e", F.expr(shares(_below(points, "e.e"))))
        frame = frame.withColumn(f"{side}_low", F.expr(shares(f"greatest({_below(points, 'e.low')} - {reach_}, 0.0D)")))
        top = "least(e.q + 1.0D / ref_present, 1.0D)" if side == "ref" else "1.0D"
        frame = frame.withColumn(f"{side}_high", F.expr(shares(f"least({_below(points, 'e.high')} + {reach_}, {top})")))
    each = "sequence(0, cells - 1)"
    for side in ("ref", "prod"):
        n = f"{side}_present"
        frame = frame.withColumns({
            f"{side}_c": F.expr(f"transform({each}, i -> {n} * ({side}_e[i + 1] - {side}_e[i]))"),
            f"{side}_least": F.expr(f"transform({each}, i -> {n} * greatest({side}_low[i + 1] - {side}_high[i], 0.0D))"),
            f"{side}_most": F.expr(f"transform({each}, i -> {n} * ({side}_high[i + 1] - {side}_low[i]))"),
            f"{side}_gone": F.expr(f"cast({side}_rows - {side}_present AS double)"),
            f"{side}_total": F.expr(f"{side}_rows + cells + 1.0D"),
        })
    term = lambda p, q: f"(({q} - {p}) * ln({q} / {p}))"
    share = lambda side, c: f"(({side}_{c}[i] + 1.0D) / {side}_total)"
    gone = term(*[f"(({s}_gone + 1.0D) / {s}_total)" for s in ("ref", "prod")])
    corners = ", ".join(term(share("ref", a), share("prod", b)) for a in ("least", "most") for b in ("least", "most"))
    apart = f"greatest({share('ref', 'least')} - {share('prod', 'most')}, {share('prod', 'least')} - {share('ref', 'most')})"
    total = lambda body: F.expr(f"aggregate({each}, {gone}, (acc, i) -> acc + {body})")
    return frame.select(
        *[c for c in joined.columns],
        total(term(share("ref", "c"), share("prod", "c"))).alias("psi"),
        total(f"IF({apart} > 0, least({corners}), 0.0D)").alias("psi_low"),
        total(f"greatest({corners})").alias("psi_high"),
        F.expr(f"{_GAP} / {POINTS}.0D").alias("ks_statistic"),
        F.expr("least(ref_reach + prod_reach, 1.0D)").alias("ks_error"),
    )


def sketch_drift(
    reference: DataFrame, production: DataFrame, ref_values: DataFrame, prod_values: DataFrame,
    categorical: Sequence[str], config: DriftConfig | None = None, keys: Sequence[str] = (), max_rows: int | None = None,
) -> DataFrame:
    """The drift table per (keys, feature) of merged sketches, with `psi_low`, `psi_high` and `ks_error`.

    Only (keys, feature) with rows on both sides are compared. The reference and its values may have
    fewer keys: a whole reference then stands beside every key of production."""
    config = config or DriftConfig()
    shared = [k for k in keys if k in reference.columns]
    by = [*shared, "feature"]

    def side(found: DataFrame, name: str, own: Sequence[str]) -> DataFrame:
        rows = with_edges(with_points(found)) if name == "ref" else with_points(found)
        renamed = {"n_rows": "rows", "n_present": "present", "mean": "mean", "squares": "squares", "low": "bottom", "high": "top", "points": "points", "reach": "reach"}
        renamed |= {"edges": "edges"} if name == "ref" else {}
        return rows.select(*own, "feature", *[F.col(c).alias(f"{name}_{n}") for c, n in renamed.items()])

    joined = side(production, "prod", keys).join(broadcast_bounded(side(reference, "ref", shared), max_rows), by)
    named = F.col("feature").isin(list(categorical)) if categorical else F.lit(False)
    both = F.expr("ref_present > 0 AND prod_present > 0")
    measured = numeric_rows(joined.where(both))
    lone = joined.where(~both).select(
        "*", *[F.lit(0.0).alias(c) for c in ("psi", "psi_low", "psi_high", "ks_statistic", "ks_error")]
    )
    table = measured.unionByName(lone).withColumn("is_categorical", named)
    if categorical:
        counted = _category_psi(ref_values, prod_values, list(keys), shared)
        exact = counted.withColumnRenamed("psi", "_exact")
        table = table.join(exact, [*keys, "feature"], "left")
        for c in ("psi", "psi_low", "psi_high"):
            table = table.withColumn(c, F.when(named, F.coalesce("_exact", F.lit(0.0))).otherwise(F.col(c)))
    missing = lambda s: f"coalesce(({s}_rows - {s}_present) / nullif({s}_rows, 0), 0.0D)"
    p_value = ks_asymptotic("ks_statistic", "ref_present", "prod_present")
    return table.selectExpr(
        *keys, "feature", "psi", "psi_low", "psi_high", "ks_statistic", "ks_error",
        f"IF(ref_present > 0 AND prod_present > 0, {p_value}, 1.0D) AS ks_pvalue",
        "IF(ref_present > 0 AND prod_present > 0, 'approximate', 'none') AS ks_method",
        "coalesce(ref_mean, 0.0D) AS ref_mean", "coalesce(prod_mean, 0.0D) AS prod_mean",
        "coalesce(sqrt(ref_squares / nullif(ref_present, 0)), 0.0D) AS ref_std",
        "coalesce(sqrt(prod_squares / nullif(prod_present, 0)), 0.0D) AS prod_std",
        f"{missing('prod')} - {missing('ref')} AS missing_rate_delta", "is_categorical",
        f"psi >= {config.psi_alert}D AS drifted",
    )


def _category_psi(reference: DataFrame, production: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """PSI of value counts: the values seen on either side, and a missing cell that always exists."""
    groups = production.select(*keys, "feature").distinct()
    known = groups.join(reference.withColumnRenamed("n", "r"), [*shared, "feature"]).select(*keys, "feature", "value", "r", F.lit(0).cast("bigint").alias("s"))
    seen = production.select(*keys, "feature", "value", F.lit(0).cast("bigint").alias("r"), F.col("n").alias("s"))
    missing = groups.select(*keys, "feature", F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("s"))
    cells = known.unionByName(seen).unionByName(missing).groupBy(*keys, "feature", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    return psi_from_counts(cells, [*keys, "feature"], "r", "s")
