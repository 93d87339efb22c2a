"""Queries on distributions: edges, bins, PSI, KS, moments, drift table, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import sql as q
from driftline.functions.scalars import hash_uniform, out
from driftline.operators import drift as d
from driftline.operators import profile as p
from driftline.operators import sketches as sk
from driftline.plans import datasets as ds
from driftline.session import scratch_path
from driftline.sources.tables import moment, read_table

LF = ds.LINEITEM_FEATURES
REF = "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'"
PROD = "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'"
EV_REF = f"SELECT * FROM ({ds.SCORED_SQL}) WHERE ts < TIMESTAMP '2024-01-21'"
EV_PROD = f"SELECT * FROM ({ds.SCORED_SQL}) WHERE ts >= TIMESTAMP '2024-01-21'"
DRIFT_REF = f"SELECT * FROM ({ds.DRIFTING_SQL}) WHERE ts < TIMESTAMP '2024-01-21'"
DRIFT_PROD = f"SELECT * FROM ({ds.DRIFTING_SQL}) WHERE ts >= TIMESTAMP '2024-01-21'"
EACH_DAY = f"SELECT event_type, value, k, CAST(ts AS DATE) AS day FROM ({ds.DRIFTING_SQL})"
WEEK_BEFORE = f"SELECT event_type, value, k, CAST(ts AS DATE) + 7 AS day FROM ({ds.DRIFTING_SQL})"
# A fifth of the production readings go missing, chosen by hash.
GAPPY_PROD = f"""SELECT event_id, event_type, k,
  CASE WHEN {ds.uniform_sql('event_id', 'gap')} < 0.2::DOUBLE THEN NULL ELSE value END AS value
  FROM ({DRIFT_PROD})"""


def drifting_sides(spark: SparkSession, folder: str):
    return ds.split(ds.drifting_events(spark, folder), "ts", ds.EVENT_SPLIT)


def gappy_sides(spark: SparkSession, folder: str):
    ref, prod = drifting_sides(spark, folder)
    gone = hash_uniform(["event_id"], "gap") < 0.2
    return ref, prod.withColumn("value", F.when(~gone, F.col("value")))


def reference_quantile_edges(spark: SparkSession, folder: str) -> DataFrame:
    ref, _ = ds.lineitem_sides(spark, folder)
    edges = p.quantile_edges(ref, LF)
    return edges.select("feature", F.posexplode("edges").alias("edge_no", "edge")).select(
        "feature", "edge_no", out(F.col("edge")).alias("edge")
    )


def feature_histogram(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = ds.lineitem_sides(spark, folder)
    profile = p.build_profile(ref, LF, numeric=LF)
    counted = d.production_cells(p.to_long(prod, LF), profile)
    sides = profile.cells.select("feature", "cell", "r", F.lit(0).cast("bigint").alias("s")).unionByName(
        counted.select("feature", "cell", F.lit(0).cast("bigint").alias("r"), "s")
    )
    return sides.groupBy("feature", F.coalesce(F.col("cell").cast("int"), F.lit(0)).alias("bin")).agg(
        F.sum("r").alias("n_ref"), F.sum("s").alias("n_prod")
    )


def psi_from_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    early = F.col("o_orderdate") < moment(ds.LINEITEM_SPLIT, orders.schema["o_orderdate"].dataType)
    counts = orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count_if(early).alias("r"), F.count_if(~early).alias("s")
    )
    return d.psi_from_counts(counts, ["o_orderstatus"], "r", "s").select(
        "o_orderstatus", out(F.col("psi")).alias("psi")
    )


def psi_numeric(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = gappy_sides(spark, folder)
    return d.numeric_psi(ref, prod, ["value", "k"]).select("feature", out(F.col("psi")).alias("psi"))


def psi_categorical(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = ds.lineitem_sides(spark, folder)
    numbers = d.categorical_psi(ref, prod, ["l_discount", "l_tax"])
    texts = d.categorical_psi(ref, prod, ["l_returnflag", "l_linestatus"], as_text=True)
    return numbers.unionByName(texts).select("feature", out(F.col("psi")).alias("psi"))


def categorical_detection(spark: SparkSession, folder: str) -> DataFrame:
    ref, _ = ds.lineitem_sides(spark, folder)
    return p.categorical_features(p.reference_long(ref, [*LF, "l_linenumber"]))


def missing_rate_delta(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = gappy_sides(spark, folder)
    names = ["value", "k"]
    sides = p.to_long(ref, names).withColumn("side", F.lit("ref")).unionByName(
        p.to_long(prod, names).withColumn("side", F.lit("prod"))
    )
    gone = F.col("value").isNull().cast("int")
    rates = sides.groupBy("feature").agg(
        *[F.avg(F.when(F.col("side") == s, gone)).alias(f"{s}_missing_rate") for s in ("ref", "prod")]
    )
    delta = F.col("prod_missing_rate") - F.col("ref_missing_rate")
    return rates.select(
        "feature",
        out(F.col("ref_missing_rate")).alias("ref_missing_rate"),
        out(F.col("prod_missing_rate")).alias("prod_missing_rate"),
        out(delta).alias("missing_rate_delta"),
    )


def feature_moments(spark: SparkSession, folder: str) -> DataFrame:
    _, prod = ds.lineitem_sides(spark, folder)
    return p.moments(p.to_long(prod, LF)).select(
        "feature", "n", "n_present", out(F.col("mean"), 4).alias("mean"), out(F.col("std"), 4).alias("std"),
        out(F.col("missing_rate")).alias("missing_rate"),
    )


def ks_two_sample(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = ds.lineitem_sides(spark, folder)
    return d.ks_two_sample(ref, prod, LF).select(
        "feature", "n_ref", "n_prod",
        out(F.col("ks_statistic")).alias("ks_statistic"), out(F.col("ks_pvalue")).alias("ks_pvalue"), "ks_method",
    )


def ks_small_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every day after the split against the day a week before it, for each event type: windows of a
    few hundred rows, where the exact p-value and the asymptotic one differ visibly."""
    events = ds.drifting_events(spark, folder)
    day = F.to_date("ts")
    later = events.withColumn("day", day)
    earlier = events.withColumn("day", F.date_add(day, 7))
    found = d.ks_two_sample(earlier, later, ["value", "k"], keys=["event_type", "day"])
    return found.where("n_ref > 0 and n_prod > 0").select(
        "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "feature", "n_ref", "n_prod",
        out(F.col("ks_statistic")).alias("ks_statistic"), out(F.col("ks_pvalue"), 9).alias("ks_pvalue"), "ks_method",
    )


def sketch_drift_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """Drift from sketches stored per date and merged, next to the exact PSI, and whether that PSI and
    the exact KS statistic lie within what the sketches state."""
    names = ["value", "k"]
    ref, prod = gappy_sides(spark, folder)
    path = scratch_path(spark, "dates")
    categorical = sk.categorical_names(sk.sketch(ref, names, quarantine=True))
    kept = []
    for side, df in (("ref", ref), ("prod", prod)):
        sk.store_dates(df, names, "ts", f"{path}/{side}", categorical, quarantine=side == "ref")
        kept += sk.load_dates(spark, f"{path}/{side}", "1970-01-01", "2999-12-31")
    rough = sk.sketch_drift(kept[0], kept[2], kept[1], kept[3], categorical)
    exact = d.feature_drift(ref, prod, names).select("feature", F.col("psi").alias("_psi"), F.col("ks_statistic").alias("_ks"))
    inside = F.expr("_psi BETWEEN psi_low - 1e-9D AND psi_high + 1e-9D AND abs(_ks - ks_statistic) <= ks_error + 1e-9D")
    narrow = F.expr("psi_high - psi_low <= 0.1D + 0.3D * psi AND ks_error <= 0.01D")
    return rough.join(exact, "feature").select(
        "feature", out(F.col("_psi")).alias("psi"), (inside & narrow).alias("within"),
        *[out(F.col(c), 4).alias(c) for c in DRIFT_MOMENTS], out(F.col("missing_rate_delta")).alias("missing_rate_delta"), "is_categorical",
    )


DRIFT_FLOATS = ["psi", "ks_statistic", "ks_pvalue", "missing_rate_delta"]
DRIFT_MOMENTS = ["ref_mean", "prod_mean", "ref_std", "prod_std"]


def rounded_table(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.select(
        *keys, "feature", *[out(F.col(c)).alias(c) for c in DRIFT_FLOATS],
        *[out(F.col(c), 4).alias(c) for c in DRIFT_MOMENTS], "ks_method", "is_categorical", "drifted",
    )


DRIFT_SELECT = (
    f"feature, {q.rounded(*DRIFT_FLOATS)}, {q.rounded(*DRIFT_MOMENTS, digits=4)}, ks_method, is_categorical, drifted"
)


def feature_drift(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = ds.lineitem_sides(spark, folder)
    return rounded_table(d.feature_drift(ref, prod, LF), [])


def feature_drift_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = gappy_sides(spark, folder)
    table = d.feature_drift(ref, prod, ["value", "k"], keys=["event_type"])
    return rounded_table(table, ["event_type"])


def feature_drift_new_segment(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a segment that the reference does not have."""
    ref, prod = gappy_sides(spark, folder)
    known = ref.filter("event_type <> 'signup'")
    table = d.feature_drift(known, prod, ["value", "k"], keys=["event_type"])
    return table.select("event_type", "feature", out(F.col("psi")).alias("psi"), "drifted", "status")


def drift_summary(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = gappy_sides(spark, folder)
    summary = d.drift_summary(d.feature_drift(ref, prod, ["value", "k"]))
    return summary.select(
        *[out(F.col(c)).alias(c) for c in ("psi_max", "psi_mean", "max_missing_rate_delta", "max_abs_missing_rate_delta")],
        "ks_features_flagged",
        F.array_join("drifted_features", ",").alias("drifted_features"),
        F.array_join(F.transform("by_feature", lambda f: f["feature"]), ",").alias("features"),
    )


def prediction_psi(spark: SparkSession, folder: str) -> DataFrame:
    ref, prod = drifting_sides(spark, folder)
    return d.prediction_psi(ref, prod).select(
        out(F.col("prediction_drift_psi")).alias("prediction_drift_psi")
    )


def dataset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    columns = [
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "o_orderpriority",
    ]
    return p.dataset_fingerprint(orders, columns)


QUERIES = {
    "reference_quantile_edges": reference_quantile_edges,
    "feature_histogram": feature_histogram,
    "psi_from_counts": psi_from_counts,
    "psi_numeric": psi_numeric,
    "psi_categorical": psi_categorical,
    "categorical_detection": categorical_detection,
    "missing_rate_delta": missing_rate_delta,
    "feature_moments": feature_moments,
    "ks_two_sample": ks_two_sample,
    "ks_small_windows": ks_small_windows,
    "sketch_drift_by_date": sketch_drift_by_date,
    "feature_drift": feature_drift,
    "feature_drift_by_segment": feature_drift_by_segment,
    "feature_drift_new_segment": feature_drift_new_segment,
    "drift_summary": drift_summary,
    "prediction_psi": prediction_psi,
    "dataset_fingerprint": dataset_fingerprint,
}

CAT_SQL = """SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS cell, r, s FROM (
  SELECT {c}, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1999-01-01') AS r,
         count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1999-01-01') AS s
  FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}
  UNION ALL SELECT NULL, count(*) FILTER (WHERE {c} IS NULL AND l_shipdate < TIMESTAMP '1999-01-01'),
         count(*) FILTER (WHERE {c} IS NULL AND l_shipdate >= TIMESTAMP '1999-01-01') FROM lineitem)"""


def fingerprint_sql(source: str, columns: list[str]) -> str:
    row = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    return f"""SELECT count(*) AS n_rows, CAST(coalesce(sum(h), 0) % {2**60} AS BIGINT) AS fingerprint,
        coalesce(bit_xor(h), 0) AS xor_check
      FROM (SELECT CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) AS h FROM {source})"""


PSI_OF_CELLS = """SELECT {k}, round(sum((q - p) * ln(q / p)), 6) + 0.0::DOUBLE AS psi FROM (
  SELECT {k}, (r + 1.0::DOUBLE) / sum(r + 1.0::DOUBLE) OVER (PARTITION BY {k}) AS p,
         (s + 1.0::DOUBLE) / sum(s + 1.0::DOUBLE) OVER (PARTITION BY {k}) AS q FROM ({cells})) GROUP BY {k}"""

ORACLES = {
    "reference_quantile_edges": f"""WITH {q.profile_ctes(REF, LF)}
      SELECT feature, CAST(i - 1 AS INTEGER) AS edge_no, round(edges[i], 6) + 0.0::DOUBLE AS edge
      FROM (SELECT feature, edges, unnest(range(1, len(edges) + 1)) AS i FROM prof)""",
    "feature_histogram": f"""WITH {q.psi_ctes(REF, PROD, LF, numeric=LF)}
      SELECT a.feature, CAST(coalesce(a.cell, 0) AS INTEGER) AS bin,
             coalesce(r, 0) AS n_ref, coalesce(s, 0) AS n_prod
      FROM grid a LEFT JOIN ref_c b ON a.feature = b.feature AND a.cell IS NOT DISTINCT FROM b.cell
      LEFT JOIN prod_c c ON a.feature = c.feature AND a.cell IS NOT DISTINCT FROM c.cell""",
    "psi_from_counts": PSI_OF_CELLS.format(
        k="o_orderstatus",
        cells="""SELECT o_orderstatus, o_orderpriority,
          count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS r,
          count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS s FROM orders GROUP BY ALL""",
    ),
    "psi_numeric": f"""WITH {q.psi_ctes(DRIFT_REF, GAPPY_PROD, ['value', 'k'], numeric=['value', 'k'])}
      SELECT feature, {q.rounded('psi')} FROM psi""",
    "psi_categorical": PSI_OF_CELLS.format(
        k="feature",
        cells=" UNION ALL ".join(
            CAT_SQL.format(c=c) for c in ("l_discount", "l_tax", "l_returnflag", "l_linestatus")
        ),
    ),
    "categorical_detection": f"""WITH ref_l AS ({q.long_sql(REF, [*LF, 'l_linenumber'])})
      SELECT feature, count(DISTINCT v) AS n_distinct, count(DISTINCT v) <= 15 AS is_categorical
      FROM ref_l GROUP BY feature""",
    "missing_rate_delta": f"""WITH ref_l AS ({q.long_sql(DRIFT_REF, ['value', 'k'])}),
      prod_l AS ({q.long_sql(GAPPY_PROD, ['value', 'k'])}),
      a AS (SELECT feature, avg(CAST(v IS NULL AS INTEGER)) AS x FROM ref_l GROUP BY feature),
      b AS (SELECT feature, avg(CAST(v IS NULL AS INTEGER)) AS y FROM prod_l GROUP BY feature)
      SELECT feature, round(x, 6) + 0.0::DOUBLE AS ref_missing_rate, round(y, 6) + 0.0::DOUBLE AS prod_missing_rate,
             round(y - x, 6) + 0.0::DOUBLE AS missing_rate_delta FROM a JOIN b USING (feature)""",
    "feature_moments": f"""WITH prod_l AS ({q.long_sql(PROD, LF)})
      SELECT feature, count(*) AS n, count(v) AS n_present, round(avg(v), 4) + 0.0::DOUBLE AS mean,
             round(stddev_pop(v), 4) + 0.0::DOUBLE AS std,
             round(avg(CAST(v IS NULL AS INTEGER)), 6) + 0.0::DOUBLE AS missing_rate
      FROM prod_l GROUP BY feature""",
    "ks_two_sample": f"""WITH ref_l AS ({q.long_sql(REF, LF)}), prod_l AS ({q.long_sql(PROD, LF)}), {q.ks_ctes()}
      SELECT feature, n_ref, n_prod, round(d, 6) + 0.0::DOUBLE AS ks_statistic,
             round(p, 6) + 0.0::DOUBLE AS ks_pvalue, method AS ks_method FROM ks""",
    "ks_small_windows": f"""WITH ref_l AS ({q.long_sql(WEEK_BEFORE, ['value', 'k'], ['event_type', 'day'])}),
      prod_l AS ({q.long_sql(EACH_DAY, ['value', 'k'], ['event_type', 'day'])}), {q.ks_ctes(['event_type', 'day'])}
      SELECT event_type, strftime(day, '%Y-%m-%d') AS day, feature, n_ref, n_prod, round(d, 6) + 0.0::DOUBLE AS ks_statistic,
             round(p, 9) + 0.0::DOUBLE AS ks_pvalue, method AS ks_method FROM ks WHERE n_ref > 0 AND n_prod > 0""",
    "sketch_drift_by_date": f"""WITH {q.drift_table_ctes(DRIFT_REF, GAPPY_PROD, ['value', 'k'])}
      SELECT feature, {q.rounded('psi')}, true AS within, {q.rounded(*DRIFT_MOMENTS, digits=4)}, {q.rounded('missing_rate_delta')}, is_categorical FROM drift""",
    "feature_drift": f"WITH {q.drift_table_ctes(REF, PROD, LF)} SELECT {DRIFT_SELECT} FROM drift",
    "feature_drift_by_segment": f"""WITH {q.drift_table_ctes(DRIFT_REF, GAPPY_PROD, ['value', 'k'], ['event_type'])}
      SELECT event_type, {DRIFT_SELECT} FROM drift""",
    "feature_drift_new_segment": f"""WITH {q.drift_table_ctes(f"SELECT * FROM ({DRIFT_REF}) WHERE event_type <> 'signup'", GAPPY_PROD, ['value', 'k'], ['event_type'])}
      SELECT event_type, feature, {q.rounded('psi')}, drifted, 'compared' AS status FROM drift
      UNION ALL SELECT DISTINCT event_type, f, NULL, NULL, 'no_reference' FROM ({GAPPY_PROD}), (SELECT unnest(['value', 'k']) AS f)
      WHERE event_type = 'signup'""",
    "drift_summary": f"""WITH {q.drift_table_ctes(DRIFT_REF, GAPPY_PROD, ['value', 'k'])}
      SELECT round(max(psi), 6) + 0.0::DOUBLE AS psi_max, round(avg(psi), 6) + 0.0::DOUBLE AS psi_mean,
             round(max(missing_rate_delta), 6) + 0.0::DOUBLE AS max_missing_rate_delta,
             round(max(abs(missing_rate_delta)), 6) + 0.0::DOUBLE AS max_abs_missing_rate_delta,
             count(*) FILTER (WHERE ks_pvalue < 0.01 AND ks_statistic >= 0.1) AS ks_features_flagged,
             coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE drifted), '') AS drifted_features,
             string_agg(feature, ',' ORDER BY feature) AS features
      FROM drift""",
    "prediction_psi": f"""WITH {q.psi_ctes(DRIFT_REF, DRIFT_PROD, ['score'], numeric=['score'])}
      SELECT round(psi, 6) + 0.0::DOUBLE AS prediction_drift_psi FROM psi""",
    "dataset_fingerprint": fingerprint_sql("orders", [
        "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "o_orderpriority",
    ]),
}
