"""Where drift sits: in time slices of the window and in segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import (
    MIN_SEGMENT_ROWS,
    ROWS_PER_SLICE,
    TEMPORAL_SLICES,
)
from driftline.operators.drift import feature_psi
from driftline.operators.ordered import lay_out, rows_at_ranks
from driftline.operators.profile import ReferenceProfile, build_profile
from driftline.session import materialise
from driftline.sources.tables import moment


def slice_starts(
    df: DataFrame, ts: str, row_key: str, slices: int = TEMPORAL_SLICES
) -> list[tuple]:
    """The (ts, key) at which every slice after the first begins: at most slices - 1 rows.

    Only time and key are shuffled, by range, and only the runs that contain a boundary rank
    are sorted. The rows of the window themselves never move.
    """

    def starts(total: Column) -> Column:
        parts = F.least(F.lit(slices), F.greatest(F.lit(1), F.floor(total / ROWS_PER_SLICE)))
        each, extra = F.floor(total / parts), total % parts
        return F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(max(1, slices - 1))), lambda j: j < parts),
            lambda j: j * each + F.least(j, extra),
        )

    keyed = df.select(ts, row_key).withColumn("n", F.lit(1).cast("bigint"))
    found = rows_at_ranks(lay_out(keyed, [], [ts, row_key], ["n"]), "n", starts)
    return [tuple(r) for r in found.orderBy("rank").select(ts, row_key).collect()]


def add_slice(df: DataFrame, ts: str, row_key: str, slices: int = TEMPORAL_SLICES) -> DataFrame:
    """Equal parts of the window by (ts, key), the first ones one row longer if it must be."""
    number = F.lit(0)
    for start_ts, start_key in slice_starts(df, ts, row_key, slices):
        start = moment(start_ts, df.schema[ts].dataType)
        after = (F.col(ts) > start) | ((F.col(ts) == start) & (F.col(row_key) >= F.lit(start_key)))
        number = number + after.cast("int")
    return df.withColumn("slice", number)


def slice_bounds(sliced: DataFrame, ts: str) -> DataFrame:
    return sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("ts_start"), F.max(ts).alias("ts_end")
    )


def temporal_drift(
    production: DataFrame,
    features: Sequence[str],
    profile: ReferenceProfile,
    ts: str,
    row_key: str,
    slices: int = TEMPORAL_SLICES,
) -> DataFrame:
    """Largest PSI of each slice against the whole reference, whose profile is built once."""
    sliced = add_slice(production, ts, row_key, slices)
    worst = feature_psi(sliced, features, profile, ["slice"]).groupBy("slice").agg(
        F.round(F.max("psi"), 4).alias("psi_max")
    )
    return slice_bounds(sliced, ts).join(worst, "slice")


def sustained(temporal: DataFrame, alert: float) -> DataFrame:
    """True when at least max(2, ceil(k/2)) of the k slices reach the alert band.

    The PSI compared is the one rounded to four digits, as shown in the slice table.
    """
    breached = F.count_if(F.col("psi_max") >= alert)
    needed = F.greatest(F.lit(2), F.floor((F.count(F.lit(1)) + 1) / 2))
    return temporal.agg(
        F.count(F.lit(1)).alias("n_slices"),
        breached.alias("n_breached"),
        (breached >= needed).alias("sustained"),
    )


def segment_list(
    production: DataFrame, known: DataFrame, segment: str, limit: int | None = None, min_rows: int = MIN_SEGMENT_ROWS
) -> DataFrame:
    """Every segment of the window with its rows and status, written once for its readers.

    A segment is `checked`, has `insufficient_data`, or has `no_reference` because it is not among
    the `known` ones. Only an explicit
    `limit` cuts the list, to the first values in ascending order.
    """
    counted = production.filter(F.col(segment).isNotNull()).groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    if limit is not None:
        counted = counted.orderBy(segment).limit(limit)
    known = known.select(segment).distinct().withColumn("_known", F.lit(True))
    state = (
        F.when(F.col("n") < min_rows, "insufficient_data")
        .when(F.col("_known").isNull(), "no_reference")
        .otherwise("checked")
    )
    listed = counted.join(known, segment, "left").select(segment, "n", state.alias("status"))
    return materialise(listed, "segments")


def segment_drift(
    reference: DataFrame | None,
    production: DataFrame,
    features: Sequence[str],
    segment: str,
    limit: int | None = None,
    min_rows: int = MIN_SEGMENT_ROWS,
    profile: ReferenceProfile | None = None,
) -> DataFrame:
    """Largest PSI inside each segment, with edges and categories from the segment's own
    reference rows; NULL for a segment that cannot be checked. All segments share one pass: the
    segment is a group key, and a hot one combines map-side or is spread by the range layout. With a saved profile per segment the
    reference is not read."""
    listed = segment_list(production, reference if profile is None else profile.features, segment, limit, min_rows)
    checked = listed.filter("status = 'checked'").select(segment)
    if profile is None:
        profile = build_profile(reference.join(checked, segment, "left_semi"), features, [segment], max_groups=limit)
    psi = feature_psi(production.join(checked, segment, "left_semi"), features, profile)
    worst = psi.groupBy(segment).agg(F.round(F.max("psi"), 4).alias("psi_max"))
    return listed.join(worst, segment, "left").select(segment, "n", "psi_max", "status")


def top_features(table: DataFrame, k: int = 5) -> DataFrame:
    """The k features with the largest PSI (a top-k report)."""
    return table.orderBy(F.col("psi").desc(), "feature").limit(k)


def inspect_feature(table: DataFrame, name: str) -> DataFrame:
    """One feature's whole record, and for an unknown name the sorted list of known ones.

    The list has one entry per configured feature.
    """
    return table.agg(
        F.lit(name).alias("wanted"),
        F.max(F.when(F.col("feature") == name, F.struct(*[c for c in table.columns if c != "feature"]))).alias(
            "record"
        ),
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("available"),
    ).select("wanted", "record.*", "available")
