"""Checks on incoming rows: schema conformance, finite values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import is_unusable


def column_conformance(columns: Sequence[str], features: Sequence[str]) -> tuple[list, list]:
    """Missing and unknown column names of a table, sorted."""
    return sorted(set(features) - set(columns)), sorted(set(columns) - set(features))


def require_columns(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The features in model order, or an error that names what is missing or unknown."""
    known = [*features, *extra]
    missing, unknown = column_conformance(df.columns, known)
    if missing:
        raise ValueError(f"missing features: {missing}")
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    return df.select(*known)


def map_conformance(df: DataFrame, instance: str, features: Sequence[str]) -> DataFrame:
    """Missing and unknown keys of a map-typed row, and whether the row conforms."""
    wanted = F.array(*[F.lit(f) for f in sorted(features)])
    keys = F.map_keys(instance)
    return df.withColumns(
        {
            "missing": F.array_sort(F.array_except(wanted, keys)),
            "unknown": F.array_sort(F.array_except(keys, wanted)),
        }
    ).withColumn("conforms", (F.size("missing") == 0) & (F.size("unknown") == 0))


def unusable_columns(features: Sequence[str]) -> Column:
    """Names of the features of a row that are NaN, infinite or missing, in model order."""
    flags = [F.when(is_unusable(F.col(f).cast("double")), F.lit(f)) for f in features]
    return F.filter(F.array(*flags), lambda name: name.isNotNull())


def quarantine(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with the list of unusable features; an empty list means the row can be scored."""
    marked = df.withColumn("bad_features", unusable_columns(features))
    return marked.withColumn("quarantined", F.size("bad_features") > 0)
