"""Perturbation of the user's own tables to stress-test detectors.

All noise is a function of row key, seed and column, so results do not depend on the
partitioning and a lost task repeats exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import clip, hash_uniform
from driftline.operators.ordered import lay_out, running_totals

# Fixed values of the published scenarios.
FLIP_RATE = 0.35
JITTER = 0.01


@dataclass(frozen=True)
class Shift:
    """How one column moves with intensity i: value * (1 + scale*i) + offset*i + noise,
    then clipped, then rounded half even if `rounded`."""

    column: str
    scale: float = 0.0
    offset: float = 0.0
    normal_sd: float = 0.0
    uniform_width: float = 0.0
    poisson_rate: float = 0.0
    low: float | None = None
    high: float | None = None
    rounded: bool = False


# The covariate shift of the published scenarios.
PUBLISHED_SHIFTS = (
    Shift("monthly_spend", scale=-0.35, offset=-40.0, normal_sd=15.0),
    Shift("credit_utilisation", offset=0.18, normal_sd=0.04, low=0.01, high=0.99),
    Shift("logins_last_30d", scale=-0.5, low=0.0, high=60.0, rounded=True),
    Shift("support_tickets", poisson_rate=1.5, low=0.0, high=20.0),
)


def normal_noise(key: Sequence[str], seed: Column | int, salt: str) -> Column:
    """Standard normal number by the Box-Muller rule from two hashed uniforms."""
    u1 = F.lit(1.0) - hash_uniform(key, seed, f"{salt}-a")
    u2 = hash_uniform(key, seed, f"{salt}-b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_terms(rate: float) -> int:
    """So many terms that the tail behind them is below the resolution of a hashed uniform."""
    return int(rate + 10.0 * math.sqrt(rate) + 20.0)


def poisson_noise(key: Sequence[str], seed: Column | int, salt: str, rate: Column, highest: float) -> Column:
    """Poisson count by inverting the distribution at a hashed uniform; no rate is above `highest`."""
    u = hash_uniform(key, seed, salt)
    steps = F.sequence(F.lit(1), F.lit(poisson_terms(highest)))
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("reached"), (u >= F.exp(-rate)).cast("int").alias("n"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        reached = state["reached"] + term
        return F.struct(term.alias("term"), reached.alias("reached"), (state["n"] + (u >= reached).cast("int")).alias("n"))

    return F.aggregate(steps, start, step, lambda state: state["n"].cast("double"))


def draw_noise(df: DataFrame, shifts: Sequence[Shift], key: Sequence[str], seed: Column | int) -> DataFrame:
    """df with a column `_noise_<column>` for each shift: the part of it that no intensity changes."""
    drawn = {}
    for s in shifts:
        noise = F.lit(0.0)
        if s.normal_sd:
            noise = noise + normal_noise(key, seed, s.column) * F.lit(s.normal_sd)
        if s.uniform_width:
            noise = noise + (hash_uniform(key, seed, s.column) - F.lit(0.5)) * F.lit(s.uniform_width)
        drawn[f"_noise_{s.column}"] = noise
    return df.withColumns(drawn)


def shift_drawn(
    df: DataFrame, shifts: Sequence[Shift], intensity: Column, key: Sequence[str], seed: Column | int, highest: float = 1.0
) -> DataFrame:
    """Move the columns of a frame with drawn noise; the noise columns are dropped."""
    changed = {}
    for s in shifts:
        value = F.col(s.column) * (F.lit(1.0) + F.lit(s.scale) * intensity) + F.lit(s.offset) * intensity + F.col(f"_noise_{s.column}")
        if s.poisson_rate:
            value = value + poisson_noise(key, seed, s.column, F.lit(s.poisson_rate) * intensity, s.poisson_rate * highest)
        if s.low is not None or s.high is not None:
            value = clip(value, s.low, s.high)
        if s.rounded:
            value = F.bround(value, 0)
        changed[s.column] = value
    return df.withColumns(changed).drop(*[f"_noise_{s.column}" for s in shifts])


def inject_covariate_shift(
    df: DataFrame,
    shifts: Sequence[Shift],
    intensity: Column | float,
    key: Sequence[str],
    seed: Column | int,
) -> DataFrame:
    """Shift the listed columns; missing readings stay missing. A column of intensities holds at most 1."""
    i = intensity if isinstance(intensity, Column) else F.lit(float(intensity))
    changed = {}
    for s in shifts:
        value = F.col(s.column) * (F.lit(1.0) + F.lit(s.scale) * i) + F.lit(s.offset) * i
        if s.normal_sd:
            value = value + normal_noise(key, seed, s.column) * F.lit(s.normal_sd)
        if s.uniform_width:
            value = value + (hash_uniform(key, seed, s.column) - F.lit(0.5)) * F.lit(s.uniform_width)
        if s.poisson_rate:
            highest = s.poisson_rate * (1.0 if isinstance(intensity, Column) else max(1.0, float(intensity)))
            value = value + poisson_noise(key, seed, s.column, F.lit(s.poisson_rate) * i, highest)
        if s.low is not None or s.high is not None:
            value = clip(value, s.low, s.high)
        if s.rounded:
            value = F.bround(value, 0)
        changed[s.column] = value
    return df.withColumns(changed)


def inject_label_flip(
    df: DataFrame,
    label: str,
    where: Column,
    intensity: Column | float,
    key: Sequence[str],
    seed: Column | int,
    rate: float = FLIP_RATE,
) -> DataFrame:
    """Invert the label of a random share of the rows that match; no label column, no change."""
    if label not in df.columns:
        return df
    i = intensity if isinstance(intensity, Column) else F.lit(float(intensity))
    flip = where & (hash_uniform(key, seed, "flip") < F.lit(rate) * i)
    return df.withColumn(label, F.when(flip, 1 - F.col(label)).otherwise(F.col(label)))


def bootstrap_jitter(
    pool: DataFrame,
    n: int,
    key: str,
    columns: Sequence[str],
    discrete: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """n draws with replacement from the pool, with small noise on the listed columns.

    The pool gets a dense row number by key through the range layout, and each draw joins
    exactly one pool row on it; no side is broadcast by hint.
    """
    spark = pool.sparkSession
    runs = lay_out(
        pool.select(key, *columns).withColumn("n", F.lit(1).cast("bigint")), [], [key], ["n"]
    )
    numbered = running_totals(runs).select(
        F.col("n_prior").alias("_row"), F.col(key).alias(f"source_{key}"), *columns
    )
    facts = runs.rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.stddev_samp(c).alias(c) for c in columns]
    ).first()
    draws = spark.range(n).withColumnRenamed("id", "draw_id")
    rows = draws.withColumn(
        "_row", F.floor(hash_uniform(["draw_id"], seed, "draw", digits=13) * F.lit(float(facts["rows"])))
    ).join(numbered, "_row")
    jittered = {}
    for c in columns:
        deviation = facts[c] or 1.0
        value = F.col(c) + normal_noise(["draw_id"], seed, c) * F.lit(JITTER * deviation)
        if c in discrete:
            value = F.greatest(F.bround(value, 0), F.lit(0.0)) + F.lit(0.0)
        jittered[c] = F.when(F.col(c).isNotNull(), value)
    return rows.withColumns(jittered).drop("_row")
