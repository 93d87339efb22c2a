"""Scalar column expressions shared by the operators; all of them stay inside codegen
except the few higher-order ones, which only run on one row per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters allowed in a retrain reason, and its replacement text.
# Letters, numbers and spaces of any script; combining marks are not word characters here.
REASON_PATTERN = r"(?U)^[\p{L}\p{N}_\s\x1c-\x1f.,:;()\-/%>=<]+$"
REASON_DEFAULT = "drift thresholds breached"
REASON_LENGTH = 200
AUDIT_TEXT_LENGTH = 500


def reading(name: str) -> Column:
    """A feature as double with NaN read as NULL and -0.0 as 0.0."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


def is_unusable(value: Column) -> Column:
    """NaN or infinite; a NULL is missing and counts as unusable too."""
    return value.isNull() | F.isnan(value) | is_infinite(value)


def hash_uniform(key: Sequence[str], seed: Column | int | str, salt: str = "", digits: int = 8) -> Column:
    """Uniform number in [0, 1) fixed by row key, seed and salt, whatever the partitioning.

    It has 4 bits for each of the `digits`; 13 digits fill a double."""
    parts = [F.col(k).cast("string") for k in key]
    parts.append(seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)))
    if salt:
        parts.append(F.lit(salt))
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits)
    return F.conv(digest, 16, 10).cast("bigint") / F.lit(16.0**digits)


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Clip that keeps NULL as NULL (plain least/greatest would skip it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def round_to(value: Column, digits: int) -> Column:
    """Round half up by plain arithmetic, so that every engine gives the same double."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def out(value: Column, digits: int = 6) -> Column:
    """Rounding of a float for output; run it after all threshold tests."""
    return F.round(value, digits) + F.lit(0.0)


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of the positive class, 0 when undefined."""
    return F.coalesce(
        2.0 * tp / F.nullif(2.0 * tp + fp + fn, F.lit(0.0)),
        F.lit(0.0),
    )


def ks_asymptotic(statistic: str, n_ref: str, n_prod: str, terms: int = 100) -> str:
    """SQL of the two-sample p-value from the asymptotic Kolmogorov series.

    Below lambda = 0.2 the series has not settled after `terms` terms and the value
    is 1 to more than ten digits, so it is set there.
    """
    # Empty sides become NULL here, since shared subexpressions are evaluated before the guard.
    pairs = f"nullif(cast({n_ref} AS double) * {n_prod}, 0.0D)"
    root = f"sqrt({pairs} / nullif(cast({n_ref} AS double) + {n_prod}, 0.0D))"
    lam = f"(({root} + 0.12D + 0.11D / {root}) * {statistic})"
    series = (
        f"aggregate(sequence(1, {terms}), 0.0D, (acc, k) -> "
        f"acc + IF(k % 2 = 1, 1.0D, -1.0D) * exp(-2.0D * k * k * {lam} * {lam}))"
    )
    return f"IF(coalesce({lam}, 0.0D) < 0.2D, 1.0D, least(greatest(2.0D * {series}, 0.0D), 1.0D))"


def ks_exact(statistic: str, n_ref: str, n_prod: str) -> str:
    """SQL of the exact two-sample p-value: the chance that a random order of the pooled readings
    moves the two distribution functions at least `statistic` apart.

    An order is a lattice path from (0, 0) to (n, m). The chance to have been outside the band
    |x / n - y / m| < statistic is carried from one diagonal x + y = s to the next: a path to
    (x, y) came from (x - 1, y) with chance x / s, else from (x, y - 1), and has been outside for
    certain if that point is. A diagonal keeps only its points inside the band, so memory grows with
    the band's width, and nothing is subtracted from 1, so small values keep their digits. The
    band's edge is an integer, statistic * n * m, as all gaps are multiples of 1 / (n * m).
    """
    n, m = f"cast({n_ref} AS bigint)", f"cast({n_prod} AS bigint)"
    edge = f"cast(round({statistic} * {n} * {m}) AS bigint)"

    def low(s: str) -> str:
        return f"greatest(0L, {s} - {m}, cast(floor(({s} * {n} - {edge}) / ({n} + {m})) AS bigint) + 1)"

    def high(s: str) -> str:
        return f"least({s}, {n}, cast(ceil(({s} * {n} + {edge}) / ({n} + {m})) AS bigint) - 1)"

    before = "coalesce(get(acc.v, cast(x - {0} - acc.low AS int)), 1.0D)"
    point = f"x / s * {before.format('1')} + (s - x) / s * {before.format('0')}"
    values = f"IF({low('s')} > {high('s')}, cast(array() AS array<double>), transform(sequence({low('s')}, {high('s')}), x -> {point}))"
    return (
        f"aggregate(sequence(1L, {n} + {m}), named_struct('low', 0L, 'v', IF({edge} > 0, array(0.0D), cast(array() AS array<double>))), "
        f"(acc, s) -> named_struct('low', {low('s')}, 'v', {values}), "
        f"acc -> coalesce(get(acc.v, cast({n} - acc.low AS int)), 1.0D))"
    )


# The exact p-value is taken up to this many present readings on the larger side. It costs time for each
# lattice point inside the band, so a band with more than KS_EXACT_POINTS points is left to the
# series if it is so wide, KS_EXACT_WIDTH in the series' own unit, that the value is below 1e-10.
KS_EXACT_ROWS = 10_000
KS_EXACT_POINTS = 200_000
KS_EXACT_WIDTH = 3.5


def ks_method(statistic: str, n_ref: str, n_prod: str, exact_rows: int = KS_EXACT_ROWS) -> Column:
    """`exact`, `asymptotic`, or `none` without readings on a side."""
    pairs = f"nullif(cast({n_ref} AS double) * {n_prod}, 0.0D)"
    narrow = f"2.0D * {statistic} * {pairs} <= {KS_EXACT_POINTS}"
    likely = f"{statistic} * sqrt({pairs} / (cast({n_ref} AS double) + {n_prod})) <= {KS_EXACT_WIDTH}D"
    return F.expr(
        f"CASE WHEN coalesce({n_ref}, 0) = 0 OR coalesce({n_prod}, 0) = 0 THEN 'none' "
        f"WHEN greatest({n_ref}, {n_prod}) <= {exact_rows} AND ({narrow} OR {likely}) THEN 'exact' ELSE 'asymptotic' END"
    )


def ks_pvalue(statistic: str, n_ref: str, n_prod: str, method: str) -> Column:
    """Two-sample p-value by the method that the column `method` names, 1 without readings."""
    return F.expr(
        f"CASE {method} WHEN 'exact' THEN {ks_exact(statistic, n_ref, n_prod)} "
        f"WHEN 'asymptotic' THEN {ks_asymptotic(statistic, n_ref, n_prod)} ELSE 1.0D END"
    )


def clean_reason(reason: Column) -> Column:
    """Plain text is kept up to 200 characters; anything else becomes the default text."""
    safe = F.coalesce(reason.rlike(REASON_PATTERN), F.lit(False))
    return F.substring(F.when(safe, reason).otherwise(F.lit(REASON_DEFAULT)), 1, REASON_LENGTH)


def html_escape(text: Column) -> Column:
    """The five HTML characters, ampersand first."""
    out_text = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out_text = F.replace(out_text, F.lit(raw), F.lit(entity))
    return out_text
