"""DuckDB text for the statistics, written as plain definitions (grids, joins, sorted counts)
and not in the shape of the Spark plans, so that the two check each other."""

from __future__ import annotations

from collections.abc import Sequence

QUANTILE_LIST = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"


def comma(names: Sequence[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{n}, " for n in names)


def long_sql(source: str, features: Sequence[str], keys: Sequence[str] = ()) -> str:
    parts = [
        f"SELECT {comma(keys)}'{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM ({source})"
        for f in features
    ]
    return " UNION ALL ".join(parts)


def profile_ctes(reference: str, features: Sequence[str], keys: Sequence[str] = (), numeric: Sequence[str] = ()) -> str:
    """ref_l, prof: long reference and (edges, categorical flag) per key and feature."""
    by = comma(keys)
    forced = "".join(f" AND feature <> '{n}'" for n in numeric)
    return f"""
  ref_l AS ({long_sql(reference, features, keys)}),
  ref_q AS (
    SELECT {by}feature, count(*) AS n, count(v) AS nf, count(DISTINCT v) AS d,
           list_sort(list_distinct(quantile_cont(v, {QUANTILE_LIST}))) AS q,
           (count(DISTINCT v) <= 15{forced}) AS cat
    FROM ref_l GROUP BY {by}feature),
  prof AS (
    SELECT *, CASE WHEN nf = 0 THEN NULL
                   WHEN len(q) < 2 THEN [q[1] - 0.000001::DOUBLE, q[1] + 0.000001::DOUBLE]
                   ELSE q END AS edges
    FROM ref_q)"""


CELL = """CASE WHEN v IS NULL THEN NULL WHEN cat THEN v
              ELSE CAST(greatest(1, least(len(list_filter(edges, lambda e: e <= v)), len(edges) - 1)) AS DOUBLE) END"""


def psi_ctes(
    reference: str,
    production: str,
    features: Sequence[str],
    keys: Sequence[str] = (),
    windows: Sequence[str] = (),
    numeric: Sequence[str] = (),
) -> str:
    """CTEs ending in psi(windows, keys, feature, psi, s, r) for groups with rows on both sides."""
    by, win = comma(keys), comma(windows)
    on_by = " AND ".join(["a.feature = b.feature", *[f"a.{k} = b.{k}" for k in keys]])
    on_all = " AND ".join([on_by, *[f"a.{w} = b.{w}" for w in windows]])
    return profile_ctes(reference, features, keys, numeric) + f""",
  prod_l AS ({long_sql(production, features, [*windows, *keys])}),
  ref_c AS (
    SELECT {comma(keys, 'a.')}a.feature, {CELL} AS cell, count(*) AS r
    FROM ref_l a JOIN prof b ON {on_by} GROUP BY ALL),
  prod_c AS (
    SELECT {comma(windows, 'a.')}{comma(keys, 'a.')}a.feature, {CELL} AS cell, count(*) AS s
    FROM prod_l a JOIN prof b ON {on_by} GROUP BY ALL),
  grp AS (SELECT DISTINCT {win}{by}feature FROM prod_c),
  ref_grid AS (
    SELECT {by}feature, cell FROM ref_c
    UNION SELECT {by}feature, NULL FROM prof
    UNION SELECT {by}feature, CAST(unnest(range(1, len(edges))) AS DOUBLE) FROM prof WHERE NOT cat),
  grid AS (
    SELECT {comma(windows, 'a.')}{comma(keys, 'a.')}a.feature, b.cell
    FROM grp a JOIN ref_grid b ON {on_by}
    UNION SELECT {win}{by}feature, cell FROM prod_c),
  filled AS (
    SELECT {comma(windows, 'a.')}{comma(keys, 'a.')}a.feature, a.cell,
           coalesce(b.r, 0) + 1.0::DOUBLE AS r1, coalesce(c.s, 0) + 1.0::DOUBLE AS s1
    FROM grid a
    LEFT JOIN ref_c b ON {on_by} AND a.cell IS NOT DISTINCT FROM b.cell
    LEFT JOIN prod_c c ON {on_all.replace('b.', 'c.')} AND a.cell IS NOT DISTINCT FROM c.cell),
  shares AS (
    SELECT *, r1 / sum(r1) OVER (PARTITION BY {win}{by}feature) AS p,
              s1 / sum(s1) OVER (PARTITION BY {win}{by}feature) AS q
    FROM filled),
  psi AS (
    SELECT {win}{by}feature, sum((q - p) * ln(q / p)) AS psi
    FROM shares GROUP BY {win}{by}feature)"""


# The exact p-value as 1 - (paths inside the band) / (all paths). Paths are counted diagonal by
# diagonal, halved each time, as numbers of paths do not fit a double; s[1] is the diagonal.
KS_IS_EXACT = """greatest(n_ref, n_prod) <= 10000 AND (2.0::DOUBLE * d * n_ref * n_prod <= 200000
  OR d * sqrt(n_ref::DOUBLE * n_prod / (n_ref + n_prod)) <= 3.5)"""


def _band(s: str) -> tuple[str, str]:
    low = f"greatest(0, {s} - n_prod, CAST(floor(({s} * n_ref - h) / (n_ref + n_prod)::DOUBLE) AS BIGINT) + 1)"
    return low, f"least({s}, n_ref, CAST(ceil(({s} * n_ref + h) / (n_ref + n_prod)::DOUBLE) AS BIGINT) - 1)"


_LOW, _HIGH = _band("CAST(s[1] AS BIGINT)")
_BEFORE = _band("(CAST(s[1] AS BIGINT) - 1)")[0]
KS_PATHS = f"""CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - coalesce(list_reduce(
    list_prepend([1.0::DOUBLE], list_transform(range(1, n_ref + n_prod + 1), lambda t: [CAST(t AS DOUBLE)])),
    lambda paths, s: list_transform(range({_LOW}, {_HIGH} + 1), lambda x:
      (CASE WHEN x - ({_BEFORE}) >= 1 THEN coalesce(paths[x - ({_BEFORE})], 0.0::DOUBLE) ELSE 0.0::DOUBLE END
       + CASE WHEN x - ({_BEFORE}) >= 0 THEN coalesce(paths[x - ({_BEFORE}) + 1], 0.0::DOUBLE) ELSE 0.0::DOUBLE END) / 2))[1], 0.0::DOUBLE)
    * exp((n_ref + n_prod) * ln(2.0::DOUBLE) + lgamma(n_ref + 1) + lgamma(n_prod + 1) - lgamma(n_ref + n_prod + 1)) END"""


def ks_ctes(keys: Sequence[str] = ()) -> str:
    """ks(keys, feature, n_ref, n_prod, d, p) over the CTEs ref_l and prod_l."""
    by = comma(keys)
    over = f"PARTITION BY {by}feature"
    return f"""
  ks_v AS (
    SELECT {by}feature, v, sum(r) AS r, sum(s) AS s FROM (
      SELECT {by}feature, v, 1 AS r, 0 AS s FROM ref_l WHERE v IS NOT NULL
      UNION ALL SELECT {by}feature, v, 0, 1 FROM prod_l WHERE v IS NOT NULL)
    GROUP BY {by}feature, v),
  ks_f AS (
    SELECT {by}feature,
           CAST(sum(r) OVER ({over} ORDER BY v) AS DOUBLE) / sum(r) OVER ({over}) AS fr,
           CAST(sum(s) OVER ({over} ORDER BY v) AS DOUBLE) / sum(s) OVER ({over}) AS fs,
           sum(r) OVER ({over}) AS n_ref, sum(s) OVER ({over}) AS n_prod
    FROM ks_v),
  ks_d AS (
    SELECT {by}feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_prod) AS BIGINT) AS n_prod,
           coalesce(max(abs(fr - fs)), 0.0::DOUBLE) AS d
    FROM ks_f GROUP BY {by}feature),
  ks_l AS (
    SELECT *, (sqrt(n_ref::DOUBLE * n_prod / (n_ref::DOUBLE + n_prod)) + 0.12::DOUBLE
               + 0.11::DOUBLE / sqrt(n_ref::DOUBLE * n_prod / (n_ref::DOUBLE + n_prod))) * d AS lam
    FROM ks_d),
  ks AS (
    SELECT {by}feature, n_ref, n_prod, d,
           CASE WHEN n_ref = 0 OR n_prod = 0 THEN 'none' WHEN {KS_IS_EXACT} THEN 'exact' ELSE 'asymptotic' END AS method,
           CASE WHEN n_ref = 0 OR n_prod = 0 THEN 1.0::DOUBLE
                WHEN {KS_IS_EXACT} THEN {KS_PATHS}
                WHEN lam < 0.2 THEN 1.0::DOUBLE
                ELSE least(greatest(2.0::DOUBLE * list_sum(list_transform(range(1, 101),
                  lambda j: (CASE WHEN j % 2 = 1 THEN 1.0::DOUBLE ELSE (-1.0)::DOUBLE END)
                            * exp(-2.0::DOUBLE * j * j * lam * lam))), 0.0::DOUBLE), 1.0::DOUBLE)
           END AS p
    FROM (SELECT *, CAST(round(d * n_ref * n_prod) AS BIGINT) AS h FROM ks_l))"""


def moments_ctes(keys: Sequence[str] = ()) -> str:
    """mom(keys, feature, side moments) over ref_l and prod_l."""
    by = comma(keys)

    def side(name: str) -> str:
        return f"""(SELECT {by}feature, count(*) AS n, count(v) AS nf,
            coalesce(avg(v), 0.0::DOUBLE) AS mean, coalesce(stddev_pop(v), 0.0::DOUBLE) AS std,
            (count(*) - count(v)) / count(*)::DOUBLE AS miss FROM {name} GROUP BY {by}feature)"""

    on = " AND ".join(["a.feature = b.feature", *[f"a.{k} = b.{k}" for k in keys]])
    return f"""
  mom AS (
    SELECT {comma(keys, 'a.')}a.feature, a.mean AS ref_mean, b.mean AS prod_mean,
           a.std AS ref_std, b.std AS prod_std, b.miss - a.miss AS missing_rate_delta
    FROM {side('ref_l')} a JOIN {side('prod_l')} b ON {on})"""


def drift_table_ctes(reference: str, production: str, features: Sequence[str], keys: Sequence[str] = (), alert: float = 0.25) -> str:
    """drift: the whole per-feature table."""
    by = comma(keys)
    on = ", ".join([*keys, "feature"])
    return (
        psi_ctes(reference, production, features, keys)
        + ","
        + ks_ctes(keys)
        + ","
        + moments_ctes(keys)
        + f""",
  drift AS (
    SELECT {by}feature, psi.psi, ks.d AS ks_statistic, ks.p AS ks_pvalue, ks.method AS ks_method, ref_mean, prod_mean,
           ref_std, prod_std, missing_rate_delta, prof.cat AS is_categorical,
           psi.psi >= {alert} AS drifted
    FROM psi JOIN prof USING ({on}) JOIN ks USING ({on}) JOIN mom USING ({on}))"""
    )


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


def auc_sql(source: str, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> str:
    by = comma(keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
    SELECT {by}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
           coalesce(sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0), 0.0::DOUBLE) AS roc_auc
    FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
          FROM (SELECT {by}{score} AS score, count(*) FILTER (WHERE {label} = 1) AS pos,
                       count(*) FILTER (WHERE {label} <> 1) AS neg
                FROM ({source}) GROUP BY {by}{score}))
    {group}"""


def confusion_sql(source: str, threshold: str, keys: Sequence[str] = (), labelled: str = "true") -> str:
    by = comma(keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    given = f"label IS NOT NULL AND ({labelled})"
    known = f"{given} AND score IS NOT NULL"
    return f"""
    SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2.0::DOUBLE * tp + fp + fn, 0), 0.0::DOUBLE) AS f1 FROM (
      SELECT {by}count(*) AS n_samples, count(*) FILTER (WHERE {known}) AS n_labeled,
             count(*) FILTER (WHERE {given} AND score IS NULL) AS n_unscored,
             count(*) FILTER (WHERE {known} AND score >= {threshold} AND label = 1) AS tp,
             count(*) FILTER (WHERE {known} AND score >= {threshold} AND label <> 1) AS fp,
             count(*) FILTER (WHERE {known} AND score < {threshold} AND label = 1) AS fn,
             count(*) FILTER (WHERE {known} AND score < {threshold} AND label <> 1) AS tn
      FROM ({source}) {group})"""
