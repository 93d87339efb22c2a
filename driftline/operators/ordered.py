"""Global order statistics without a global sort in one task.

A frame of pre-aggregated, distinct (keys, order) rows is range-partitioned and written
once. Each partition, a *run*, then holds one contiguous stretch of every key it touches,
so a running total is the total of the earlier runs plus a running total inside the run.
The totals per run are a small table: at most (number of runs + number of keys) rows.
A key that holds most of the data is spread over many runs, because the order column is
part of the range key. Rows whose key is NULL belong to no group and take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialise

RUN = "_run"


@dataclass(frozen=True)
class Runs:
    """Range-partitioned rows and, for each (keys, run), the totals of that run and before it.

    `totals` has per weight w the columns w_run (inside the run) and w_before.
    """

    rows: DataFrame
    totals: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    weights: tuple[str, ...]


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Sequence[str]) -> Runs:
    """Range-partition distinct (keys, order) rows, ascending with nulls first, and write them.

    No partition count is given: the cluster's shuffle.partitions is the upper bound and AQE
    merges neighbouring small ranges, which keeps every run contiguous.
    """
    keys, order, weights = tuple(keys), tuple(order), tuple(weights)
    rows = materialise(
        df.repartitionByRange(*keys, *order).withColumn(RUN, F.spark_partition_id()), "runs"
    )
    per_run = rows.groupBy(*keys, RUN).agg(*[F.sum(w).alias(f"{w}_run") for w in weights])
    earlier = (
        Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = per_run.select(
        "*",
        *[
            F.coalesce(F.sum(f"{w}_run").over(earlier), F.lit(0)).alias(f"{w}_before")
            for w in weights
        ],
    )
    # Written too: every reader of the runs needs the totals, more than once, and making them
    # scans all rows. Their file size is then known when joins are planned.
    return Runs(rows, materialise(totals, "totals"), keys, order, weights)


def running_totals(runs: Runs, only: DataFrame | None = None) -> DataFrame:
    """Rows with w_upto (running total including the row) and w_prior for every weight.

    `only` is a subset of `runs.totals`, possibly with more columns, which are kept; just
    its runs are read and sorted.
    """
    by_run = [*runs.keys, RUN]
    rows, totals = runs.rows, runs.totals
    if only is not None:
        rows, totals = rows.join(only.select(*by_run), by_run, "left_semi"), only
    inside = (
        Window.partitionBy(*by_run)
        .orderBy(*runs.order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The totals are joined after the window, so that the shuffle and the sort carry only the
    # rows; the join uses the partitioning the window has already made.
    inner = rows.withColumns({f"_{w}_in": F.sum(w).over(inside) for w in runs.weights})
    upto = inner.join(totals, by_run).withColumns(
        {f"{w}_upto": F.col(f"{w}_before") + F.col(f"_{w}_in") for w in runs.weights}
    )
    return upto.withColumns(
        {f"{w}_prior": F.col(f"{w}_upto") - F.col(w) for w in runs.weights}
    ).drop(*[f"_{w}_in" for w in runs.weights])


def rows_at_ranks(runs: Runs, weight: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """The distinct row that covers each wanted 0-based rank of a key.

    `ranks` maps the key's total weight to an array of ranks (a handful). Only the runs that
    contain a wanted rank are sorted. Returns keys, rank, the order columns and `total`.
    """
    keys = list(runs.keys)
    key_total = Window.partitionBy(*keys)
    wanted = runs.totals.withColumn("total", F.sum(f"{weight}_run").over(key_total)).withColumn(
        "_ranks", ranks(F.col("total"))
    )
    before, size = F.col(f"{weight}_before"), F.col(f"{weight}_run")
    hit = wanted.filter(
        F.exists("_ranks", lambda r: (before <= r) & (r < before + size))
    )
    counted = running_totals(runs, hit)
    prior, upto = F.col(f"{weight}_prior"), F.col(f"{weight}_upto")
    return counted.select(
        *keys,
        *runs.order,
        "total",
        F.explode(F.filter("_ranks", lambda r: (prior <= r) & (r < upto))).alias("rank"),
    )


def neighbours(df: DataFrame, keys: Sequence[str], order: str, probe: str) -> DataFrame:
    """For each row the nearest answer before it (`previous`) and at or after it (`following`).

    Rows with the boolean `probe` only ask; the others are the answers, with distinct order
    values inside a key, and an answer never names itself. One range layout serves both
    directions, and the nearest answers of the other runs come from the totals per run.
    """
    keys = list(keys)
    tagged = df.withColumn("_answer", F.when(F.col(probe), 0).otherwise(1))
    rows = materialise(
        tagged.repartitionByRange(*keys, order, "_answer").withColumn(RUN, F.spark_partition_id()),
        "neighbours",
    )
    answer = F.when(F.col("_answer") == 1, F.col(order))
    per_run = rows.groupBy(*keys, RUN).agg(
        F.max(answer).alias("_run_max"), F.min(answer).alias("_run_min")
    )
    sofar = (Window.unboundedPreceding, -1)
    by_run = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(*sofar)
    from_end = Window.partitionBy(*keys).orderBy(F.desc(RUN)).rowsBetween(*sofar)
    totals = per_run.select(
        *keys,
        RUN,
        F.max("_run_max").over(by_run).alias("_before"),
        F.min("_run_min").over(from_end).alias("_after"),
    )
    # On equal order values a probe comes before the answer, so the answer follows it.
    upward = Window.partitionBy(*keys, RUN).orderBy(order, "_answer")
    downward = Window.partitionBy(*keys, RUN).orderBy(F.desc(order), F.desc("_answer"))
    earlier = F.max(answer).over(upward.rowsBetween(*sofar))
    later = F.min(answer).over(downward.rowsBetween(*sofar))
    return (
        rows.join(totals, [*keys, RUN])
        .withColumn("previous", F.coalesce(earlier, F.col("_before")))
        .withColumn("following", F.coalesce(later, F.col("_after")))
        .drop(RUN, "_before", "_after", "_answer")
    )
