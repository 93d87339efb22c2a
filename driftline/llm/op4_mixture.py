"""Mixing sources to target weights by balanced sampling (the cube method).

Targets: sources share a total by weight, no source above a multiple of its size, the rest
reshared. A document is taken floor(target / source size) times, and once more with the remaining
fraction as its probability. These fractions move to 0 or 1 along directions that keep both
the number of documents and the number of words: three documents at a time have such a
direction, and each step settles at least one of them. That flight runs in blocks of a source, so
no task sees more than a block; the at most two documents that a block leaves open are dealt to
new blocks, until the rest of a source fits one block. Only there the last two are rounded, in the
way that is nearest to the words wanted, and documents of that block are exchanged one for one as
long as that brings the words nearer.

Rows that agree in key, source and size are settled together as one unit, so a result does not
depend on the order of rows, and a key that a third of the rows share is one unit.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import fresh, read_table, word_count
from driftline.operators.ordered import lay_out, running_totals
from driftline.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
SEED = 20_011
NEAR = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size and target. Weights repeat over the sources by code point, null last.

    The table of sources stays distributed; the driver sees one row of sums in each round of
    resharing, of which there are no more than there are sources.
    """
    known = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = known.select("*", F.col("source").isNull().alias("last"), F.lit(1).alias("one"))
    place = (F.col("one_prior") % len(weights)).cast("int")
    ranked = materialise(
        running_totals(lay_out(ordered, [], ["last", "source"], ["one"])).select(
            "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place + 1).alias("weight")
        ),
        "weights",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    level, n_full = 0.0, -1
    while True:
        # The sources that the level of the last round would lift above their cap get the cap. They
        # stay at it, as the level only rises, so their number tells when nothing changes.
        full = (cap <= F.col("weight") * level) if n_full >= 0 else F.lit(False)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n_full"),
        ).first()
        if not row["weight"] or row["n_full"] == n_full:
            break
        n_full = row["n_full"]
        level = (share * total - row["given"]) / row["weight"]
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def flight(sizes: Sequence[float], chances: list[float], random) -> list[float]:
    """Chances moved to 0 or 1, all but at most two, keeping their sum and that of chance x size."""
    chances = list(chances)
    active: list[int] = []
    for new in range(len(chances)):
        if chances[new] <= NEAR or chances[new] >= 1 - NEAR:
            chances[new] = round(chances[new])
            continue
        active.append(new)
        while len(active) == 3:
            i, j, k = active
            way = (sizes[k] - sizes[j], sizes[i] - sizes[k], sizes[j] - sizes[i])
            if way[0] == way[1] == 0:
                way = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for at, step in zip(active, way, strict=True):
                p = chances[at]
                if step > 0:
                    up, down = min(up, (1 - p) / step), min(down, p / step)
                elif step < 0:
                    up, down = min(up, -p / step), min(down, (p - 1) / step)
            move = up if random() * (up + down) < down else -down
            rest = []
            for at, step in zip(active, way, strict=True):
                p = chances[at] + move * step
                if p <= NEAR or p >= 1 - NEAR:
                    chances[at] = 0.0 if p < 0.5 else 1.0
                else:
                    chances[at] = p
                    rest.append(at)
            active = rest
    return chances


def landing(sizes: Sequence[float], chances: list[float]) -> list[float]:
    """The open chances (two at most) rounded so that the words are nearest to those wanted."""
    chances = list(chances)
    left = [i for i, p in enumerate(chances) if 0 < p < 1]
    best = None
    for choice in range(1 << len(left)):
        taken = [choice >> n & 1 for n in range(len(left))]
        words = abs(sum((t - chances[i]) * sizes[i] for t, i in zip(taken, left, strict=True)))
        count = abs(sum(t - chances[i] for t, i in zip(taken, left, strict=True)))
        best = min(filter(None, (best, (words, count, taken))))
    for i, t in zip(left, best[2], strict=True):
        chances[i] = float(t)
    return chances


def exchange(sizes: Sequence[float], chosen: list[float], chances: Sequence[float]) -> list[float]:
    """chosen after exchanges of one document for another that bring its words nearer to those
    wanted, so that rounding the last two does not show in a small source. The count stays."""
    size, taken = np.array(sizes), np.array(chosen, bool)
    error = float(size[taken].sum() - np.dot(size, chances))
    for _ in range(len(sizes)):
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        if not len(inside) or not len(outside):
            break
        outside = outside[np.argsort(size[outside], kind="stable")]
        at = np.searchsorted(size[outside], size[inside] - error)
        best = (abs(error), -1, -1)
        for shift in (-1, 0):
            other = outside[np.clip(at + shift, 0, len(outside) - 1)]
            left = np.abs(error - size[inside] + size[other])
            first = int(np.argmin(left))
            best = min(best, (float(left[first]), int(inside[first]), int(other[first])))
        if best[0] >= abs(error) - NEAR:
            break
        error += size[best[2]] - size[best[1]]
        taken[best[1]], taken[best[2]] = False, True
    return taken.astype(float).tolist()


def settle(units: DataFrame, block_size: int, seed: int) -> DataFrame:
    """units (key, source, size, words, chance) with every chance 0 or 1."""
    schema = units.schema
    fields = [f.name for f in schema]
    settled, rounds = None, 0
    while True:
        # Written, so that its real size is known and units are not dealt out by source.
        counts = materialise(units.groupBy("source").agg(F.ceil(F.count("*") / block_size).alias("_blocks")), "blocks")
        dealt = (
            units.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_order", F.xxhash64(F.lit(seed + rounds), "key", "size"))
            .withColumn("_block", F.pmod(F.col("_order"), F.col("_blocks")))
            .select(*fields, "_order", "_block", "_blocks")
        )

        stage = rounds

        def move(key: tuple, rows: pa.Table) -> pa.Table:
            source, block = (k.as_py() for k in key)
            rows = rows.sort_by([("_order", "ascending"), ("key", "ascending"), ("size", "ascending")])
            words = rows.column("words").to_pylist()
            draw = np.random.Generator(
                np.random.Philox([seed, stage, zlib.crc32(repr(source).encode()), block])
            ).random
            chances = flight(words, rows.column("chance").to_pylist(), draw)
            if rows.column("_blocks")[0].as_py() == 1:
                chances = exchange(words, landing(words, chances), rows.column("chance").to_pylist())
            at = rows.schema.get_field_index("chance")
            return rows.set_column(at, "chance", pa.array(chances, pa.float64())).select(fields)

        moved = materialise(dealt.groupBy("source", "_block").applyInArrow(move, schema), "flight")
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        done = moved.where(~is_open)
        settled = done if settled is None else settled.unionByName(done)
        units = moved.where(is_open)
        rounds += 1
        if units.isEmpty():
            return settled


def mix(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    block_size: int = BLOCK,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(rows, units). rows: one per row of df with key, source, size, source_size, target, copies
    and taken = copies x size. units: distinct (key, source, size) with copies, to join with.

    Null text has size 0 and is taken 0 times, as any text without words. A null source is a
    source, a null key a key. Repeated rows get the same copies. Other columns are ignored. An
    empty table gives empty results. `most` bounds the copies of every document.
    """
    sizes = materialise(
        df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes"
    )
    wanted = materialise(targets(sizes, weights, share, most), "targets")
    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sizes.groupBy("key", "source", "size")
        .agg((F.count("*") * F.col("size")).cast("double").alias("words"))
        .join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_times", F.when(F.col("size") > 0, per_row).otherwise(0.0))
        .withColumn("whole", F.floor("_times"))
        .withColumn("chance", F.col("_times") - F.col("whole"))
        .drop("_times")
    )
    units = materialise(units, "units")
    is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
    columns = ("key", "source", "size", "words", "chance", "whole", "source_size", "target")
    settled = settle(units.where(is_open).select(*columns), block_size, seed)
    decided = materialise(
        units.where(~is_open).select(*columns).unionByName(settled).select(
            "key", "source", "size", "source_size", "target", (F.col("whole") + F.col("chance")).cast("long").alias("copies")
        ),
        "decided",
    )
    other = decided.select(
        F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_n"), "source_size", "target", "copies"
    )
    same = (
        F.col("key").eqNullSafe(F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
    )
    rows = sizes.join(other, same).select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
    return rows, decided


def repeat_rows(df: DataFrame, decided: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """df with every row as often as the mix takes it, and none that it does not take."""
    names = df.columns
    k, s, n, copies, copy = fresh(df, "_k", "_s", "_n", "_copies", "_copy")
    other = decided.where("copies > 0").select(
        F.col("key").alias(k), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").cast("int").alias(copies)
    )
    same = F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (word_count(F.col(text)) == F.col(n))
    # Every row needs its decision, so the texts are dealt out once, at any size.
    taken = df.join(other.hint("merge"), same).select(*names, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
    return taken.select(*names)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixture": op4_mixture}
ORACLES: dict[str, str] = {}
