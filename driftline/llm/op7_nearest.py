"""Nearest neighbours by cosine, through collision counting on single projections.

Every vector is indexed. The index of a block of vectors is, for each of PROJECTIONS random
directions, the block's projections in sorted order. A query looks at a window around its own
projection in every array; a vector collides in a direction if it lies in that window. Windows
grow by virtual rehashing (radius times GROWTH, only the new ends are read) and the vectors that
collide in at least THRESHOLD of the directions are verified with the true cosine in double
precision. The search in a block ends when the k-th best found lies within the radius: a vector
at the edge of the radius collides in a direction with probability 0.68, so it stays below the
threshold one time in ten, and a nearer one hardly ever; measured recall is in the README. A radius over
the whole sphere verifies all that is left.

Equal vectors are one entry with its smallest k + 1 ids. Repeated rows (same id, same vector) are
made one by a map-side group-by, and then a map-side limited ranking finds the ids, so that a
vector which a third of the rows share costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import read_table
from driftline.session import materialise

PROJECTIONS = 96
THRESHOLD = 0.62
START = 0.4
GROWTH = 1.15
BLOCK = 32_768
QUERY_BLOCK = 4096
SEED = 7
NEIGHBOURS = 5
EVERY = 50


class Index:
    """Sorted projections of one block."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED) -> None:
        self.vectors = vectors.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.axes = np.random.Generator(np.random.Philox(seed)).standard_normal((vectors.shape[1], PROJECTIONS))
        places = (self.vectors / self.norms[:, None]) @ self.axes
        self.order = np.argsort(places, axis=0, kind="stable").T.astype(np.int32, order="C")
        self.sorted = np.take_along_axis(places.T, self.order, axis=1)

    def search(self, query: np.ndarray, wanted: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of verified vectors, among them the nearest `wanted` (an entry
        counts as many as it has ids)."""
        norm = np.sqrt(np.einsum("i,i->", query, query))
        center = (query / norm) @ self.axes
        n = len(self.norms)
        hits = np.zeros(n, np.int32)
        low = np.array([np.searchsorted(row, c) for row, c in zip(self.sorted, center, strict=True)])
        high = low.copy()
        open_ = np.ones(n, bool)
        positions, cosines = [np.zeros(0, np.int64)], [np.zeros(0)]
        radius = START
        while True:
            everything = radius >= 2
            if everything:
                new = np.flatnonzero(open_)
            else:
                parts = []
                for i, row in enumerate(self.sorted):
                    left = np.searchsorted(row, center[i] - radius)
                    right = np.searchsorted(row, center[i] + radius, side="right")
                    if left < low[i]:
                        parts.append(self.order[i, left : low[i]])
                        low[i] = left
                    if right > high[i]:
                        parts.append(self.order[i, high[i] : right])
                        high[i] = right
                if parts:
                    hits += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
                new = np.flatnonzero(open_ & (hits >= THRESHOLD * PROJECTIONS))
            if len(new):
                open_[new] = False
                positions.append(new)
                cosines.append(np.einsum("ij,j->i", self.vectors[new], query) / (self.norms[new] * norm))
            place, cosine = np.concatenate(positions), np.concatenate(cosines)
            # Distance r on the unit sphere is cosine 1 - r * r / 2.
            near = cosine >= 1 - radius * radius / 2
            if everything or weights[place[near]].sum() >= wanted:
                return place, cosine
            radius *= GROWTH


def best_of_block(entries: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id, score: the k nearest of a block's entries for each query."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if entries.num_rows and queries.num_rows:
        entries, queries = entries.combine_chunks(), queries.combine_chunks()
        width = len(entries.column("embedding")[0])
        vectors = entries.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        asked = queries.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        ids = entries.column("ids").to_pylist()
        counts = np.array([len(x) for x in ids])
        index = Index(vectors)
        for query, vector in zip(queries.column("query_id").to_pylist(), asked.astype(np.float64), strict=True):
            # One more than wanted, as one of the ids may be the query's own.
            places, cosines = index.search(vector, k + 1, counts)
            first = np.argsort(-cosines, kind="stable")
            found: dict[int, float] = {}
            last = None
            for at in first:
                if len(found) >= k and cosines[at] < last:
                    break
                for i in ids[places[at]]:
                    if i != query and i not in found:
                        found[i] = last = float(cosines[at])
            for i, score in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]:
                out["query_id"].append(query)
                out["vec_id"].append(i)
                out["score"].append(score)
    return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def usable(df: DataFrame, vector: str, key: str) -> DataFrame:
    """key and vector of the rows that take part: with an id, a norm above 0, and only finite numbers."""
    numbers = F.col(vector)
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(numbers, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & numbers.isNotNull() & finite & some).select(
        F.col(key).cast("long").alias("vec_id"), numbers.alias("embedding"), F.size(numbers).alias("width")
    )


def nearest(
    df: DataFrame,
    is_query,
    k: int = NEIGHBOURS,
    vector: str = "embedding",
    key: str = "vec_id",
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k entries found with the largest cosine.

    Ties go to the smaller id. Ids or vectors that are null, vectors of zeros and vectors with
    null or non-finite components take no part. Vectors are compared with those of their own
    length. Repeated rows count once; of an id with several vectors each is a candidate and
    found once, by the nearest, and the smallest (as an array) is the query. Fewer candidates
    than k give fewer rows; no candidates, or an empty table, give none. Other columns are ignored.
    """
    rows = materialise(usable(df, vector, key), "vectors")
    copies = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    few = (
        rows.withColumn("hash", F.xxhash64("embedding"))
        .groupBy("hash", "embedding", "width", "vec_id")  # repeated rows are one before places are given
        .agg(F.lit(1).alias("one"))
        .withColumn("place", F.row_number().over(copies))
        .where(F.col("place") <= k + 1)
        .groupBy("hash", "embedding", "width")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    entries = materialise(few, "entries")
    queries = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id", "width").agg(F.min("embedding").alias("embedding"))
    queries = materialise(queries.withColumnRenamed("vec_id", "query_id"), "queries")
    n_blocks = max(1, -(-entries.count() // block))
    n_chunks = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = entries.withColumn("block", F.pmod(F.col("hash"), F.lit(n_blocks)).cast("int")).select(
        "width", "block", every(n_chunks).alias("chunk"), "embedding", "ids"
    )
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n_chunks)).cast("int")).select(
        "width", every(n_blocks).alias("block"), "chunk", "query_id", "embedding"
    )
    keys = ("width", "block", "chunk")
    found = (
        dealt.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(lambda e, q: best_of_block(e, q, k), "query_id bigint, vec_id bigint, score double")
    )
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)


QUERIES = {"op7_nearest": op7_nearest}
ORACLES: dict[str, str] = {}
