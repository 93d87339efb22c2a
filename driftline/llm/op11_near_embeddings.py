"""Near-duplicate vectors inside a label, through collisions on one-dimensional projections.

1. Equal vectors of a label are one entry with its number of copies.
2. Meeting. Each of GROUPS keys of an entry hashes the cells of a few of its projections, so linked
   entries agree in a key with a probability that is known, and others hardly ever. How many
   projections a key takes, and how many keys there are, follows from the size of the largest label
   and from the recall (`plan_for`), so the work is not quadratic in a label. Keys with one entry go.
3. Collisions. Among the entries of a key, CHECKS further projections are sorted, each entry looks at
   a window around its own place in every one, and pairs that lie in each other's window `least`
   times or more are verified by their cosine. `least` is the count that a pair exactly at the
   threshold reaches with the wanted probability, from the binomial tail.
4. A pair counts only in the first key that its entries share. Tasks return a row for each entry, with
   the number of links and one entry it is connected with, and no pairs.

A key that very many entries share is cut into blocks by hash, and each pair of blocks is a unit of
work: whether a cluster of m different entries has m links for each takes looking at all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, read_table
from driftline.llm.graph import components
from driftline.session import materialise

THRESHOLD = 0.98
MISS = 1e-4  # the most that meeting, and again that counting, may miss of pairs at the threshold
CELL = 10.0  # width of a cell, in standard deviations of the difference of a pair at the threshold
WINDOW = 1.5  # half width of a window, in the same unit
CHECKS = 64
CHANCE = 0.02  # unlinked partners that an entry of a large label meets in a key
BLOCK = 2048
UNIT_ROWS = 16_384
SMALL = 48
SEED = 11


@dataclass(frozen=True)
class Plan:
    spread: float  # the distance of unit vectors at the threshold
    cells: int  # projections of a key
    groups: int  # keys of an entry
    least: int  # collisions of a pair that is verified


def same_cell(width: float) -> float:
    """Chance that a normal difference of deviation 1 stays in a randomly placed cell."""
    inside = math.erf(width / math.sqrt(2))
    return inside - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def plan_for(threshold: float, largest: int, miss: float = MISS) -> Plan:
    """Keys and counts for a label of `largest` entries."""
    spread = math.sqrt(2 - 2 * threshold)
    near, far = same_cell(CELL), same_cell(CELL * spread / math.sqrt(2))
    cells = max(1, math.ceil(math.log(max(2.0, largest / CHANCE)) / -math.log(far)))
    groups = math.ceil(math.log(miss) / math.log(1 - near**cells))
    hit = math.erf(WINDOW / math.sqrt(2))
    below, least = 0.0, 0
    while True:
        below += math.comb(CHECKS, least) * hit**least * (1 - hit) ** (CHECKS - least)
        if below > miss:
            return Plan(spread, cells, groups, least)
        least += 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def axes(width: int, number: int, seed: int) -> np.ndarray:
    """Random unit columns."""
    drawn = np.random.Generator(np.random.Philox(seed)).standard_normal((width, number))
    return drawn / np.linalg.norm(drawn, axis=0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # first, so that squares do not overflow
    scaled = vectors / largest
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def meeting_keys(vectors: np.ndarray, home: np.ndarray, plan: Plan) -> np.ndarray:
    """The keys of vectors of one width; home tells labels apart."""
    width = vectors.shape[1]
    number = plan.cells * plan.groups
    cell = CELL * plan.spread / math.sqrt(width)
    start = np.random.Generator(np.random.Philox(SEED + 1)).random(number)
    out = np.zeros((len(vectors), plan.groups), np.uint64)
    directions = axes(width, number, SEED)
    for g in range(plan.groups):
        at = slice(g * plan.cells, (g + 1) * plan.cells)
        places = np.floor(vectors @ directions[:, at] / cell + start[at]).astype(np.int64).astype(np.uint64)
        code = mixed(home + np.uint64((g + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(width))
        for column in places.T:
            code = mixed(code * np.uint64(31) + column)
        out[:, g] = code
    return out


class Unit:
    """Entries dealt to one task: vectors of one width, with projections made once."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, copies: np.ndarray, names: np.ndarray, plan: Plan, threshold: float) -> None:
        self.vectors, self.keys, self.copies, self.plan, self.threshold = vectors, keys, copies, plan, threshold
        self.places = unit_rows(vectors) @ axes(vectors.shape[1], CHECKS, SEED + 2)
        self.half = WINDOW * plan.spread / math.sqrt(vectors.shape[1])
        self.links = np.zeros(len(vectors), np.int64)
        _, self.same = np.unique(names, return_inverse=True)  # an entry may be here under several keys
        self.root = np.arange(self.same.max() + 1)

    def verify(self, x: np.ndarray, y: np.ndarray, key: int | np.ndarray) -> None:
        """Count the pairs that reach the threshold, if `key` is the first that they share."""
        agree = self.keys[x] == self.keys[y]
        first = self.keys[x, agree.argmax(axis=1)]
        mine = first == key
        x, y = x[mine], y[mine]
        a, b = self.vectors[x], self.vectors[y]
        lengths = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        near = np.einsum("ij,ij->i", a, b) / lengths >= self.threshold
        x, y = x[near], y[near]
        self.links += np.bincount(x, self.copies[y], len(self.links)).astype(np.int64)
        self.links += np.bincount(y, self.copies[x], len(self.links)).astype(np.int64)
        x, y = self.same[x], self.same[y]
        while True:
            p, q = self.root[x], self.root[y]
            if (p == q).all():
                return
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def few(self, x: np.ndarray, y: np.ndarray, key: np.ndarray) -> None:
        """Pairs from keys with few entries: their collisions are counted pair by pair."""
        for start in range(0, len(x), 1 << 14):
            p, q, k = (v[start : start + (1 << 14)] for v in (x, y, key))
            count = (np.abs(self.places[p] - self.places[q]) <= self.half).sum(axis=1)
            hit = count >= self.plan.least
            if hit.any():
                self.verify(p[hit], q[hit], k[hit])

    def many(self, left: np.ndarray, right: np.ndarray, same: bool, key: int) -> None:
        """Collisions of all of left with all of right, by windows in sorted projections."""
        order = np.argsort(self.places[right], axis=0, kind="stable")
        low, high = np.zeros((2, len(left), CHECKS), np.int64)
        for c in range(CHECKS):
            column = self.places[right[order[:, c]], c]
            low[:, c] = np.searchsorted(column, self.places[left, c] - self.half)
            high[:, c] = np.searchsorted(column, self.places[left, c] + self.half, side="right")
        found, pending = [], 0
        for at in range(len(left)):
            inside = np.concatenate([order[low[at, c] : high[at, c], c] for c in range(CHECKS)])
            hit = np.flatnonzero(np.bincount(inside, minlength=len(right)) >= self.plan.least)
            if same:
                hit = hit[hit > at]
            found.append((np.full(len(hit), left[at]), right[hit]))
            pending += len(hit)
            if pending > 1 << 14 or at == len(left) - 1:
                x, y = (np.concatenate(v) for v in zip(*found, strict=True))
                for start in range(0, len(x), 1 << 14):
                    self.verify(x[start : start + (1 << 14)], y[start : start + (1 << 14)], key)
                found, pending = [], 0


def linked(rows: pa.Table, plan: Plan, threshold: float) -> pa.Table:
    """rep, hub, n: links found for each entry of a unit, and the entry its component is named by."""
    out: list[list] = [[], [], []]
    rows = rows.combine_chunks()
    widths = rows.column("width").to_numpy()
    for width in np.unique(widths):
        part = rows.filter(pa.array(widths == width))
        part = part.sort_by([("k", "ascending"), ("i", "ascending"), ("j", "ascending")])
        flat = lambda name: part.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        names = part.column("rep").to_numpy()
        k, i, j, block = (part.column(c).to_numpy() for c in ("k", "i", "j", "block"))
        unit = Unit(
            flat("vector").reshape(-1, width).astype(np.float64), flat("keys").reshape(-1, plan.groups),
            part.column("copies").to_numpy().astype(np.float64), names, plan, threshold,
        )
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]]))
        x, y, key = [], [], []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            here = np.arange(low, high)
            one = i[low] == j[low]
            left, right = (here, here) if one else (here[block[here] == i[low]], here[block[here] == j[low]])
            if high - low > SMALL:
                if len(left) and len(right):
                    unit.many(left, right, one, k[low])
                continue
            p, q = np.meshgrid(left, right, indexing="ij")
            p, q = (p[p < q], q[p < q]) if one else (p.ravel(), q.ravel())
            x.append(p)
            y.append(q)
            key.append(np.full(len(p), k[low]))
        if x:
            unit.few(np.concatenate(x), np.concatenate(y), np.concatenate(key))
        hit = np.flatnonzero(unit.links)
        entries = np.zeros(len(unit.root), np.int64)
        entries[unit.same] = names
        out[0].append(names[hit])
        out[1].append(entries[unit.root[unit.same[hit]]])
        out[2].append(unit.links[hit])
    columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in out]
    return pa.table(dict(zip(("rep", "hub", "n"), columns, strict=True)))


def usable(numbers: Column) -> Column:
    """Not null, not zero, and only finite components."""
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(numbers, lambda x: x != 0), F.lit(False))


def keyed(entries: DataFrame, plan: Plan) -> DataFrame:
    """entries with their meeting keys."""

    def make():
        def run(rows):
            batch = []

            def done():
                widths = np.array([len(r[2]) for r in batch])
                for width in np.unique(widths):
                    at = [r for r in batch if len(r[2]) == width]
                    home = np.array([r[1] for r in at], np.int64).view(np.uint64)
                    keys = meeting_keys(unit_rows(np.array([r[2] for r in at], np.float64)), home, plan).view(np.int64)
                    for r, own in zip(at, keys, strict=True):
                        yield r[0], r[2], r[3], own

            for row in rows:
                batch.append(row)
                if len(batch) >= 1024:
                    yield from done()
                    batch = []
            if batch:
                yield from done()

        return run

    kind = entries.schema["vector"].dataType.simpleString()
    return map_rows(
        entries, ["rep", "home", "vector", "copies"], f"rep bigint, vector {kind}, copies bigint, keys array<bigint>", make,
        lambda row: 16 * len(row[1]) + 8 * len(row[3]),
    )


def near_vectors(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
    threshold: float = THRESHOLD, block: int = BLOCK, unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """key, n_links, component_id and kept, for each row.

    Two rows link when their labels are equal and not null, their vectors have one length and the
    cosine, in double precision, is at least `threshold`. Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do rows without a label; they are their own
    component. Each row is a vector: copies link with each other, repeated rows and ids too.
    component_id is the smallest key reachable by links; a null key names no component unless it has
    no other, and its rows are kept only then. Of pairs exactly at the threshold at most 2 * MISS are
    expected to be missed, of nearer ones fewer, and none below it is linked. Entries are named by
    64-bit hashes. Other columns are ignored; an empty table gives an empty result.
    """
    name = F.xxhash64(F.col(label), F.size(vector), F.col(vector))
    takes_part = F.col(label).isNotNull() & usable(F.col(vector))
    rows = df.select(F.col(key).alias("key"), F.when(takes_part, name).alias("rep"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    entries = materialise(
        rows.where("rep is not null").groupBy("rep").agg(
            F.xxhash64(F.first("label")).alias("home"), F.first("vector").alias("vector"),
            F.count("*").alias("copies"), F.min("key").alias("first_key"),
        ),
        "entries",
    )
    largest = entries.groupBy("home", F.size("vector")).count().agg(F.max("count")).first()[0] or 1
    plan = plan_for(threshold, largest)
    signed = materialise(keyed(entries, plan), "keys")
    meeting = signed.select("rep", F.explode("keys").alias("k"))
    shared = materialise(meeting.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "k"), F.col("blocks")).cast("int")
    dealt = (
        meeting.join(shared, "k")
        .withColumn("blocks", blocks)
        .withColumn("block", own)
        .select("k", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("k", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    dealt = materialise(dealt, "dealt")
    units = max(1, -(-dealt.count() // unit_rows))
    work = dealt.join(signed, "rep").select(
        F.pmod(F.xxhash64("k", "i", "j"), F.lit(units)).alias("unit"), "k", "i", "j", "block", "rep",
        F.size("vector").alias("width"), "vector", "copies", "keys",
    )
    found = materialise(
        work.groupBy("unit").applyInArrow(lambda t: linked(t, plan, threshold), "rep bigint, hub bigint, n bigint"), "found"
    )
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("rep"), "root")
    per_entry = materialise(
        entries.select("rep", "copies", "first_key").join(links, "rep", "left").join(roots, "rep", "left")
        .where("copies > 1 or root is not null or n is not null")
        .select("rep", "first_key", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "linked",
    )
    smallest = materialise(per_entry.groupBy("root").agg(F.min("first_key").alias("component")), "smallest")
    told = materialise(per_entry.join(smallest, "root").select("rep", "n_links", "component", F.lit(True).alias("known")), "told")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("key"))
    return (
        rows.select("key", "rep")
        .join(told, "rep", "left")
        .select(
            F.col("key").alias(key),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            component.alias("component_id"),
            F.col("key").eqNullSafe(component).alias("kept"),
        )
    )


def op11_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


# All pairs of a label, then components by reachability.
OP11_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
n AS (SELECT x, count(*) AS c FROM links GROUP BY x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.c, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN least r ON r.a = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""

QUERIES = {"op11_near_embeddings": op11_near_embeddings}
ORACLES = {"op11_near_embeddings": OP11_SQL}
