"""Documents whose sets of three-word shingles have a Jaccard similarity of at least 0.9.

1. Sets. A shingle is a 64-bit hash; a set is the sorted array of its hashes. Equal sets are one
   member, named by a 64-bit fingerprint, whatever the number of copies.
2. Meeting keys, without loss. Two sets of S shingles together that reach the threshold differ in
   at most S * (1 - t) / (1 + t) shingles. If the hash range is cut into more parts than that,
   the sets agree in a whole part. So a set sends a key for each part of its size class (and of
   the class below, as a partner may be smaller), the key being a hash of the part's content.
   Parts with very few shingles are left out where enough others remain, see `part_keys`. With
   `rare_keys`, parts hold the shingles that few sets have, so a passage that many unlike documents
   share connects none of them; only sets with too few such shingles send keys of all shingles.
3. Clusters. Members that share a key are connected; the components of that graph contain the
   components of the true links.
4. Signature trees. Every cluster is ordered by size and cut into blocks of bounded size. For each
   pair of blocks whose sizes can match, a tree is built over the members: its nodes hold the
   union of the members' token bitmaps, their common bits and the range of sizes. Both trees are
   walked at once; a pair of nodes goes if no pair of members can overlap enough, or if all of
   them are connected already. The pairs of members that remain are compared exactly.
5. Components of the links found, and the smallest document id of each.
6. Numbers of links. All links of a pair of blocks lie inside the components that step 4 found
   there. For each of these, trees are walked again without regard to connections. A node also
   holds how far its members are from the component's majority set, at most: if the distances of
   two nodes add up to no more than linked sets may differ by, all their pairs are linked and are
   counted at once. Pairs that are neither ruled out nor proven are compared exactly. No pair
   leaves a task; a task gives a count for each member, in documents, so copies count.

Results are exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm.common import fresh, read_table, schema_of, tidy
from driftline.llm.graph import components
from driftline.operators.ordered import lay_out, running_totals
from driftline.session import materialise

WORDS = 3
NUMERATOR, DENOMINATOR = 9, 10
THIN = 3
COMMON = 16
COMMON_WORDS = 1 << 21
COUNTED = 4 << 20
BLOCK_SHINGLES = 4 << 20
FAN_OUT = 8
BITMAP_BYTES = 64 << 20
FILTER_WORDS = 1 << 18
WORD_CACHE = 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of its values tell sets apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Text to the sorted hashes of its distinct word windows; A-Z count as a-z."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        # These six separators are the ones bytes.split() knows.
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        codes = np.array(hashes, np.uint64)
        width = min(self.width, len(codes))
        total = np.full(len(codes) - width + 1, width, np.uint64)
        for i in range(width):
            total = mixed(total * _GOLDEN + codes[i : len(codes) - width + 1 + i])
        return np.unique(total)


class SizeClasses:
    """Classes of set sizes such that linked sets are in the same class or in neighbours."""

    def __init__(self, numerator: int, denominator: int) -> None:
        self.p, self.q = numerator, denominator
        self.low = [1]

    def grow(self) -> None:
        self.low.append(self.low[-1] * self.q // self.p + 1)

    def class_of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.grow()
        return bisect_right(self.low, size) - 1

    def differences(self, number: int) -> int:
        """The most shingles by which a set of this class and a linked one, not smaller, differ."""
        while len(self.low) <= number + 1:
            self.grow()
        high = self.low[number + 1] - 1
        return (high + high * self.q // self.p) * (self.q - self.p) // (self.q + self.p)


@lru_cache(maxsize=512)
def part_edges(parts: int) -> np.ndarray:
    """The borders of equal parts of the hash range."""
    return np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)


def class_keys(hashes: np.ndarray, classes: SizeClasses, number: int, share: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the parts of a size class, which of them are thin, and the spare parts: one for each
    `share` of those needed. first tells kinds of keys apart."""
    differences = classes.differences(number)
    spare = -(-(differences + 1) // share)
    parts = differences + 1 + spare
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes), dtype=np.uint64)])
    cuts = np.concatenate([[0], np.searchsorted(hashes, part_edges(parts)), [len(hashes)]])
    thin = np.diff(cuts) < (THIN if classes.low[number] >= 6 * parts else 1)
    content = sums[cuts[1:]] - sums[cuts[:-1]]
    place = np.arange(parts, dtype=np.uint64) + np.uint64(first + (number << 40))
    return mixed(mixed(place + _GOLDEN) + content), thin, spare


def part_keys(hashes: np.ndarray, classes: SizeClasses, rare: np.ndarray | None = None) -> np.ndarray:
    """The meeting keys of a set.

    With d differences at most, d + 1 + spare parts have at least spare + 1 parts on which linked
    sets agree. A set with at most `spare` thin parts need not send these: a partner agrees with
    it in a part that is not thin for either. A set with more thin parts sends all its parts.

    rare: the shingles of the set that are not common, whatever counts as common, if it does so in
    all sets. The rare shingles of linked sets differ in no more than the sets do, so the same holds
    of their parts: all sets send those that are not thin, and two sets of which one has at most
    `spare` thin parts meet there. A set with more of them also sends the keys of all its shingles.
    """
    n, keys = len(hashes), []
    if not n:
        return np.zeros(0, np.uint64)
    own = classes.class_of(n)
    for number in (own, own - 1):
        if number < 0 or not classes.differences(number):
            continue  # sets this small are equal or not linked
        if rare is not None:
            key, thin, spare = class_keys(rare, classes, number, 6, 1 << 62)
            keys.append(key[~thin])
            if thin.sum() <= spare:
                continue
        key, thin, spare = class_keys(hashes, classes, number, 16, 0)
        keys.append(key[~thin] if thin.sum() <= spare else key)
    return np.concatenate([np.zeros(0, np.uint64), *keys])


def fingerprint(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def signatures(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """key, n (size of the set) and member (its fingerprint), for each row."""
    schema = schema_of(f"`{key}` {df.schema[key].dataType.simpleString()}, n bigint, member bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        shingle = Shingler(width)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                sets = [shingle(value or "") for value in part.column(1).to_pylist()]
                names = np.array([fingerprint(s) for s in sets], np.uint64)
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(names))]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.select(key, text).mapInArrow(tidy(run), schema)


def new_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Name and hashes of the sets of the texts in the first column, for up to 128 rows at a time, mostly
    without the copies among a task's rows."""
    shingle, seen = Shingler(width), set()
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            found = []
            for value in batch.slice(start, 128).column(0).to_pylist():
                hashes = shingle(value or "")
                name = fingerprint(hashes)
                if name in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(name)
                found.append((name, hashes))
            if found:
                yield found


def meetings(df: DataFrame, text: str, width: int, p: int, q: int, common: np.ndarray | None = None) -> DataFrame:
    """(member, k): the meeting keys of every set. A task sends the keys of copies once.

    They are made from the text when they are shuffled and kept nowhere, as they are as large
    as the text. common: common_shingles() of df, for keys of the others."""
    schema = schema_of("member bigint, k bigint")
    bits = None if common is None else df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        classes = SizeClasses(p, q)
        for found in new_sets(batches, width):
            keys = [part_keys(h, classes, None if bits is None else h[~is_common(h, bits.value)]) for _, h in found]
            members = [np.full(len(own), name, np.uint64) for own, (name, _) in zip(keys, found, strict=True)]
            columns = [pa.array(_signed(np.concatenate(c))) for c in (members, keys)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(text).mapInArrow(tidy(run), schema)


def is_common(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether common_shingles() has a bit for each shingle."""
    place = hashes >> np.uint64(37)
    return bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def common_shingles(df: DataFrame, text: str, width: int) -> np.ndarray:
    """A bit set over the first 27 bits of a hash, of a fixed 16 MB: those of shingles in more than COMMON sets.

    All shingles are counted, by 32 bits of their hashes. They are dealt by the first 10 of these, sorted, and
    the next 6 are given by the lengths of 64 runs, so that a shingle takes 2 bytes. Shingles that share a
    bit with a common one count as common; that decides which keys are sent, not what is found. From some
    10 ** 10 shingles on ever more of them do, and sets send the keys of all their shingles."""
    schema, words = schema_of("part int, packed binary"), schema_of("word bigint, bits bigint")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def flush(kept: list[np.ndarray]) -> pa.RecordBatch:
            values = np.sort(np.concatenate(kept))
            cuts = np.searchsorted(values, np.arange(1 << 16, dtype=np.uint32) << np.uint32(16))
            cuts = np.append(cuts, len(values)).astype(np.uint32)
            low = values.astype(np.uint16)  # the last 16 bits
            runs = np.diff(cuts).reshape(1 << 10, 64)
            edges = cuts[::64]
            packed = [runs[i].tobytes() + low[edges[i] : edges[i + 1]].tobytes() for i in range(1 << 10)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 10, dtype=np.int32)), pa.array(packed, pa.binary())], schema=arrow)

        kept, size = [], 0
        for found in new_sets(batches, width):
            kept += [(h >> np.uint64(32)).astype(np.uint32) for _, h in found]
            size += sum(len(h) for _, h in found)
            if size >= COUNTED:
                yield flush(kept)
                kept, size = [], 0
        if size:
            yield flush(kept)

    def count(rows: pa.Table) -> pa.Table:
        part, values = rows.column("part")[0].as_py(), []
        for packed in rows.column("packed"):
            raw = packed.as_buffer()
            runs = np.frombuffer(raw, np.uint32, 64)
            values.append(np.repeat(np.arange(64, dtype=np.uint32) << np.uint32(16), runs) + np.frombuffer(raw, np.uint16, offset=256))
        values, times = np.unique(np.concatenate(values), return_counts=True)
        # 32 bits also meet by chance: from 2 ** 32 shingles on the limit rises with their number.
        often = values[times > COMMON + 4 * (int(times.sum()) >> 22)]
        place = (np.uint64(part << 22) + often) >> np.uint64(5)
        word, starts = np.unique(place >> np.uint64(6), return_index=True)
        bit = np.uint64(1) << (place & np.uint64(63))
        bits = np.bitwise_or.reduceat(bit, starts) if len(bit) else bit
        return pa.table({"word": pa.array(_signed(word)), "bits": pa.array(_signed(bits))})

    table = df.select(text).mapInArrow(tidy(pack), schema).groupBy("part").applyInArrow(count, words).toArrow()
    out = np.zeros(COMMON_WORDS, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def key_filter(ids: DataFrame) -> np.ndarray:
    """A bit set over hashed ids, of a fixed 2 MB; a clear bit proves that an id is not there."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_WORDS * 64))
    bits = ids.select(
        F.floor(place / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_WORDS * 64}) % 64 as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = bits.toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


def filter_place(key: str) -> Column:
    """The bit of a key in key_filter(), -1 for a null key."""
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))).otherwise(-1)


def sets_of(df: DataFrame, ids: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(id, member, hashes) of the rows that `ids` may name; a superset, to be joined by id and member.

    The text of other rows is not looked at, and nothing of them is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(key_filter(ids))
    schema = schema_of(f"id {df.schema[key].dataType.simpleString()}, member bigint, hashes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        bits, shingle = shared.value, Shingler(width)
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = np.flatnonzero((at < 0) | (bits[at // 64] >> (at % 64) & 1 == 1))
            for start in range(0, len(hit), 128):
                part = batch.take(pa.array(hit[start : start + 128]))
                sets = [shingle(t or "") for t in part.column(2).to_pylist()]
                names = _signed(np.array([fingerprint(s) for s in sets], np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(names), pa.array([s.tobytes() for s in sets], pa.binary())], schema=arrow
                )

    return df.select(filter_place(key).alias("place"), key, text).mapInArrow(tidy(run), schema)


class Forest:
    """Union-find over member positions."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def flat(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


class SignatureTree:
    """Levels of nodes over members; level 0 is the members themselves."""

    def __init__(self, order: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray) -> None:
        bits, size, extra = bitmaps[order], sizes[order], sizes[order] - np.bitwise_count(bitmaps[order]).sum(1, dtype=np.int64)
        self.order = order
        self.levels = [(bits, bits, size, size, extra)]
        while len(size) > 1:
            starts = np.arange(0, len(size), FAN_OUT)
            union, common, low, high, extra = self.levels[-1]
            self.levels.append((
                np.bitwise_or.reduceat(union, starts),
                np.bitwise_and.reduceat(common, starts),
                np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts),
                np.maximum.reduceat(extra, starts),
            ))
            size = low[starts]

    def one_component(self, roots: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all members of a node are in, or -1."""
        low = high = roots[self.order]
        out = [low]
        for level in self.levels[1:]:
            starts = np.arange(0, len(low), FAN_OUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
            assert len(low) == len(level[2])
        return out


def can_match(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether nodes i of level a and j of level b may hold a linked pair."""
    (ua, ca, la, ha, ea), (ub, cb, lb, hb, eb) = ([x[k] for x in level] for level, k in ((a, i), (b, j)))
    count = lambda bits: np.bitwise_count(bits).sum(1, dtype=np.int64)
    least = -(-(la + lb) * p // (p + q))  # shingles that the smallest pair must share
    sizes = (ha * q >= lb * p) & (hb * q >= la * p)
    most = np.minimum(count(ua & ub) + np.minimum(ea, eb), np.minimum(ha - count(ca & ~ub), hb - count(cb & ~ua)))
    return sizes & (most >= least)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def bitmap_width(largest: int, members: int) -> int:
    """Bits of a bitmap: four for each shingle of the largest set, so that those of single
    members are sparse, but no more than BITMAP_BYTES allow for all members."""
    wanted = 1 << max(8, (4 * largest - 1).bit_length())
    allowed = 1 << max(8, (BITMAP_BYTES * 8 // members).bit_length() - 1)
    return min(wanted, allowed, 1 << 17)


def bitmaps_of(sets: list[np.ndarray], width: int) -> np.ndarray:
    bitmaps = np.zeros((len(sets), width // 64), np.uint64)
    for i, s in enumerate(sets):
        bit = mixed(s) & np.uint64(width - 1)
        np.bitwise_or.at(bitmaps[i], bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    return bitmaps


def children(a: SignatureTree, b: SignatureTree, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes one level below the pairs (i, j); of a tree with itself, those with i <= j."""
    nexts = []
    for t, node in ((a, i), (b, j)):
        if level >= len(t.levels):  # this tree is not as high: its node waits
            nexts.append(node[:, None])
        else:
            nexts.append(node[:, None] * FAN_OUT + np.arange(FAN_OUT))
    x = np.repeat(nexts[0], nexts[1].shape[1], axis=1).ravel()
    y = np.tile(nexts[1], (1, nexts[0].shape[1])).ravel()
    na, nb = (len(t.levels[min(level - 1, len(t.levels) - 1)][2]) for t in (a, b))
    inside = (x < na) & (y < nb)
    if a is b:
        inside &= x <= y
    return x[inside], y[inside]


class LocalSets:
    """Sets as numbers of the tokens that two of them have, for many exact intersections."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times > 1
        tokens, self.times = tokens[often], times[often]
        at = [np.searchsorted(tokens, s) for s in sets]
        ids = [a[(a < len(tokens)) & (tokens[np.minimum(a, len(tokens) - 1)] == s)] if len(tokens) else a[:0] for a, s in zip(at, sets, strict=True)]
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.concatenate(ids).astype(np.int32)
        self.marks = np.zeros(len(tokens), bool)

    def common(self, marked: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many of the marked tokens each of the other sets has."""
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[others] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        self.marks[marked] = True
        hits = np.concatenate([[0], np.cumsum(self.marks[self.ids[where]])])
        self.marks[marked] = False
        return hits[ends] - hits[ends - sizes]

    def of(self, x: int) -> np.ndarray:
        return self.ids[self.starts[x] : self.starts[x + 1]]


def count_links(
    left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, p: int, q: int
) -> np.ndarray:
    """For each position, the copies of all members on the other side that it is linked with.

    left and right are equal (pairs inside a list) or have nothing in common.
    """
    inside = left is right
    sizes = np.array([len(s) for s in sets], np.int64)
    counts = np.zeros(len(sets), np.int64)
    if len(left) * len(right) <= 64:
        for x in left:
            for y in right:
                if x < y or not inside:
                    both = shared(sets[x], sets[y])
                    if q * both >= p * (sizes[x] + sizes[y] - both):
                        counts[x] += copies[y]
                        counts[y] += copies[x]
        return counts
    local = LocalSets(sets)
    # Two sets are linked if they differ in at most (q - p) / (q + p) of their summed size, and
    # through any third set they differ by no more than both from that one.
    centre = np.flatnonzero(2 * local.times > len(sets))
    middle = np.zeros(len(sets), np.int64)
    step = max(1, (1 << 22) // max(1, int(sizes.max())))
    for start in range(0, len(sets), step):
        some = np.arange(start, min(start + step, len(sets)))
        middle[some] = local.common(centre, some)
    room = (q - p) * sizes - (q + p) * (sizes + len(centre) - 2 * middle)
    width = bitmap_width(int(sizes.max()), len(sets))
    most = min(8192, max(64, (BITMAP_BYTES // 8) // (width // 8)))
    bitmaps = bitmaps_of(sets, width)
    trees, rooms = [], []
    for side in (left,) if inside else (left, right):
        trees.append(SignatureTree(side[np.argsort(-room[side], kind="stable")], bitmaps, sizes))
        least = [room[trees[-1].order]]
        while len(least) < len(trees[-1].levels):
            least.append(np.minimum.reduceat(least[-1], np.arange(0, len(least[-1]), FAN_OUT)))
        rooms.append(least)
    a, b = trees[0], trees[-1]
    gained = [np.zeros(len(t.order) + 1, np.int64) for t in trees]  # steps, summed at the end
    own = np.zeros(len(a.order) + 1, np.int64)
    prior = [np.concatenate([[0], np.cumsum(copies[t.order])]) for t in trees]

    def span(t: SignatureTree, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = FAN_OUT ** min(level, len(t.levels) - 1)
        return node * wide, np.minimum((node + 1) * wide, len(t.order))

    stack = [(max(len(a.levels), len(b.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > most:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        la, lb = (min(level, len(t.levels) - 1) for t in (a, b))
        sure = rooms[0][la][i] + rooms[-1][lb][j] >= 0
        (al, ah), (bl, bh) = span(a, level, i[sure]), span(b, level, j[sure])
        total_a, total_b = prior[0][ah] - prior[0][al], prior[-1][bh] - prior[-1][bl]
        np.add.at(gained[0], al, total_b)
        np.add.at(gained[0], ah, -total_b)
        two = ~((i[sure] == j[sure]) & inside)  # a node with itself gives its pairs once
        np.add.at(gained[-1], bl[two], total_a[two])
        np.add.at(gained[-1], bh[two], -total_a[two])
        np.add.at(own, al[~two], 1)
        np.add.at(own, ah[~two], -1)
        i, j = i[~sure], j[~sure]
        keep = can_match(a.levels[la], i, b.levels[lb], j, p, q)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level:
            stack.append((level - 1, *children(a, b, level, i, j)))
            continue
        x, y = a.order[i], b.order[j]
        x, y = x[x != y], y[x != y]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        for start, end in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([np.flatnonzero(np.diff(x, prepend=-1)), [len(x)]])), strict=True):
            one = int(x[start])
            for low in range(start, end, step):
                others = y[low : min(end, low + step)]
                both = local.common(local.of(one), others)
                linked = others[q * both >= p * (sizes[one] + sizes[others] - both)]
                counts[one] += copies[linked].sum()
                counts[linked] += copies[one]
    counts[a.order] += np.cumsum(gained[0])[:-1] - (np.cumsum(own)[:-1] * copies[a.order] if inside else 0)
    if not inside:
        counts[b.order] += np.cumsum(gained[1])[:-1]
    return counts


def counts_by_component(
    left: list[int], right: list[int], links: list[tuple[int, int]], sets: list[np.ndarray], copies: np.ndarray, p: int, q: int
) -> np.ndarray:
    """count_links() of each component of `links`, which connect all that are linked."""
    counts = np.zeros(len(sets), np.int64)
    forest = Forest(len(sets))
    for x, y in links:
        rx, ry = forest.root(x), forest.root(y)
        forest.parent[max(rx, ry)] = min(rx, ry)
    roots, on_left = forest.flat(), np.zeros(len(sets), bool)
    on_left[left] = True
    touched = np.unique(np.array(links, np.int64).reshape(-1))
    touched = touched[np.argsort(roots[touched], kind="stable")]
    for group in np.split(touched, np.flatnonzero(np.diff(roots[touched])) + 1) if len(touched) else []:
        here = np.flatnonzero(on_left[group])
        there = here if left is right else np.flatnonzero(~on_left[group])
        counts[group] += count_links(here, there, [sets[k] for k in group], copies[group], p, q)
    return counts


def linked_pairs(left: list[int], right: list[int], sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links between positions of left and of right that connect all that are linked.

    left and right are the same list (links inside a block) or have nothing in common.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, links = Forest(len(sets)), []

    def test(x: int, y: int) -> None:
        rx, ry = forest.root(x), forest.root(y)
        if rx == ry or sizes[x] * q < sizes[y] * p or sizes[y] * q < sizes[x] * p:
            return
        both = shared(sets[x], sets[y])
        if q * both >= p * (sizes[x] + sizes[y] - both):
            forest.parent[max(rx, ry)] = min(rx, ry)
            links.append((x, y))

    if len(left) * len(right) <= 64:
        for x in left:
            for y in right:
                if x < y or left is not right:
                    test(x, y)
        return links
    width = bitmap_width(int(sizes.max()), len(sets))
    most = min(8192, max(64, (BITMAP_BYTES // 8) // (width // 8)))  # pairs of nodes looked at together
    bitmaps = bitmaps_of(sets, width)
    first = np.array([s[0] for s in sets])  # similar sets mostly have the same smallest hash
    trees = []
    for side in (left, right) if left is not right else (left,):
        side = np.array(side)
        trees.append(SignatureTree(side[np.lexsort((sizes[side], first[side]))], bitmaps, sizes))
    a, b = trees[0], trees[-1]
    if a is b:
        for x, y in zip(a.order, a.order[1:], strict=False):
            test(x, y)
    else:
        merged = np.concatenate([a.order, b.order])
        merged = merged[np.lexsort((sizes[merged], first[merged]))]
        sides = np.isin(merged, a.order)
        for x, y, sx, sy in zip(merged, merged[1:], sides, sides[1:], strict=False):
            if sx != sy:
                test(x, y)
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > most:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        la, lb = (min(level, len(t.levels) - 1) for t in (a, b))
        roots = forest.flat()
        ca, cb = a.one_component(roots)[la][i], b.one_component(roots)[lb][j]
        keep = ~((ca == cb) & (ca >= 0))
        keep &= can_match(a.levels[la], i, b.levels[lb], j, p, q)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            for x, y in zip(a.order[i], b.order[j], strict=True):
                if x != y:
                    test(x, y)
            continue
        stack.append((level - 1, *children(a, b, level, i, j)))
    return links


def block_links(members: DataFrame, p: int, q: int, counted: bool) -> DataFrame:
    """(a, b) links between the members of each group (cluster, i, j), blocks i and j of a cluster.

    If `counted`, also a row (a, null, n) for each member that is linked with n documents there."""
    schema = schema_of("a bigint, b bigint, n bigint")

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names, block = rows.column("member").to_numpy(), rows.column("block").to_numpy()
        order = np.argsort(names, kind="stable")
        order = order[np.concatenate([[True], names[order][1:] != names[order][:-1]])]  # copies of a set
        sets = [np.frombuffer(rows.column("hashes")[int(k)].as_buffer(), np.uint64) for k in order]
        names, block = names[order], block[order]
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left = [int(x) for x in np.flatnonzero(block == i)]
        right = left if i == j else [int(x) for x in np.flatnonzero(block == j)]
        links = linked_pairs(left, right, sets, p, q) if left and right else []
        found = pa.table({
            "a": pa.array([names[x] for x, _ in links], pa.int64()),
            "b": pa.array([names[y] for _, y in links], pa.int64()),
            "n": pa.nulls(len(links), pa.int64()),
        })
        if not counted or not links:
            return found
        counts = counts_by_component(left, right, links, sets, rows.column("copies").to_numpy()[order], p, q)
        some = np.flatnonzero(counts)
        numbers = {"a": pa.array(names[some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(counts[some])}
        return pa.concat_tables([found, pa.table(numbers)])

    return members.groupBy("cluster", "i", "j").applyInArrow(verify, schema)


def component_table(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    width: int = WORDS,
    p: int = NUMERATOR,
    q: int = DENOMINATOR,
    block_shingles: int = BLOCK_SHINGLES,
    count_links: bool = True,
    rare_keys: bool = False,
) -> DataFrame:
    """key, n_shingles, component_id, the smallest key reachable by links, and n_links, for each row.

    n_links is the number of other rows that the row is linked with directly, copies among them; it
    is left out without `count_links`. `rare_keys` is for texts that share passages without being
    alike: one more pass over the text, with the same result.

    Two rows link when q * intersection >= p * union of their sets. Null or empty text, and text
    without words, has an empty set, links with nothing and is its own component. With fewer
    words than `width` the whole sequence is the one shingle. Repeated rows have equal sets and
    so share a component. A null key is passed on; it never names a component unless no row of
    the component has a key. Other columns are ignored; an empty table gives an empty result.
    """
    signed = materialise(signatures(df, text, key, width), "signatures")
    # Every set is connected with the smallest one at its key. Keys are shuffled once and pass by in
    # order; a key that one set has alone leaves nothing.
    smallest = F.min("member").over(Window.partitionBy("k"))
    common = common_shingles(df, text, width) if rare_keys else None
    meeting = meetings(df, text, width, p, q, common).withColumn("a", smallest)
    edges = meeting.where("member <> a").select("a", F.col("member").alias("b"))
    clusters = materialise(
        components(edges).select(F.col("node").alias("member"), F.col("root").alias("cluster")), "clusters"
    )
    named = signed.groupBy("member").agg(F.min(key).alias("id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    candidates = materialise(clusters.join(named, "member"), "candidates")
    runs = lay_out(candidates, ["cluster"], ["n", "member"], ["n"])
    placed = running_totals(runs).withColumn("block", F.floor(F.col("n_prior") / block_shingles)).select(
        "member", F.col("id").alias("first_id"), "cluster", "n", "block", "copies"
    )
    placed = materialise(placed, "placed")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("cluster", F.col("block").alias("j"), F.col("low").alias("low_j"))
    pairs = (
        blocks.withColumnRenamed("block", "i")
        .join(other, "cluster")
        .where((F.col("i") <= F.col("j")) & (F.col("high") * q >= F.col("low_j") * p))
        .select("cluster", "i", "j")
    )
    tasks = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sets = sets_of(df, candidates.select("id").where("id is not null"), text, key, width)
    # One row stands for all copies of a set: the one with the smallest key.
    # Members meet their tasks first, so that the sets are dealt out once by member and once by task.
    homes = placed.join(tasks, ["cluster", "block"])
    members = sets.join(homes, "member").where(F.col("id").eqNullSafe(F.col("first_id")))
    members = members.select("cluster", "i", "j", "block", "member", "hashes", "copies")
    links = materialise(block_links(members, p, q, count_links), "links")
    roots = components(links.where("b is not null")).select(F.col("node").alias("member"), "root")
    per_member = named.join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
    smallest = per_member.groupBy("root").agg(F.min("id").alias("component_id"))
    beyond = links.where("b is null").groupBy(F.col("a").alias("member")).agg(F.sum("n").alias("beyond"))
    n_links = F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))
    of_member = materialise(
        per_member.join(smallest, "root").join(beyond, "member", "left").select("member", "component_id", n_links.alias("n_links")),
        "components",
    )
    return (
        signed
        .join(of_member, "member", "left")
        .select(
            key,
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
            *([F.when(F.col("n") == 0, 0).otherwise(F.col("n_links")).alias("n_links")] if count_links else []),
        )
    )


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """df with one row of each component, the one with the smallest key.

    The rows of a repeated key stay or go together: they go if none of them is the smallest of
    its component, else the first by text stays. Rows without a key stay.
    """
    found = component_table(df, text, key, count_links=False, **options).where(F.col(key).isNotNull())
    by_key = materialise(
        found.groupBy(key).agg(F.max(F.col(key) == F.col("component_id")).alias("stays"), F.count("*").alias("n")), "stays"
    )
    # Most rows stay. Only those whose key may go or may be repeated are dealt out by key.
    in_doubt = by_key.where("not stays or n > 1").select(key)
    bits = df.sparkSession.sparkContext.broadcast(key_filter(in_doubt.withColumnRenamed(key, "id")))
    sure, doubtful = may_hold(df, key, bits, False), may_hold(df, key, bits, True)
    once = doubtful.join(in_doubt, key, "left_anti").select(*df.columns)
    again = doubtful.join(by_key.where("stays and n > 1").select(key), key, "left_semi").select(*df.columns)
    number = F.row_number().over(Window.partitionBy(key).orderBy(text))
    (row,) = fresh(df, "_row")
    first = again.withColumn(row, number).where(F.col(row) == 1).select(*df.columns)
    return sure.unionByName(once).unionByName(first)


def may_hold(df: DataFrame, key: str, bits: Broadcast, wanted: bool) -> DataFrame:
    """The rows of df whose key the filter may hold, or those that it does not hold."""
    schema = df.schema
    (name,) = fresh(df, "_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = (at >= 0) & (bits.value[at // 64] >> (at % 64) & 1 == 1)
            kept = batch.select(range(batch.num_columns - 1)).filter(pa.array(hit == wanted))
            for start in range(0, kept.num_rows, 256):
                yield kept.slice(start, 256)

    return df.select(*df.columns, filter_place(key).alias(name)).mapInArrow(tidy(run), schema)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(read_table(spark, sf_dir, "documents"))


# Sets as definitions, pairs by their common shingles, components by reachability.
OP10_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
           WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}),
                lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, CASE WHEN l.x = r.b THEN l.y ELSE l.x END FROM reach r JOIN links l ON r.b IN (l.x, l.y))
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id,
  (SELECT count(*) FROM links l WHERE d.doc_id = l.x) + (SELECT count(*) FROM links l WHERE d.doc_id = l.y) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY ALL
"""

QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES = {"op10_jaccard_join": OP10_SQL}
