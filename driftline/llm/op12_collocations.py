"""Phrases whose words come together more often than chance, for each language, from exact counts.

1. Every task counts the words of its shard, and hashes of its word pairs. Pairs are summed by hash
   range; those that reach the least count set bits in a filter of fixed size. A clear bit proves that
   a pair is rare, and so is every phrase that holds it.
2. Every task sorts the windows of its shard that have no rare pair and builds a count transducer from
   them: a minimal acyclic automaton over words, built incrementally, whose arc weights are the counts of
   the phrases that end there. It leaves the task in slices, one for each prefix range.
3. Prefix ranges have about equal weight by the counts of first words; a word that outweighs a range is
   cut further by second words. The slices of a range from all shards are united and weights added;
   arcs below the least count, which nothing above can need, are left out then.
4. The phrases of the united transducers are the candidates. Each part of a candidate is looked up by
   composing it with the transducer of its own head, its first two words: a join by head, then a walk
   along the arcs.

All counts are exact. The filter only saves work: pairs that it lets through by mistake are counted
like others and do not reach the least count.
"""

from __future__ import annotations

import marshal
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, read_table
from driftline.operators.ordered import lay_out, running_totals
from driftline.session import materialise

LEAST = 100
LONGEST = 5
TOP = 2000
SHARD_WORDS = 2 << 20
CHUNK = 1 << 20
FILTER_BITS = 1 << 25
# Products of counts pass 64 bits; decimals hold them exactly.
SCORE = (
    "cast(1000 * (cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)"
)
_BORDER = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_GAP = re.compile(rb"[.,;:!?\x09-\x0D\x20]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

State = tuple  # of arcs (word, weight, state), by word


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Words to numbers in order of appearance; the border of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Shard:
    """The words of one language, as numbers, with 0 between pieces."""

    def __init__(self) -> None:
        self.numbers = Numbers({b".": 0})
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> int:
        data, start, before = text.encode().lower(), 0, len(self.parts)
        while start < len(data):
            # A very long text is taken in chunks that end between words; windows reach across them.
            end = len(data)
            if end - start > CHUNK:
                gap = _GAP.search(data, start + CHUNK)
                end = gap.start() if gap else end
            words = _BORDER.sub(b" . ", data[start:end]).split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            start = end
        self.parts.append(np.zeros(1, np.int32))
        return sum(map(len, self.parts[before:]))

    def sequence(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def words(self) -> list[str]:
        return [w.decode() for w in self.numbers]


def pair_hashes(shard: Shard, lang: str, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place but the last: whether a pair of words of one piece starts there, and its hash."""
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in shard.numbers], np.uint64)
    inside = (sequence[:-1] > 0) & (sequence[1:] > 0)
    hashes = np.zeros(len(inside), np.uint64)
    first, second = known[sequence[:-1][inside]], known[sequence[1:][inside]]
    hashes[inside] = mixed(mixed(first * _GOLDEN + np.uint64(xxhash.xxh3_64_intdigest(lang))) + second)
    return inside, hashes


def over_shards(rows: Iterator[tuple], done) -> Iterator[tuple]:
    """Rows (lang, text) to what done(lang, shard) makes of every shard of bounded size."""
    shards: dict[str, Shard] = {}
    held = 0
    for lang, text in rows:
        if lang not in shards:
            shards[lang] = Shard()
        held += shards[lang].add(text)
        if held >= SHARD_WORDS:
            for name in list(shards):
                yield from done(name, shards.pop(name))
            held = 0
    for name in list(shards):
        yield from done(name, shards.pop(name))


def count_words_and_pairs(docs: DataFrame, ranges: int, least: int) -> DataFrame:
    """Rows (lang, word, n) of words, and rows (range, pairs) of hashed pairs with their counts."""

    def done(lang: str, shard: Shard) -> Iterator[tuple]:
        sequence = shard.sequence()
        counts = np.bincount(sequence, minlength=len(shard.numbers))
        for word, n in zip(shard.words()[1:], counts[1:].tolist(), strict=True):
            yield lang, word, n, None, None
        inside, hashes = pair_hashes(shard, lang, sequence)
        hashes = hashes[inside]
        codes = (hashes % np.uint64(ranges)) << np.uint64(32) | hashes >> np.uint64(32)
        codes, n = np.unique(codes, return_counts=True)
        n = np.minimum(n, least).astype(np.uint32)  # more than the least count is enough to know
        place = (codes >> np.uint64(32)).astype(np.int64)
        keys = (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(place, np.arange(ranges + 1))
        for at in np.flatnonzero(np.diff(edges)):
            low, high = edges[at], edges[at + 1]
            yield None, None, None, int(at), keys[low:high].tobytes() + n[low:high].tobytes()

    return map_rows(
        docs, ["lang", "text"], "lang string, word string, n bigint, range int, pairs binary",
        lambda: lambda rows: over_shards(rows, done), lambda row: 96 if row[4] is None else 64 + len(row[4]),
    )


def filter_places(ranges: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) * _GOLDEN + ranges.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def pair_filter(pairs: DataFrame, least: int) -> np.ndarray:
    """A bit set, of a fixed 4 MB, over the hashed pairs that reach the least count together."""

    def total(rows: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for blob in rows.column("pairs"):
            both = np.frombuffer(blob.as_buffer(), np.uint32)
            keys.append(both[: len(both) // 2])
            counts.append(both[len(both) // 2 :])
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts))
        often = keys[sums >= least]
        places = filter_places(np.full(len(often), rows.column("range")[0].as_py()), often)
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        np.bitwise_or.at(bits, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        word = np.flatnonzero(bits)
        return pa.table({"word": pa.array(word, pa.int64()), "bits": pa.array(bits[word].view(np.int64))})

    summed = pairs.groupBy("range").applyInArrow(total, "word bigint, bits bigint")
    table = summed.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


class Builder:
    """A minimal count transducer from phrases that come in ascending order.

    Only the states of the last phrase are open. When a phrase leaves a state, the state is final: it is
    replaced by an equal one that is known, or becomes known itself."""

    def __init__(self) -> None:
        self.known: dict[tuple, State] = {}
        self.open: list[list] = [[]]  # arcs of the open states; the last arc of each leads to the next
        self.path: list[tuple[str, list[int]]] = []

    def close(self, arcs: list) -> State:
        state = tuple(arcs)
        return self.known.setdefault(tuple((w, n, id(s)) for w, n, s in state), state)

    def shorten(self, depth: int) -> None:
        while len(self.path) > depth:
            word, weight = self.path.pop()
            state = self.close(self.open.pop())
            self.open[-1].append((word, weight[0], state))

    def add(self, words: list[str], count: int) -> None:
        common = 0
        while common < len(words) and common < len(self.path) and self.path[common][0] == words[common]:
            common += 1
        self.shorten(common)
        for _, weight in self.path:
            weight[0] += count
        for word in words[common:]:
            self.path.append((word, [count]))
            self.open.append([])

    def finish(self) -> State:
        self.shorten(0)
        return self.close(self.open[0])


def shard_transducer(shard: Shard, sequence: np.ndarray, open_: np.ndarray, longest: int) -> State:
    """The transducer of all windows of up to `longest` words whose pairs are all open."""
    starts = np.flatnonzero(open_)
    if not len(starts):
        return ()
    used, code = np.unique(sequence, return_inverse=True)
    words = shard.words()
    text = [words[i] for i in used]
    by_text = sorted(range(len(text)), key=lambda i: text[i] if used[i] else "")
    rank = np.zeros(len(text), np.int32)
    rank[by_text] = np.arange(len(text))
    ranks = np.concatenate([rank[code], np.zeros(longest, np.int32)])
    go_on = np.concatenate([open_, np.zeros(longest, bool)])
    columns, alive = [ranks[starts]], np.ones(len(starts), bool)
    for k in range(1, longest):
        alive = alive & go_on[starts + k - 1]
        columns.append(np.where(alive, ranks[starts + k], -1))
    order = np.lexsort(columns[::-1])
    table = np.stack([c[order] for c in columns], axis=1)
    new = np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(table)]]))
    in_order = [text[i] for i in by_text]
    build = Builder()
    for start in range(0, len(at), 1 << 15):
        some = at[start : start + (1 << 15)]
        for row, count in zip(table[some].tolist(), counts[start : start + (1 << 15)].tolist(), strict=True):
            build.add([in_order[i] for i in row if i >= 0], count)
    return build.finish()


class Parts:
    """The prefix ranges: which slice of a transducer a phrase belongs to, by its first two words.

    `starts` are the first words of the ranges, in order of (lang, word). A word that alone outweighs a
    range is cut further by its second words: `heavy` has its number of slices. Both lists are as
    long as the number of ranges at most."""

    def __init__(self, starts: list[tuple[str, str]], heavy: dict[tuple[str, str], int]) -> None:
        self.starts, self.heavy = starts, heavy

    def of(self, lang: str, first: str) -> tuple[str, int]:
        """The range of a first word, and the number of slices by second words."""
        slices = self.heavy.get((lang, first), 1)
        at = str(bisect_right(self.starts, (lang, first)))
        return (f"{at}:{xxhash.xxh3_64_intdigest(first)}" if slices > 1 else at), slices


def prefix_parts(words: DataFrame, number: int, least: int) -> Parts:
    """About `number` ranges of equal weight over the frequent words of all languages together."""
    frequent = words.where(F.col("f") >= least).select(F.lit(0).alias("all"), "lang", "word", "f")
    runs = lay_out(frequent, ["all"], ["lang", "word"], ["f"])
    weight = runs.totals.agg(F.sum("f_run")).first()[0]
    if weight is None:
        return Parts([], {})
    target = -(-weight // number)
    placed = materialise(running_totals(runs).select("lang", "word", "f", F.floor(F.col("f_prior") / target).alias("range")), "ranges")
    starts = placed.groupBy("range").agg(F.min(F.struct("lang", "word")).alias("at")).select("at.lang", "at.word").collect()
    heavy = placed.where(F.col("f") > target).collect()
    return Parts(sorted((r.lang, r.word) for r in starts), {(r.lang, r.word): -(-r.f // target) for r in heavy})


def shard_slices(docs: DataFrame, bits, parts, ranges: int, longest: int) -> DataFrame:
    """(part, slice): the transducers of all shards, cut at the prefix ranges. A slice begins with
    the language."""

    def make():
        def done(lang: str, shard: Shard) -> Iterator[tuple]:
            sequence = shard.sequence()
            inside, hashes = pair_hashes(shard, lang, sequence)
            places = filter_places(hashes % np.uint64(ranges), hashes >> np.uint64(32))
            open_ = inside & (bits.value[places >> 6] >> (places & 63) & 1 == 1)
            held: dict[str, list] = {}
            for first, n, state in shard_transducer(shard, sequence, open_, longest):
                part, slices = parts.value.of(lang, first)
                if slices == 1:
                    held.setdefault(part, []).append((first, n, state))
                    continue
                cut: dict[int, list] = {}
                for arc in state:
                    cut.setdefault(xxhash.xxh3_64_intdigest(arc[0]) % slices, []).append(arc)
                for k, arcs in cut.items():
                    held.setdefault(f"{part}:{k}", []).append((first, sum(n for _, n, _ in arcs), tuple(arcs)))
            for part, arcs in held.items():
                yield part, marshal.dumps((lang, arcs))

        return lambda rows: over_shards(rows, done)

    return map_rows(docs, ["lang", "text"], "part string, slice binary", make, lambda row: 64 + len(row[1]))


def add_state(total: dict, state: State) -> None:
    """Unite a transducer into nested totals, word -> [weight, totals]."""
    for word, n, below in state:
        entry = total.get(word)
        if entry is None:
            entry = total[word] = [0, {}]
        entry[0] += n
        if below:
            add_state(entry[1], below)


def pruned(total: dict, least: int) -> State:
    return tuple((w, total[w][0], pruned(total[w][1], least)) for w in sorted(total) if total[w][0] >= least)


def united_heads(slices: DataFrame, least: int) -> DataFrame:
    """(lang, head, n, tail) with the weights of all shards; a task unites one prefix range after another."""

    def make():
        def done(total: dict) -> Iterator[tuple]:
            for lang in total:
                for first, (_, seconds) in total[lang].items():
                    for second, (n, below) in seconds.items():
                        if n >= least:
                            yield lang, f"{first} {second}", n, marshal.dumps(pruned(below, least))

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            name, total = None, {}
            for part, blob in rows:
                if part != name:
                    yield from done(total)
                    name, total = part, {}
                lang, arcs = marshal.loads(blob)
                add_state(total.setdefault(lang, {}), arcs)
            yield from done(total)

        return run

    return map_rows(
        slices.repartition("part").sortWithinPartitions("part"), ["part", "slice"],
        "lang string, head string, n bigint, tail binary", make, lambda row: 64 + len(row[1]) + len(row[3]),
    )


def phrases_of(prefix: str, state: State) -> Iterator[tuple[str, int]]:
    for word, n, below in state:
        phrase = f"{prefix} {word}"
        yield phrase, n
        yield from phrases_of(phrase, below)


def candidate_parts(heads: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, side, head, rest): both parts of every cut of every candidate."""

    def make():
        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for lang, head, n, tail in rows:
                for phrase, a in [(head, n), *phrases_of(head, marshal.loads(tail))]:
                    words = phrase.split(" ")
                    for k in range(1, len(words)):
                        for side, part in ((0, words[:k]), (1, words[k:])):
                            yield lang, phrase, a, k, side, " ".join(part[:2]), " ".join(part[2:])

        return run

    return map_rows(
        heads, ["lang", "head", "n", "tail"], "lang string, phrase string, a bigint, k int, side int, head string, rest string", make,
        lambda row: 64 + 2 * len(row[1]),
    )


def composed(asked: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, side, f): each part's weight, found by walking its head's transducer."""

    def make():
        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for lang, phrase, a, k, side, rest, n, tail in rows:
                state, f = marshal.loads(tail) if rest else (), n
                for word in rest.split(" ") if rest else ():
                    f, state = next((weight, below) for label, weight, below in state if label == word)
                yield lang, phrase, a, k, side, f

        return run

    return map_rows(
        asked, ["lang", "phrase", "a", "k", "side", "rest", "n", "tail"],
        "lang string, phrase string, a bigint, k int, side int, f bigint", make, lambda row: 64 + len(row[1]),
    )


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    share: tuple[int, int] = (100, 100),
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best `top` phrases of every language.

    A-Z count as a-z. Texts are cut into pieces at `.,;:!?` and line ends, pieces into words at blanks
    and tabs; a phrase never spans pieces. n is the number of words, a, l and r are occurrences of the
    phrase, of the first k words and of the rest, for the cut with the lowest floor(1000 * a * n /
    (l * r)), of several the smallest k. Candidates have 2 to `longest` words and a >= least; one is
    dropped if a longer candidate holds it and share[0] * f(longer) >= share[1] * a. Looking one word
    further is enough for that, because counts do not grow with length. Null text is empty, null lang
    is `und`. Repeated rows count each. Very long texts are taken in chunks
    without losing windows. Equal scores are ranked by a, then by phrase. A table without candidates
    gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = materialise(count_words_and_pairs(docs, ranges, least), "counts")
    words = materialise(counted.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    size = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    bits = spark.sparkContext.broadcast(pair_filter(counted.where("range is not null").select("range", "pairs"), least))
    parts = spark.sparkContext.broadcast(prefix_parts(words, ranges, least))
    heads = materialise(united_heads(shard_slices(docs, bits, parts, ranges, longest), least), "united")
    singles = words.where(F.col("f") >= least).select("lang", F.col("word").alias("head"), F.col("f").alias("n"), F.lit(marshal.dumps(())).alias("tail"))
    asked = candidate_parts(heads).join(heads.unionByName(singles), ["lang", "head"])
    found = materialise(composed(asked), "parts")
    cuts = found.groupBy("lang", "phrase", "k").agg(
        F.first("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(size, "lang")
        .withColumn("score", F.expr(SCORE))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
        .select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    )
    p, q = share
    # The candidates one word shorter, if they are never seen apart from the longer one.
    pieces = F.split("phrase", " ")
    count = F.size(pieces)
    shorter = F.when((F.col("side") == 0) & (F.col("k") == count - 1), F.array_join(F.slice(pieces, 1, count - 1), " ")).when(
        (F.col("side") == 1) & (F.col("k") == 1), F.array_join(F.slice(pieces, 2, count - 1), " ")
    )
    held = found.where((count > 2) & (wide("a") * p >= wide("f") * q)).select("lang", shorter.alias("phrase")).where("phrase is not null")
    left = scored.join(held.distinct(), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


# All phrases by position, counted; cuts by their words.
OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM lists GROUP BY lang),
phrases AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p
  FROM lists, range(1, {LONGEST + 1}) AS s(m) WHERE len(w) >= m),
f AS (SELECT lang, p, CAST(count(*) AS HUGEINT) AS c FROM phrases GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT * FROM f WHERE len(p) >= 2),
cuts AS (
  SELECT c.lang, c.p, k, c.c AS a, x.c AS l, y.c AS r, t.n, 1000 * c.c * t.n // (x.c * y.c) AS score
  FROM candidates c JOIN range(1, {LONGEST}) AS s(k) ON k < len(c.p)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (
  SELECT DISTINCT b.lang, b.p[i:i + m - 1] AS p, b.c FROM candidates b, range(2, {LONGEST}) AS s(m), range(1, {LONGEST}) AS o(i)
  WHERE m < len(b.p) AND i + m - 1 <= len(b.p)),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.p = b.p AND 100 * h.c >= 100 * b.a)),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked QUALIFY rank <= {TOP}
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": OP12_SQL}
