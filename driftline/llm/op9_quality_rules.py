"""Quality rules: counts of words, symbols and repeats, and a perplexity band for each language.

The language model predicts the text as it stands, character by character, in two steps that are
multiplied: the shape of the next character, and which character of that shape it is. Only runs of
blanks are one space. Every language (null counts as one) has models of its own.

Shapes: a modified Kneser-Ney model over four symbols out of 32 (a to z without accents, space, digit,
sentence mark, quote or bracket, other mark, mark of `#*$%&|<>`), so at most 32 ** 4 entries for each
language. Spark counts the sequences and in how many documents they occur; one that only one document
has is not part of the model, else a document would be the evidence for its own odd sequences.
Continuation counts and back-off weights follow from the others, the discounts of the highest order
from all.

Characters: a modified Kneser-Ney model over the last five characters unfolded (case, accents, every
script, digit and mark), with contexts of the four before and the shape. It has no most size: counts,
continuation counts, discounts and back-off weights of its five orders are group-bys and joins in
Spark (sequence_scores). A sequence that only one text has, however many copies there are of it, is
not part of it. Characters of a shape that were never seen share what is left equally. Both steps are
stored together, as the log probability of each five-character sequence of the documents under a
64-bit key, in files of sorted ranges of keys on the shared folder. Neither the driver nor a task holds
that table: a task sorts the keys of some documents and passes the ranges by them, with binary search.

A document that passes the base rules is rejected if its mean log perplexity, or that of its shapes
alone, lies outside its language's band of it: BAND_WIDTH robust deviations (1.4826 times the median distance from the median) on
each side of the median of all documents of that language that pass the base rules. A deviation
counts as at least LEAST_DEVIATION times the median, so that much the same texts are all kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftline.llm.common import fresh, map_rows, read_table, schema_of, tidy
from driftline.session import materialise, scratch_path

# Characters of the longest sequence of the model, and the symbols of the model of shapes below it.
REACH = 5
ORDER = 4
BITS = 5
MODELS = 16
# REACH digits to this base fit in 63 bits.
RADIX = 6208
POINTS = 0x110000
BAND_WIDTH = 5.0
LEAST_DEVIATION = 0.01
LEAST_WORDS = 50
MOST_REPEATED = 50
BUFFER_SYMBOLS = 1 << 20
# Characters that a task scores together.
LOOKED_UP = 1 << 22
# Log probabilities of a sequence that was never counted: any character, any symbol.
UNKNOWN = -np.log2(POINTS), -float(BITS)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
SPACE, DIGIT, STOP, BRACKET, OTHER, SYMBOL = range(26, 32)


def _symbol(code: int) -> int:
    char = chr(code)
    if char in SYMBOLS:
        return SYMBOL
    base = unicodedata.normalize("NFKD", char)[:1].lower()
    kind = unicodedata.category(char)
    if char.isspace() or kind in ("Cc", "Cf"):
        return SPACE
    if kind[0] in "LM":
        return ord(base) - 97 if "a" <= base <= "z" else code % 26
    if kind[0] == "N":
        return DIGIT
    if kind in ("Ps", "Pe", "Pi", "Pf") or char in "\"'`":
        return BRACKET
    return STOP if char in ".,;:!?" else OTHER


def unfolded(text: str) -> np.ndarray:
    """The code points of a text, each run of blanks as one space."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (points == 32) | (points - np.uint32(9) < 5)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.where(blank, np.uint32(32), points)[keep]


class SymbolTable:
    """Text to symbols. Code points from 0x3000 are taken as letters. `members` has the number of code
    points of each symbol."""

    def __init__(self) -> None:
        self.table = np.array([_symbol(c) for c in range(0x3000)], np.uint8)
        far = np.bincount(np.arange(len(self.table), POINTS) % 26, minlength=32)
        self.members = np.bincount(self.table, minlength=32) + far

    def fold(self, points: np.ndarray) -> np.ndarray:
        """The symbols of code points."""
        symbols = self.table[np.minimum(points, len(self.table) - 1)]
        far = points >= len(self.table)
        if far.any():
            symbols[far] = points[far] % 26
        return symbols

    def codes(self, text: str) -> np.ndarray:
        """The 20-bit codes of all four-symbol sequences of unfolded(), the text led in by spaces."""
        symbols = self.fold(unfolded(text))
        whole = np.concatenate([np.full(ORDER - 1, SPACE, np.uint32), symbols.astype(np.uint32)])
        n = len(symbols)
        code = np.zeros(n, np.uint32)
        for i in range(ORDER):
            code = code << np.uint32(BITS) | whole[i : i + n]
        return code


def model_of(lang: str | None) -> int:
    """A number for a language if the languages of the rows are not known; fit() does not use it."""
    return zlib.crc32((lang or "").encode()) % MODELS


def languages(df: DataFrame, lang: str = "lang") -> dict[str | None, int]:
    """A number of its own for each language of df."""
    found = [r[0] for r in df.select(lang).distinct().collect()]
    return {x: i for i, x in enumerate(sorted(found, key=lambda x: (x is not None, x or "")))}


def gram_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", number: Callable[[str | None], int] = model_of
) -> DataFrame:
    """(gram, n, docs) over all rows: the number of a model and four symbols, how often it occurs, and
    in how many rows.

    Every task counts buffers of BUFFER_SYMBOLS symbols before anything is shuffled, so neither
    a large source nor a much repeated text sends more than its distinct sequences.
    """

    def make():
        table = SymbolTable()

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            kept, size = [], 0

            def flush() -> Iterator[tuple]:
                grams, counts = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
                order = np.argsort(grams)
                grams, counts = grams[order], counts[order]
                starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                docs = np.diff(np.append(starts, len(grams)))
                yield from zip(grams[starts].tolist(), np.add.reduceat(counts, starts).tolist(), docs.tolist(), strict=True)

            for language, value in rows:
                if not value:
                    continue
                kept.append(np.unique(table.codes(value).astype(np.int64) | number(language) << ORDER * BITS, return_counts=True))
                size += len(kept[-1][0])
                if size >= BUFFER_SYMBOLS:
                    yield from flush()
                    kept, size = [], 0
            if kept:
                yield from flush()

        return step

    partial = map_rows(df, [lang, text], "gram bigint, n bigint, docs bigint", make)
    return partial.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequencies(counts: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, 3 and 4."""
    return np.bincount(counts[counts < 5], minlength=5)[1:].tolist()


def discounts(of: Sequence[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from frequencies(); those that these do not give
    are 0.5, 1, 1.5."""
    n = [0, *of]
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            if n[k]:
                out[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), k)
    return out


class KneserNey:
    """The model of shapes: interpolated modified Kneser-Ney estimates as sorted key arrays, one for each order."""

    def __init__(
        self, grams: np.ndarray, counts: np.ndarray, top: dict[int, Sequence[int]], numbers: dict[str | None, int] | None = None
    ) -> None:
        """grams and counts: the sequences of the models; top: for each model the frequencies of the
        counts of all sequences, also of those that are not part of it; numbers: its language's."""
        self.numbers = numbers or {}
        order = np.argsort(grams)
        keys, counts = grams[order].astype(np.int64), counts[order].astype(np.int64)
        levels = {ORDER: (keys, counts)}
        for size in range(ORDER - 1, 0, -1):
            # How many different symbols come before a sequence, instead of how often it occurs.
            keys, counts = np.unique(self.suffix(levels[size + 1][0], size + 1), return_counts=True)
            levels[size] = keys, counts
        self.keys: dict[int, np.ndarray] = {}
        self.log_p: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.log_back: dict[int, np.ndarray] = {}
        for size in range(1, ORDER + 1):
            keys, counts = levels[size]
            contexts, place = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(place, counts)
            less = np.zeros(len(keys))
            models, starts = np.unique(keys >> size * BITS, return_index=True)
            for model, a, b in zip(models, starts, [*starts[1:], len(keys)], strict=False):
                fixed = discounts(top[int(model)] if size == ORDER else frequencies(counts[a:b]))
                less[a:b] = fixed[np.minimum(counts[a:b], 3)]
            back = np.maximum(np.bincount(place, less) / total, 1e-9)
            if size == 1:
                lower = np.full(len(keys), 1 / 2**BITS)
            else:
                lower = np.exp2(self.log_p[size - 1][np.searchsorted(self.keys[size - 1], self.suffix(keys, size))])
            p = (counts - less) / total[place] + back[place] * lower
            self.keys[size] = keys
            self.log_p[size] = np.log2(p).astype(np.float32)
            self.contexts[size] = contexts
            self.log_back[size] = np.log2(back).astype(np.float32)

    @staticmethod
    def suffix(keys: np.ndarray, size: int) -> np.ndarray:
        """The keys without the first of `size` symbols; the model number stays in front."""
        low = (size - 1) * BITS
        return (keys >> size * BITS) << low | keys & (1 << low) - 1

    def score(self, keys: np.ndarray, size: int = ORDER) -> np.ndarray:
        """log2 of the probability of each sequence's last symbol after those before it."""
        if not len(self.keys[ORDER]):
            return np.full(len(keys), -float(BITS))
        out = np.empty(len(keys))
        at = np.minimum(np.searchsorted(self.keys[size], keys), len(self.keys[size]) - 1)
        known = self.keys[size][at] == keys
        out[known] = self.log_p[size][at[known]]
        rest = keys[~known]
        if len(rest):
            lower = self.score(self.suffix(rest, size), size - 1) if size > 1 else np.full(len(rest), -float(BITS))
            context = rest >> np.uint32(BITS)
            at = np.minimum(np.searchsorted(self.contexts[size], context), len(self.contexts[size]) - 1)
            seen = self.contexts[size][at] == context
            out[~known] = lower + np.where(seen, self.log_back[size][at], 0.0)
        return out


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> KneserNey:
    """The models of shapes of all rows. What reaches the driver is bounded by 32 ** 4 counts of 16 bytes
    and four numbers for each language, whatever the number of rows."""
    numbers = languages(df, lang)
    counted = materialise(gram_counts(df, text, lang, numbers.__getitem__), "grams")
    some = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]
    top = {r[0]: r[1:] for r in counted.groupBy(F.floor(F.col("gram") / (1 << ORDER * BITS)).alias("m")).agg(*some).collect()}
    known = counted.where("docs > 1").select("gram", "n").toArrow()
    return KneserNey(known.column("gram").to_numpy(), known.column("n").to_numpy(), top, numbers)


def label_of(lang: str | None) -> str:
    return "" if lang is None else "=" + lang


def windows(texts: list[np.ndarray], lead: int = 32) -> list[np.ndarray]:
    """The first, second, ... members of the sequences that end at each character of each text; a text
    is led in by `lead`."""
    first = np.full(REACH - 1, lead, texts[0].dtype)
    whole = np.concatenate([part for text in texts for part in (first, text)])
    last = np.ones(len(whole), bool)
    starts = np.cumsum([0, *(len(t) + REACH - 1 for t in texts[:-1])])
    last[(starts[:, None] + np.arange(REACH - 1)).ravel()] = False
    at = np.flatnonzero(last) - (REACH - 1)
    return [whole[at + i] for i in range(REACH)]


def salt_of(label: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(label.encode(), digest_size=8).digest(), np.uint64)[0]


def keys_of(members: Sequence[np.ndarray], salt: np.uint64 | np.ndarray) -> np.ndarray:
    """64-bit keys of sequences, given by their first, second, ... code points, in a language."""
    key = np.zeros(len(members[0]), np.uint64) + salt
    for points in members:
        key ^= points
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


class Packer:
    """Sequences as numbers that give their characters back: digits in the order of first meeting."""

    def __init__(self) -> None:
        self.digit = np.full(POINTS, -1, np.int16)
        self.points = np.array([32], np.uint32)
        self.digit[32] = 0

    def pack(self, texts: list[np.ndarray]) -> np.ndarray | None:
        """Null if there are no digits left for new characters."""
        for points in texts:
            digits = self.digit[points]
            if (digits < 0).any():
                new = np.unique(points[digits < 0])
                if len(self.points) + len(new) > RADIX:
                    return None
                self.digit[new] = np.arange(len(self.points), len(self.points) + len(new))
                self.points = np.concatenate([self.points, new])
        first, *rest = windows(texts)
        packed = self.digit[first].astype(np.int64)
        for points in rest:
            packed = packed * RADIX + self.digit[points]
        return packed

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        out = np.empty((len(packed), REACH), np.uint32)
        for i in reversed(range(REACH)):
            packed, digits = np.divmod(packed, RADIX)
            out[:, i] = self.points[digits]
        return out


def as_strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    flat = np.ascontiguousarray(points, "<u4").ravel()
    width = 1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)[REACH - 1 :: REACH]]).astype(np.int32)
    data = flat.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(ends), pa.py_buffer(data))


def as_points(strings: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(strings.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, REACH)


def distinct(packed: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers without repeats, how often they occur, and the least and the largest `own` of each."""
    coded = pa.array(packed).dictionary_encode()
    place, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    low, high = np.full(len(found), own.max()), np.zeros(len(found), np.int64)
    np.minimum.at(low, place, own)
    np.maximum.at(high, place, own)
    return found, np.bincount(place, minlength=len(found)), low, high


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted numbers without repeats; of the columns beside them the sum, the least and the largest."""
    packed, n, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(packed)
    packed = packed[order]
    starts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    return (
        packed[starts],
        np.add.reduceat(n[order], starts),
        np.minimum.reduceat(low[order], starts),
        np.maximum.reduceat(high[order], starts),
    )


COUNTED = "label string, symbol tinyint, gram string, n bigint, low bigint, high bigint"


def sequence_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(label, symbol, gram, n, low, high) over all rows: a language, REACH characters and the symbol of
    the last, how often they occur, and the least and the largest crc32 of the texts that have them,
    which differ if these do. A task sends each of its sequences once, or once in BUFFER_SYMBOLS
    different ones."""
    schema = schema_of(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        # Texts and their crc32 by label; sequences of the texts before by label.
        waiting: dict[str, list[tuple[np.ndarray, int]]] = {}
        kept: dict[str, tuple[np.ndarray, ...]] = {}
        packer, table, size = Packer(), SymbolTable(), 0

        def batches_of(label: str, points: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(points), 1 << 16):
                part = slice(i, i + (1 << 16))
                grams, symbols = as_strings(points[part]), table.fold(points[part, -1])
                columns = [pa.repeat(label, len(grams)), pa.array(symbols), grams, *(pa.array(c[part]) for c in counts)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            for label, (packed, *counts) in kept.items():
                yield from batches_of(label, packer.unpack(packed), *counts)
            kept.clear()

        def count(label: str, texts: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal packer
            packed = packer.pack([t for t, _ in texts])
            if packed is None:
                yield from flush()
                packer = Packer()
                if len(texts) > 1:
                    for i in (0, 1):
                        yield from count(label, texts[i::2])
                    return
                packed = packer.pack([texts[0][0]])
            own = np.repeat(np.array([c for _, c in texts], np.int64), [len(t) for t, _ in texts])
            if packed is None:
                found, n = np.unique(np.stack(windows([texts[0][0]]), 1), axis=0, return_counts=True)
                yield from batches_of(label, found, n, *[own[: len(n)]] * 2)
                return
            before = [kept[label]] if label in kept else []
            kept[label] = merged([*before, distinct(packed, own)])

        for batch in batches:
            for language, value in zip(*batch.columns, strict=True):
                value, label = value.as_py(), label_of(language.as_py())
                if not value:
                    continue
                waiting.setdefault(label, []).append((unfolded(value), zlib.crc32(value.encode())))
                size += len(value)
                if size >= BUFFER_SYMBOLS:
                    while waiting:
                        yield from count(*waiting.popitem())
                    size = 0
                    if sum(len(x[0]) for x in kept.values()) >= BUFFER_SYMBOLS:
                        yield from flush()
        while waiting:
            yield from count(*waiting.popitem())
        yield from flush()

    partial = df.select(F.col(lang).alias("label"), F.col(text).alias("gram")).mapInArrow(tidy(run), schema)
    return partial.groupBy("label", "symbol", "gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def discounts_by_label(counts: DataFrame) -> DataFrame:
    """(label, less1, less2, less3): discounts() of the column c of each label."""
    of = counts.groupBy("label").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)])
    usable = (F.col("n1") > 0) & (F.col("n2") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def less(k: int) -> Column:
        own = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when(usable & (F.col(f"n{k}") > 0), F.least(F.greatest(own, F.lit(0.0)), F.lit(float(k)))).otherwise(0.5 * k)

    return of.select("label", *[less(k).alias(f"less{k}") for k in (1, 2, 3)])


def sequence_scores(counted: DataFrame) -> DataFrame:
    """(label, gram, p, rest) of every sequence of sequence_counts(): the probability of its last
    character among those of the same symbol, after the others; characters that were never seen would
    add `rest` to it, all together. c is the count of a sequence, 0 if it is not part of the model."""
    level = counted.select("label", "symbol", "gram", F.when(F.col("low") < F.col("high"), F.col("n")).otherwise(0).alias("c"))
    fixed = discounts_by_label(counted.select("label", F.col("n").alias("c")))
    orders = []
    for size in range(REACH, 0, -1):
        c = F.col("c")
        less = F.when(c == 0, 0.0).when(c == 1, F.col("less1")).when(c == 2, F.col("less2")).otherwise(F.col("less3"))
        # A context has at most as many continuations as there are characters of the symbol.
        context = Window.partitionBy("label", "symbol", F.substring("gram", 1, size - 1))
        total = F.sum(c).over(context)
        back = F.when(total > 0, F.greatest(F.sum(less).over(context) / total, F.lit(1e-9))).otherwise(1.0)
        own = F.when(c > 0, (c - less) / total).otherwise(0.0)
        # A row for each language, which the driver has collected before; no language goes to one task.
        orders.append(level.join(F.broadcast(fixed), "label").select("label", "gram", own.alias("p"), back.alias("rest")))
        if size > 1:
            end = F.substring("gram", 2, size - 1).alias("gram")
            shorter = level.groupBy("label", "symbol", end).agg(F.count_if(c > 0).alias("c"))
            level = materialise(shorter, f"characters{size - 1}")
            fixed = discounts_by_label(level)
    scores = orders.pop()
    while orders:
        lower = scores.select("label", F.col("gram").alias("_end"), F.col("p").alias("_p"), F.col("rest").alias("_rest"))
        upper = orders.pop().withColumn("_end", F.expr("substring(gram, 2)")).join(lower, ["label", "_end"])
        scores = upper.select(
            "label", "gram", (F.col("p") + F.col("rest") * F.col("_p")).alias("p"), (F.col("rest") * F.col("_rest")).alias("rest")
        )
    return scores


def stored_model(df: DataFrame, text: str = "text", lang: str = "lang") -> str:
    """The models of all rows, below the shared folder: (key, log_p, log_shape) of every
    sequence, by both steps and by the first, in files with a range of sorted keys each. The driver sees their path, and the bounded model of shapes."""
    spark = df.sparkSession
    shapes = spark.sparkContext.broadcast(fit(df, text, lang))
    scores = sequence_scores(materialise(sequence_counts(df, text, lang), "sequences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = SymbolTable(), shapes.value
        numbers = {label_of(x): i for x, i in known.numbers.items()}
        for batch in batches:
            labels, grams, p, rest = batch.columns
            labels = labels.dictionary_encode()
            names, place = labels.dictionary.to_pylist(), labels.indices.to_numpy()
            points = as_points(grams)
            codes = table.fold(points.ravel()).reshape(-1, REACH)[:, -ORDER:].astype(np.int64)
            whole = np.array([numbers[x] for x in names], np.int64)[place]
            for i in range(ORDER):
                whole = whole << BITS | codes[:, i]
            within = p.to_numpy() + rest.to_numpy() / table.members[codes[:, -1]]
            key = keys_of(points.T, np.array([salt_of(x) for x in names], np.uint64)[place])
            log_shape = known.score(whole)
            columns = [key, (log_shape + np.log2(within)).astype(np.float32), log_shape.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "log_p", "log_shape"])

    path = scratch_path(spark, "model")
    model = scores.mapInArrow(tidy(run), "key bigint, log_p float, log_shape float")
    model.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
    return path


def look_up(path: str, wanted: np.ndarray) -> np.ndarray:
    """log_p and log_shape of sorted keys, a row each; one piece of the model is held at a time."""
    out = np.repeat(np.array([UNKNOWN], np.float32).T, len(wanted), 1)
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    for info in system.get_file_info(fs.FileSelector(inner)):
        if not info.base_name.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(1 << 18, use_threads=False):
                if not batch.num_rows:
                    continue
                keys, *logs = (c.to_numpy() for c in batch.columns)
                first, end = np.searchsorted(wanted, keys[0]), np.searchsorted(wanted, keys[-1], "right")
                at = np.searchsorted(keys, wanted[first:end])
                hit = np.flatnonzero(keys[at] == wanted[first:end])
                for known, log in zip(out, logs, strict=True):
                    known[first + hit] = log[at[hit]]
    return out


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words which the text has more than once."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORDS.findall(text)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        duplicate_lines(text),
        repeated_words(words),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Of both steps of the model, and of the shapes alone.
LOSSES = ("log_perplexity", "shape_perplexity")
SCORED = "struct<" + ",".join([f"{m}:bigint" for m in MEASURES] + ["base_failed:boolean"] + [f"{x}:double" for x in LOSSES]) + ">"


def with_scores(
    df: DataFrame, path: str, keep: list[str], name: str, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The columns `keep` of df and a struct `name`: base measures, base_failed and the mean log2
    perplexities (LOSSES, null without characters) by the model stored at `path`."""
    schema = StructType([*(df.schema[c] for c in keep), *schema_of(f"`{name}` {SCORED}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        salts: dict[str | None, np.uint64] = {}

        def ruled(value: str) -> dict:
            own = dict(zip(MEASURES, measures(value), strict=True))
            few = own["n_words"] < LEAST_WORDS
            return {**own, "base_failed": few or 100 * own["n_repeat_words"] > MOST_REPEATED * own["n_words"]}

        def salt(language: str | None) -> np.uint64:
            if language not in salts:
                salts[language] = salt_of(label_of(language))
            return salts[language]

        def scored(slices: list[tuple[list, list, list, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            coded = pa.chunked_array([pa.array(keys) for *_, keys in slices]).dictionary_encode().unify_dictionaries()
            wanted = coded.chunk(0).dictionary.to_numpy()
            order = np.argsort(wanted)
            logs = np.empty((2, len(wanted)), np.float32)
            logs[:, order] = look_up(path, wanted[order])
            for (columns, rows, sizes, _), part in zip(slices, coded.chunks, strict=True):
                place, ends = part.indices.to_numpy(), np.cumsum(sizes)[:-1]
                losses = zip(*(np.split(-log[place], ends) for log in logs), strict=True)
                found = [
                    {**own, **{n: float(x.mean(dtype=np.float64)) if len(x) else None for n, x in zip(LOSSES, both, strict=True)}}
                    for own, both in zip(rows, losses, strict=True)
                ]
                columns = [*columns, pa.array(found, arrow.field(name).type)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

        kept, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                columns = batch.slice(start, 256).columns
                texts = [x or "" for x in columns.pop().to_pylist()]
                spoken = np.array([salt(x) for x in columns.pop().to_pylist()], np.uint64)
                points = [unfolded(x) for x in texts]
                sizes = [len(x) for x in points]
                keys = keys_of(windows(points), np.repeat(spoken, sizes))
                kept.append((columns, [ruled(x) for x in texts], sizes, keys))
                size += len(keys)
                if size >= LOOKED_UP:
                    yield from scored(kept)
                    kept, size = [], 0
        if kept:
            yield from scored(kept)

    language, value = fresh(df, "_lang", "_text")
    return df.select(*keep, F.col(lang).alias(language), F.col(text).alias(value)).mapInArrow(tidy(run), schema)


def judge(scored: DataFrame, name: str, lang: str = "lang") -> tuple[DataFrame, str, str]:
    """scored with two more columns, and their names: the bands of its language (low and high of the log
    perplexity, shape_low and shape_high of that of the shapes), and the verdict."""
    own, band, verdict = fresh(scored, "_own", "_band", "_kept")
    losses = [F.col(f"{name}.{x}").alias(x) for x in LOSSES]
    passed = scored.where(~F.col(f"{name}.base_failed")).select(F.col(lang).alias(own), *losses)
    middle = lambda of: F.percentile_approx(of, 0.5, 10_000)
    medians = materialise(passed.groupBy(own).agg(*[middle(x).alias(f"middle_{x}") for x in LOSSES]), "medians")
    medians = medians.withColumnRenamed(own, "of")
    apart = passed.join(medians, F.col(own).eqNullSafe(F.col("of")))
    edges = []
    for x, prefix in zip(LOSSES, ("", "shape_"), strict=True):
        center = F.first(f"middle_{x}")
        width = F.greatest(middle(F.abs(F.col(x) - F.col(f"middle_{x}"))) * 1.4826, center * LEAST_DEVIATION) * BAND_WIDTH
        edges += [(center - width).alias(f"{prefix}low"), (center + width).alias(f"{prefix}high")]
    bands = apart.groupBy(own).agg(*edges)
    bands = bands.select(own, F.struct(*[c for c in bands.columns if c != own]).alias(band))
    # Written, so that their real size is known and the rows are not shuffled to meet them.
    bands = materialise(bands, "bands")
    both, shape = (F.col(f"{name}.{x}") for x in LOSSES)
    within = both.between(F.col(f"{band}.low"), F.col(f"{band}.high"))
    within &= shape.between(F.col(f"{band}.shape_low"), F.col(f"{band}.shape_high"))
    judged = (
        scored.join(bands, F.col(lang).eqNullSafe(F.col(own)), "left")
        .drop(own)
        .withColumn(verdict, ~F.col(f"{name}.base_failed") & F.coalesce(within, F.lit(False)))
    )
    return judged, band, verdict


def quality(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per row of df: key, lang, measures, base_failed, log_perplexity, shape_perplexity, low,
    high, shape_low, shape_high, kept.

    Null or empty text: no words, so it fails the base rules. Keys are passed on as they are
    (null, repeated rows stay); other columns are ignored. An empty table gives an empty result.
    """
    (name,) = fresh(df, "_quality")
    scored = materialise(with_scores(df, stored_model(df, text, lang), [key, lang], name, text, lang), "quality")
    judged, band, verdict = judge(scored, name, lang)
    return judged.select(key, lang, f"{name}.*", f"{band}.*", F.col(verdict).alias("kept"))


def good_rows(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df that the rules keep, with all their columns.

    Rows are written with their scores before the bands are known, so each text is scored once
    and none is shuffled; nothing is looked up by key, so repeated or null keys do not matter."""
    (name,) = fresh(df, "_quality")
    scored = materialise(with_scores(df, stored_model(df, text, lang), df.columns, name, text, lang), "scored")
    judged, _, verdict = judge(scored, name, lang)
    return judged.where(F.col(verdict)).select(*df.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
