"""Token counts at every prefix of a text, for byte-level BPE vocabularies in tokenizers' JSON form.

The encoding of a byte string ends in exactly one token t for which the encoding of what comes
before, followed by t, is itself a valid encoding; this holds if t and the token before it do
not merge differently when encoded together. So one left-to-right pass stores, for every
prefix, its last token and its token count. The pass runs inside a pre-token (a word with its
space, a number, punctuation, white space); pre-tokens are kept in a bounded cache, and a text's
table is their tables laid end to end. Where the splitting of a prefix differs from that of the
whole text (a white-space run that is cut off at its end, a contraction cut in two, the start of
a special string) the table holds the count of the prefix, not of the part of the whole text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, read_table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_ENTRIES = 600_000

# The contractions of the byte-level pattern that can be cut inside the letters.
CUT_CONTRACTIONS = {"'ll", "'ve", "'re"}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(test) -> str:
    return "".join(f"\\u{c:04x}" for c in _NEAR if test(unicodedata.category(chr(c))))


# The characters of most Latin-script text; for these the standard library's regular
# expressions with explicit classes give the same pieces several times faster.
_NEAR = [*range(0x250), *range(0x2010, 0x2028)]
_SPACES = "\\t-\\r \\x85\\xa0"
_LETTERS = _class(lambda k: k[0] == "L")
_NUMBERS = _class(lambda k: k[0] == "N")
_FAR = re.compile("[^\\x00-\\u024f\\u2010-\\u2027]")
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
# A run of blanks is tried once, from its first blank, and never given back.
_FAST_RUN = re.compile(f"(?<![{_SPACES}])[{_SPACES}]{{2,}}+(?=[^{_SPACES}])")
_WIDE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_WIDE_RUN = regex.compile(r"(?<!\p{White_Space})\p{White_Space}{2,}+(?=\P{White_Space})")


class PrefixCounter:
    """Exact token counts of all prefixes, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if data.get("normalizer") or data["pre_tokenizer"] != data["pre_tokenizer"] | {
            "type": "ByteLevel", "add_prefix_space": False, "use_regex": True
        }:
            raise ValueError("only byte-level vocabularies without normalisation are known")
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        special = set(self.special)
        self.vocabulary = {as_bytes(s) for s in data["model"]["vocab"] if s not in special}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[as_bytes(left), as_bytes(right)] = i
        # Every suffix of every token: a walk to the left ends when no token can still end so.
        self.suffixes = {t[i:] for t in self.vocabulary for i in range(len(t))}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if special else None
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The pair-merging rule itself, for the short strings that decide which pairs are stable."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(
                ((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            )
            if best[0] == len(self.rank):
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stable(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            wanted = [left, right] if left else [right]
            known = self.pairs[left, right] = self.merge(left + right) == wanted
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ..."""
        vocabulary, suffixes, pairs = self.vocabulary, self.suffixes, self.pairs
        last: list[bytes] = [b""]
        count = [0]
        begin = 0  # of the last token so far
        for end in range(1, len(data) + 1):
            # Exactly one start is right; the one of the token before is the most frequent.
            token = data[begin:end]
            if not (token in vocabulary and (pairs.get((last[begin], token)) or self.stable(last[begin], token))):
                begin = end - 1
                while begin >= 0:
                    token = data[begin:end]
                    if token not in suffixes:
                        begin = -1
                        break
                    if token in vocabulary and (pairs.get((last[begin], token)) or self.stable(last[begin], token)):
                        break
                    begin -= 1
                if begin < 0:
                    raise ValueError("the merges of this vocabulary have no stable prefix encoding")
            last.append(token)
            count.append(count[begin] + 1)
        return count

    def piece(self, text: str) -> bytes:
        """Steps of the count at each further code point of a pre-token, as 16-bit numbers."""
        data = text.encode()
        counts = self.byte_counts(data)
        if len(data) != len(text):
            counts = [counts[i] for i in range(len(data)) if data[i] & 0xC0 != 0x80] + counts[-1:]
        if text in CUT_CONTRACTIONS:
            counts[2] = counts[1] + 1
        # A step that does not fit 16 bits is an error, not a wrong count.
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text in which no special string is looked for."""
        cut, runs = (_WIDE, _WIDE_RUN) if _FAR.search(text) else (_FAST, _FAST_RUN)
        known = self.pieces
        steps = []
        for p in cut.findall(text):
            s = known.get(p)
            if s is None:
                s = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[p] = s
            steps.append(s)
        counts = np.zeros(len(text) + 1, np.int32)
        np.cumsum(np.frombuffer(b"".join(steps), np.int16), out=counts[1:], dtype=np.int32)
        for run in runs.finditer(text):
            whole = self.byte_counts(run.group().encode())[-1]
            counts[run.end()] = counts[run.start()] + whole
        return counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts of text[:0], text[:1], ... (code points) as the library counts each of them."""
        found = list(self.split_special.finditer(text)) if self.split_special else []
        if not found:
            return self.plain(text)
        out = np.zeros(len(text) + 1, np.int32)
        start = base = 0
        for match in found:
            # Up to the last character of the special string its beginning is ordinary text.
            part = text[start : match.end() - 1]
            out[start : match.end()] = base + self.plain(part)
            base = out[match.end()] = out[match.start()] + 1
            start = match.end()
        out[start:] = base + self.plain(text[start:])
        return out



_loaded: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, kept with its caches for the further tasks of a worker."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens (counts may fall again)."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def prefix_tables(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of df: key, n_bytes, n_tokens, and `counts`, the 32-bit little-endian
    token counts of every prefix by code points, from 0. Null text: empty. Key is passed on as
    it is (null, repeated); other columns are ignored."""

    def make():
        counter = counter_of(path)

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for k, value in rows:
                value = value or ""
                counts = counter.prefix_counts(value)
                yield k, len(value.encode()), int(counts[-1]), counts.astype("<i4").tobytes()

        return step

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, counts binary"
    return map_rows(df, [key, text], schema, make, lambda r: 64 + len(r[3]))


def token_counts(
    df: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit and fit_chars, the code points of the longest prefix
    within the limit, all read from the prefix table of the text. Null text: empty."""

    def make():
        counter = counter_of(path)

        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for k, value in rows:
                value = value or ""
                counts = counter.prefix_counts(value)
                total = int(counts[-1])
                fit = len(value) if total <= limit else longest_prefix(counts, limit)
                yield k, len(value.encode()), total, total > limit, fit

        return step

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return map_rows(df, [key, text], schema, make)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return token_counts(documents, public_tokenizers.path(TOKENIZER), LIMIT)


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
