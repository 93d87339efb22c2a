"""SentencePiece encoding with the original byte span of every piece, and decoding.

The normaliser is read from the model file: its compiled character map (a double-array trie over
UTF-8 bytes with a pool of replacements) is applied by longest prefix, and every byte of the
normalised text records the byte of the original it came from. The library merges the pieces;
the piece lengths then cut the normalised text, and the recorded source positions project each
cut to the original. A text whose pieces do not add up to this normalised text is an error, so
the spans can not drift from the ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm.common import read_table, schema_of, tidy

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
CHUNK_CHARS = 1 << 20


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            size = number()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled map."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest entry that data has at start."""
        units = self.units
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = at + 1 - start, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


class AlignedEncoder:
    """A SentencePiece model together with its own normaliser."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        import sentencepiece

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        blob, self.dummy, self.squeeze, self.escape, self.as_suffix = b"", True, True, True, False
        self.symbols: set[bytes] = set()
        for field, value in proto_fields(proto):
            if field == 1:
                piece = dict(proto_fields(value))
                if piece.get(3) == 4:
                    self.symbols.add(piece[1])
            elif field == 2:
                self.as_suffix = bool(dict(proto_fields(value)).get(24, 0))
            elif field == 3:
                spec = dict(proto_fields(value))
                blob = spec.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.as_suffix:
            raise ValueError("models that mark white space as a suffix are not known")
        self.map = CharacterMap(blob) if blob else None
        self.symbol_sizes = sorted({len(s) for s in self.symbols}, reverse=True)
        sizes = []
        for i in range(self.library.get_piece_size()):
            if self.library.is_control(i):
                sizes.append(0)
            elif self.library.is_byte(i):
                sizes.append(1)
            elif self.library.is_unknown(i):
                sizes.append(-1)
            else:
                sizes.append(len(self.library.id_to_piece(i).encode()))
        self.sizes = np.array(sizes, np.int64)

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the original byte position."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze and self.escape and not self.symbols:
            return self.by_spaces(data)
        return self.by_map(data)

    def by_spaces(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same for models that only mark spaces, without a loop."""
        raw = np.frombuffer(data, np.uint8)
        place = np.arange(len(raw))
        source = np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, place))
        source = np.repeat(source, np.where(raw == 32, len(MARK), 1))
        head = np.zeros(len(MARK) if self.dummy else 0, np.int64)
        text = (MARK if self.dummy else b"") + data.replace(b" ", MARK)
        return text, np.concatenate([head, source, [len(raw)]])

    def by_map(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """One longest prefix after the other."""
        at, pieces, sources, widths = 0, [], [], []
        space = MARK if self.escape else b" "

        def put(text: bytes, source: int) -> None:
            pieces.append(text)
            sources.append(source)
            widths.append(len(text))

        if self.squeeze:
            while at < len(data) and self.prefix(data, at)[1] == b" ":
                at += self.prefix(data, at)[0]
            if at == len(data):
                return b"", np.array([at])
        if self.dummy:
            put(space, at)
        after_space = self.squeeze
        while at < len(data):
            used, text = self.prefix(data, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", space), at)
                after_space = text.endswith(b" ") and self.squeeze
            at += used
        if self.squeeze:
            while pieces and pieces[-1].endswith(space):
                pieces[-1] = pieces[-1][: -len(space)]
                widths[-1] -= len(space)
                at = sources[-1]
                if not pieces[-1]:
                    for kept in (pieces, sources, widths):
                        kept.pop()
                else:
                    break
        return b"".join(pieces), np.concatenate([np.repeat(np.array(sources, np.int64), widths), [at]])

    def prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes consumed, normalised bytes) of the next unit of the original."""
        for size in self.symbol_sizes:
            if data[at : at + size] in self.symbols:
                return size, data[at : at + size]
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        first = data[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, data[at : at + size]

    def cuts(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Original byte positions where pieces begin, and where the last one ends."""
        normal, source = self.normalize(text.encode())
        sizes = self.sizes[ids]
        if (sizes < 0).any():  # unknown pieces show their own text
            shown = self.library.encode(text, out_type=str, add_eos=False, add_bos=False)
            own = iter(shown)
            sizes = np.array([0 if s == 0 else len(next(own).encode()) if s < 0 else (next(own), s)[1] for s in sizes])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if ends[-1] != len(normal):
            raise ValueError("the pieces do not make up the normalised text")
        return source[ends]

    def encode(self, texts: list[str], end: bool) -> list[np.ndarray]:
        return self.library.encode(
            texts, return_type="numpy", add_bos=False, add_eos=end, enable_sampling=False, num_threads=1
        )


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    joined = np.concatenate([*values, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined))


def _chunks(batch: pa.RecordBatch, weigh) -> Iterator[pa.RecordBatch]:
    """Slices of at most 256 rows and about CHUNK_CHARS, a longer row alone."""
    start = total = 0
    for i in range(batch.num_rows):
        weight = weigh(batch.column(1)[i])
        if i > start and (total + weight > CHUNK_CHARS or i - start >= 256):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += weight
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(
    df: DataFrame, path: str, end: bool = True, text: str = "text", key: str = "doc_id", back: bool = False
) -> DataFrame:
    """key, ids, and cuts: piece i is the original's UTF-8 bytes cuts[i] to cuts[i + 1]. With
    `back` also `decoded`, what decode() makes of the ids, in the same pass and Python worker.

    Null text: empty, so only the end id. Key is passed on as it is (null, repeated rows stay);
    other columns are ignored. A control id has an empty span at its place.
    """
    more = ", decoded string" if back else ""
    schema = schema_of(f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, cuts array<int>{more}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        model = AlignedEncoder(path)
        for batch in batches:
            for part in _chunks(batch, lambda v: len(v.as_buffer() or b"") if v.is_valid else 0):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = model.encode(texts, end)
                cuts = [model.cuts(t, i) for t, i in zip(texts, ids, strict=True)]
                columns = [part.column(0), _lists(ids), _lists(cuts)]
                if back:
                    columns.append(pa.array([model.library.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.select(key, text).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df and a column `decoded`, the library's text for the ids; null ids give a null text."""
    schema = schema_of(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", decoded string")
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        arrow = to_arrow_schema(schema)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [library.decode(v.values.to_numpy()) if v.is_valid else None for v in part.column(at)]
                columns = [*part.columns, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(tidy(run), schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the source bytes that the spans cover."""
    return encode(df, path, back=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.element_at("cuts", -1).cast("long").alias("n_source_bytes"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
