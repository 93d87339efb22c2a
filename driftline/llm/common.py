"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Output rows are handed to Spark in batches of about this many payload bytes.
BATCH_BYTES = 4 << 20
# Words are runs of anything but these six characters (space, tab to carriage return).
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive beside their executor's JVM
    when a task is done, and share its memory limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives memory back when its partition is done."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return tidied


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    schema: str,
    make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]],
    weigh: Callable[[tuple], int] = lambda row: 64,
) -> DataFrame:
    """Run a generator over the rows of each partition, in Arrow batches.

    `make()` runs once in the task and returns the generator function, so that models are
    loaded once. Only `columns` reach Python. Rows are emitted in small batches (`weigh` gives
    the bytes of a row), so memory is bounded by one input batch and one output batch.
    """
    struct = _parse_datatype_string(schema)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        step = make()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                # A slice at a time: a batch of long texts is not doubled as Python objects.
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)

        kept: list[tuple] = []
        weight = 0
        for row in step(rows()):
            kept.append(row)
            weight += weigh(row)
            if weight >= BATCH_BYTES or len(kept) >= 10_000:
                yield batch_of(kept, arrow)
                kept, weight = [], 0
        if kept:
            yield batch_of(kept, arrow)

    return df.select(*[F.col(c) for c in names]).mapInArrow(tidy(run), struct)


def batch_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def schema_of(text: str) -> StructType:
    return _parse_datatype_string(text)


def word_count(column) -> object:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
