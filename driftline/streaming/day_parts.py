"""A table that a stream adds to, kept by day in parts that are merged as they add up.

A micro-batch writes one part, split by day. Which parts make up the table is said by a short list
that each batch writes last; a reader opens the folders on the list and lists no other. Parts of a
day are merged eight at a time, level by level, so a row is written again once for each level and
not once for each batch, and a day that the stream has left behind becomes one part.

A batch that is repeated after a failure starts from the list of the batch before it and replaces
its own folders. What a merge has made superfluous is deleted when no repeated batch and no reader of the
newest list can ask for it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY, PART, BATCH = "part_day", "part_name", "part_batch"
NO_DAY = "none"
CLOSED = 99
FAN_IN = 8
LIST_SCHEMA = f"{DAY} string, {PART} string, level int"


def newest_wins(keys: list[str], value: str) -> Callable[[DataFrame], DataFrame]:
    """Merge rule for tables of running values: each key as the newest batch that wrote it has it."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(DAY, *keys).agg(F.max_by(value, BATCH).alias(value), F.max(BATCH).alias(BATCH))

    return merge


class DayParts:
    """The table below `root`.

    `merge` turns the rows of several parts into those that replace them; without one all rows are
    kept. `open_days` is how many days before the newest one still get rows as a rule.
    """

    def __init__(
        self, root: str, merge: Callable[[DataFrame], DataFrame] | None = None, open_days: int = 1, fan_in: int = FAN_IN
    ) -> None:
        self.root, self.merge, self.open_days, self.fan_in = root, merge, open_days, fan_in

    def _folder(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, name: str) -> list[str]:
        fs, path = self._folder(spark, name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _drop(self, spark: SparkSession, name: str) -> None:
        fs, path = self._folder(spark, name)
        fs.delete(path, True)

    def _lists(self, spark: SparkSession) -> list[int]:
        """Batches with a complete list, at most three."""
        found = []
        for name in self._names(spark, "lists"):
            fs, done = self._folder(spark, f"lists/{name}/_SUCCESS")
            if fs.exists(done):
                found.append(int(name))
        return sorted(found)

    def _list(self, spark: SparkSession, batch: int) -> list[tuple[str, str, int]]:
        return [tuple(r) for r in spark.read.schema(LIST_SCHEMA).parquet(f"{self.root}/lists/{batch}").collect()]

    def _schema(self, spark: SparkSession) -> T.StructType:
        stored = spark.read.parquet(f"{self.root}/schema").schema
        return T.StructType([*stored.fields, T.StructField(PART, T.StringType()), T.StructField(DAY, T.StringType())])

    def _open(self, spark: SparkSession, pieces: list[tuple[str, str]]) -> DataFrame:
        base = f"{self.root}/parts"
        if not pieces:
            return spark.createDataFrame([], self._schema(spark))
        paths = [f"{base}/{PART}={part}/{DAY}={day}" for day, part in pieces]
        return spark.read.schema(self._schema(spark)).option("basePath", base).parquet(*paths)

    def add(self, rows: DataFrame, day: Column, batch: int) -> None:
        """The rows of a micro-batch; `day` is the date that they are filed under."""
        spark = rows.sparkSession
        before = [b for b in self._lists(spark) if b < batch]
        listed = self._list(spark, before[-1]) if before else []
        if len(before) > 1:
            for old in before[:-1]:
                for gone_day, part, _ in set(self._list(spark, old)) - set(listed):
                    self._drop(spark, f"parts/{PART}={part}/{DAY}={gone_day}")
                self._drop(spark, f"lists/{old}")
        filed = rows.withColumns({DAY: F.coalesce(day.cast("string"), F.lit(NO_DAY)), BATCH: F.lit(batch).cast("bigint")})
        stored = T.StructType([f for f in filed.schema.fields if f.name != DAY])
        spark.createDataFrame([], stored).write.mode("ignore").parquet(f"{self.root}/schema")
        own = f"b{batch}"
        filed.write.mode("overwrite").partitionBy(DAY).parquet(f"{self.root}/parts/{PART}={own}")
        names = self._names(spark, f"parts/{PART}={own}")
        days = {n.split("=", 1)[1] for n in names if n.startswith(f"{DAY}=")}
        made = [(d, own, 0) for d in days]
        listed = self._merged(spark, [*listed, *made], days, batch, made)
        target = f"{self.root}/lists/{batch}"
        spark.createDataFrame(listed, LIST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(target)
        for gone_day, part, _ in set(made) - set(listed):  # merged at once: on no list
            self._drop(spark, f"parts/{PART}={part}/{DAY}={gone_day}")

    def _merged(self, spark: SparkSession, listed: list, days: set[str], batch: int, made: list) -> list:
        level = 0
        while level <= max((n for _, _, n in listed if n < CLOSED), default=-1):
            at = {d: [x for x in listed if x[0] == d and x[2] == level] for d, _, _ in listed}
            listed = self._rewrite(spark, listed, [x for v in at.values() if len(v) >= self.fan_in for x in v], f"m{batch}-{level + 1}", level + 1, made)
            level += 1
        known = [d for d, _, _ in listed if d != NO_DAY]
        if known:
            border = str(date.fromisoformat(max(known)) - timedelta(days=self.open_days))
            left = {d: [x for x in listed if x[0] == d] for d in known if d < border and d not in days}
            listed = self._rewrite(spark, listed, [x for v in left.values() if len(v) > 1 for x in v], f"m{batch}-closed", CLOSED, made)
        return listed

    def _rewrite(self, spark: SparkSession, listed: list, gone: list, name: str, level: int, made: list) -> list:
        """The list with the parts in `gone` replaced by one part for each of their days; these go to `made` too."""
        if not gone:
            return listed
        rows = self._open(spark, [(d, p) for d, p, _ in gone])
        rows = self.merge(rows) if self.merge else rows
        # A day's files go with the day, so a merged day has few of them.
        rows.drop(PART).repartition(DAY, F.floor(F.rand(0) * 4)).write.mode("overwrite").partitionBy(DAY).parquet(
            f"{self.root}/parts/{PART}={name}"
        )
        new = [(d, name, level) for d in {x[0] for x in gone}]
        made += new
        return [*(x for x in listed if x not in gone), *new]

    def pieces(self, spark: SparkSession, last_days: int | None = None) -> list[tuple[str, str]]:
        """(day, part) of the newest list; with `last_days` only the newest day and that many before it."""
        complete = self._lists(spark)
        listed = [(d, p) for d, p, _ in self._list(spark, complete[-1])] if complete else []
        dated = [d for d, _ in listed if d != NO_DAY]
        if last_days is None or not dated:
            return listed
        first = str(date.fromisoformat(max(dated)) - timedelta(days=last_days))
        return [(d, p) for d, p in listed if d != NO_DAY and d >= first]

    def read(self, spark: SparkSession, last_days: int | None = None) -> DataFrame:
        """The table, or its newest days; running values are brought to their newest by the merge rule."""
        rows = self._open(spark, self.pieces(spark, last_days)).drop(PART)
        return (self.merge(rows) if self.merge else rows).drop(DAY, BATCH)
