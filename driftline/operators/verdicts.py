"""Verdict objects taken out of free text in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERDICT_KEYS = ("diagnosis", "trigger_retraining")
VERDICT_SCHEMA = (
    "diagnosis string, "
    "recommendations array<struct<action: string, priority: string, reason: string>>, "
    "trigger_retraining boolean"
)


def brace_pairs(texts: DataFrame, row_key: str, text: str) -> DataFrame:
    """Start and end (1-based) of every balanced {...} of each text.

    The text is cut before each brace, so there is one small row per brace and the whole
    text is only read once. With the depth counted along the text, a closing brace matches
    the last opening brace of the same level, which is the row before it on that level.
    """
    pieces = texts.filter(F.col(text).contains("{")).select(
        row_key, F.posexplode(F.split(text, r"(?=[{}])")).alias("_no", "_piece")
    )
    lengths = pieces.select(
        row_key, "_no", F.substring("_piece", 1, 1).alias("_kind"), F.char_length("_piece").alias("_len")
    )
    along = Window.partitionBy(row_key).orderBy("_no")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("_kind") == "{", 1).when(F.col("_kind") == "}", -1).otherwise(0)
    placed = lengths.select(
        row_key,
        "_kind",
        (F.coalesce(F.sum("_len").over(before), F.lit(0)) + 1).alias("_pos"),
        F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_depth"),
    ).filter(F.col("_kind").isin("{", "}"))
    level = F.when(F.col("_kind") == "{", F.col("_depth")).otherwise(F.col("_depth") + 1)
    on_level = Window.partitionBy(row_key, "_level").orderBy("_pos")
    matched = placed.withColumn("_level", level).withColumns(
        {"_next_kind": F.lead("_kind").over(on_level), "_next": F.lead("_pos").over(on_level)}
    )
    return matched.filter((F.col("_kind") == "{") & (F.col("_next_kind") == "}")).select(
        row_key, F.col("_pos").cast("int").alias("start"), F.col("_next").cast("int").alias("end")
    )


def extract_verdicts(texts: DataFrame, row_key: str, text: str) -> DataFrame:
    """Per text the verdict object, or no row when none parses.

    Among the balanced objects that parse as JSON, the first one with a verdict key wins,
    else the longest one (as written, the earliest on a tie). Repeated names are allowed, the last
    one counts; NaN and Infinity are numbers. `blob_md5` is the digest of the object as written.
    """
    pairs = brace_pairs(texts, row_key, text)
    candidates = pairs.join(texts.select(row_key, text), row_key).select(
        row_key,
        "start",
        F.substring(F.col(text), F.col("start"), F.col("end") - F.col("start") + 1).alias("blob"),
    )
    # A record with none of the object's fields can only be corrupt if the text is not JSON.
    whole = F.from_json("blob", "`/none` string, `/corrupt` string", {"columnNameOfCorruptRecord": "/corrupt"})
    fields = F.map_keys(F.from_json("blob", "map<string, string>"))
    parsed = candidates.filter(whole["/corrupt"].isNull()).withColumns(
        {
            "_verdict": F.coalesce(F.arrays_overlap(fields, F.array(*[F.lit(k) for k in VERDICT_KEYS])), F.lit(False)),
            "_length": F.char_length("blob"),
        }
    )
    preference = F.struct(
        F.when(F.col("_verdict"), 1).otherwise(0).alias("a"),
        F.when(F.col("_verdict"), -F.col("start")).otherwise(F.col("_length")).alias("b"),
        (-F.col("start")).alias("c"),
    )
    best = parsed.groupBy(row_key).agg(F.max_by("blob", preference).alias("blob"))
    return best.withColumn("verdict", F.from_json("blob", VERDICT_SCHEMA)).select(
        row_key,
        "blob",
        F.md5("blob").alias("blob_md5"),
        F.coalesce(F.col("verdict.diagnosis"), F.lit("")).alias("diagnosis"),
        F.coalesce(
            F.col("verdict.recommendations"),
            F.from_json(F.lit("[]"), "array<struct<action: string, priority: string, reason: string>>"),
        ).alias("recommendations"),
        F.coalesce(F.col("verdict.trigger_retraining"), F.lit(False)).alias("trigger_retraining"),
    )
