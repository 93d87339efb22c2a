r"""Conversations rebuilt from event logs, and rendered with a loss mask.

A log holds events (conv_id, seq, op, turn, role, text). `message` opens a message at a turn,
`delta` appends text to the last message of its turn, `edit` replaces that text, `regenerate`
starts it anew and voids all that later turns held at the time. Events are folded in the order
of seq. The log is dealt by (conversation, turn), so the turns of one long conversation are folded
by many tasks; what a regeneration voids is found with running maxima over blocks of turns.

The template is `### role:\n`, the text, `</turn>\n`. In texts a backslash is doubled, the
first characters of `###` become `\h` and the one of `</turn>` becomes `\l`, so no control string is
left in a text and reading back is exact. Messages are stored one by one with their place, so
a conversation of any length is never one value; its rendering is the segments in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, read_table
from driftline.session import materialise

OPS = ("message", "regenerate", "edit", "delta")
LEARNED_ROLE = "assistant"
TURN_BLOCK = 4096
CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(r"[\\#<:\n]")
SAFE = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
PLAIN = {v[1]: k for k, v in SAFE.items()}
SEGMENT = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n(.*)</turn>\n", re.S)


def escape(text: str, pattern: re.Pattern = CONTROL) -> str:
    return pattern.sub(lambda m: SAFE[m.group()], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start, end of the text under the loss mask; 0, 0 if there is none)."""
    head, body = f"### {escape(role, IN_ROLE)}:\n", escape(text)
    learned = (len(head), len(head) + len(body)) if role == LEARNED_ROLE else (0, 0)
    return f"{head}{body}</turn>\n", *learned


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered message."""
    found = SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a rendered message")
    return unescape(found[1]), unescape(found[2])


def live_events(events: DataFrame) -> DataFrame:
    """events without those that a later regeneration of an earlier turn voids."""
    restart = F.when(F.col("op") == "regenerate", F.col("seq"))
    turns = events.groupBy("conv_id", "turn").agg(F.max(restart).alias("s"))
    touched = turns.where("s is not null and conv_id is not null").select("conv_id").distinct()
    turns = turns.join(touched, "conv_id", "left_semi").withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    blocks = turns.groupBy("conv_id", "block").agg(F.max("s").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.max("s").over(earlier).alias("before"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    voids = (
        turns.withColumn("inside", F.max("s").over(inside))
        .join(blocks, ["conv_id", "block"])
        .select("conv_id", "turn", F.greatest("before", "inside").alias("void_to"))
        .where("void_to is not null")
    )
    # Mostly a small table; written, its real size decides how the texts meet it.
    voids = materialise(voids, "voids")
    return events.join(voids, ["conv_id", "turn"], "left").where("void_to is null or seq > void_to").drop("void_to")


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Messages (conv_id, turn, place, role, text) of events sorted by conversation, turn and seq.

    Only one message is held at a time."""
    turn = place = role = None
    parts: list[str] = []
    is_open = False
    for conv, at, _, op, who, text in rows:
        op, text = op or "message", text or ""
        if op not in OPS:
            raise ValueError(f"unknown event {op!r}")
        if turn != (conv, at):
            if is_open:
                yield (*turn, place, role, "".join(parts))
            turn, place, is_open = (conv, at), -1, False
        if op == "message" or not is_open:
            if is_open:
                yield (*turn, place, role, "".join(parts))
            place, role, parts, is_open = place + 1, who or "", [text], True
        elif op == "delta":
            parts.append(text)
        else:
            parts = [text]
    if is_open:
        yield (*turn, place, role, "".join(parts))


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, turn, place, segment, loss_start, loss_end) for every final message, written once.

    events: conv_id, seq, op, turn, role, text. Null op: message. Null text or role: empty. A
    null conversation is one conversation; a null turn comes before the others and is never
    voided; null seq comes first. Events of equal seq: by kind as in OPS, then role, then text.
    Repeated `message` rows are messages of their own, in order, at the same turn. A delta, edit
    or regeneration without a message opens one. An empty log gives an empty result.
    """
    rank = F.array_position(F.array(*map(F.lit, OPS)), F.coalesce("op", F.lit(OPS[0])))
    order = live_events(events.select("conv_id", "seq", "op", "turn", "role", "text")).withColumn("rank", rank)
    order = order.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "rank", "role", "text")

    def make():
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for conv, turn, place, role, text in fold(rows):
                yield (conv, turn, place, *render(role, text))

        return step

    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, place int, segment string, loss_start int, loss_end int"
    columns = ("conv_id", "turn", "seq", "op", "role", "text")
    return materialise(map_rows(order, columns, schema, make, lambda r: 64 + len(r[3])), "formatted")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text, learned, chars) from segments; learned is the text under
    the mask, null without one."""

    def make():
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for conv, turn, place, segment, start, end in rows:
                learned = unescape(segment[start:end]) if start else None
                yield (conv, turn, place, *parse(segment), learned, len(segment))

        return step

    kind = {f.name: f.dataType.simpleString() for f in rendered.schema}
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, place int, role string, text string, learned string, chars int"
    return map_rows(rendered, rendered.columns, schema, make, lambda r: 64 + 2 * r[6])


def digests(messages: DataFrame) -> DataFrame:
    """One row per conversation. A digest over its whole text has to pass the messages in order, so
    one task streams a conversation, holding one message; parsing was done before, in parallel."""
    order = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")

    def make():
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            current, state = None, None
            for conv, _, _, role, text, learned, chars in rows:
                if state is None or conv != current:
                    if state:
                        yield finish(current, state)
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += chars
            if state:
                yield finish(current, state)

        def finish(conv, state: list) -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        return step

    kind = messages.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    return map_rows(order, messages.columns, schema, make)


def as_events(conversations: DataFrame) -> DataFrame:
    """A finished conversation table as a log: every row opens a message, in the order of turns."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), "turn", "role", "text")


PROBE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(read_back(formatted(as_events(table.unionByName(probe)))))


# Lengths follow from the template: each escaped character is one character longer.
OP8_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda r: length(r) - 2)), 0)
    + length(role) + (length(role) - length(regexp_replace(role, '[\\#<:\n]', '', 'g')))
    + length('### ') + length(':.') + length('</turn>.') AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {"op8_chat": op8_chat}
ORACLES = {"op8_chat": OP8_SQL}
