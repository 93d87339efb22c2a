"""Conversations from event logs."""

import hashlib
import random

import pytest

from driftline.llm import op8_chat as chat

SCHEMA = "conv_id long, seq long, op string, turn long, role string, text string, place string"


def replay(events):
    """Final messages by replaying the log in order, one conversation after the other."""
    out = {}
    for conv in {e[0] for e in events}:
        turns = {}
        for _, _, op, turn, role, text, *_ in sorted((e for e in events if e[0] == conv), key=lambda e: e[1]):
            role, text = role or "", text or ""
            if op == "regenerate":
                turns = {t: m for t, m in turns.items() if t <= turn}
            mine = turns.setdefault(turn, [])
            if op in (None, "message") or not mine:
                mine.append([role, text])
            elif op == "delta":
                mine[-1][1] += text
            else:
                mine[-1][1] = text
        out[conv] = [tuple(m) for t in sorted(turns) for m in turns[t]]
    return out


def wanted(conv, messages):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = "".join(t for r, t in messages if r == "assistant")
    size = sum(len(chat.render(r, t)[0]) for r, t in messages)
    return (conv, len(messages), sha("".join(f"{r}\n{t}\n" for r, t in messages)), len(learned), sha(learned), size)


def run(df):
    return sorted(map(tuple, chat.digests(chat.read_back(chat.formatted(df))).collect()), key=str)


TEXTS = [None, "", "plain", "### user:\n", "</turn>", "\\", "\\h", "#####", "a\nb", "</turn>\n### assistant:\nx", "é😀" * 5]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_random_logs(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "TURN_BLOCK", block)
    draw = random.Random(block)
    events = []
    for conv in range(40):
        for seq in range(draw.randint(1, 30)):
            op = draw.choice(["message", "message", "delta", "delta", "edit", "regenerate", None])
            events.append((conv, seq, op, draw.randint(0, 6), draw.choice(["user", "assistant", "a:b\\#", None]), draw.choice(TEXTS), "x"))
    draw.shuffle(events)
    got = run(spark.createDataFrame(events, SCHEMA).repartition(5))
    assert got == sorted((wanted(c, m) for c, m in replay(events).items()), key=str)


def test_template_is_reversible_and_safe():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice(["#", "\\", "h", "l", "<", "/turn>", "</turn>", "### ", "\n", "x", ":"]) for _ in range(draw.randint(0, 9)))
        role = "".join(draw.choice(["#", "\\", "<", ":", "\n", "user"]) for _ in range(draw.randint(0, 4)))
        segment, start, end = chat.render(role, text)
        assert chat.parse(segment) == (role, text)
        assert "###" not in segment[4:] and segment.count("</turn>") == 1
        _, start, end = chat.render("assistant", text)
        assert chat.unescape(chat.render("assistant", text)[0][start:end]) == text
    with pytest.raises(ValueError):
        chat.parse("### user: no end")


def test_edges(spark):
    rows = [(None, 0, "message", None, "user", "a", ""), (None, 1, "message", 0, "assistant", None, "")]
    rows += [(1, None, "message", 0, "user", "b", ""), (1, 5, "message", 0, "user", "b", ""), (1, 5, "delta", 0, None, "c", "")]
    got = {r[0]: r for r in run(spark.createDataFrame(rows, SCHEMA))}
    assert got[None] == wanted(None, [("user", "a"), ("assistant", "")])
    assert got[1] == wanted(1, [("user", "b"), ("user", "bc")])
    assert run(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(Exception, match="unknown event"):
        run(spark.createDataFrame([(1, 1, "zap", 1, "u", "t", "")], SCHEMA))
