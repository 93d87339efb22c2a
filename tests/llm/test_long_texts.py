"""Texts of a million characters whose patterns begin everywhere: time in proportion to the length."""

import base64
import random
import time

import public_tokenizers
import pytest
import tokenizers

from driftline.llm import op5_secrets, op6_token_counts

MILLION = 1_000_000
BYTES = random.Random(2).randbytes(MILLION * 3 // 4)
SHAPES = {
    "ey": "ey" * (MILLION // 2),
    "header": "eyJ" * (MILLION // 3),
    "dotted": "ey" * (MILLION // 2) + ".a.b",
    "header dotted": "eyJ" * (MILLION // 3) + ".a.b",
    "dots": "eyJhbGciOi." * (MILLION // 11),
    "base64": base64.b64encode(BYTES).decode(),
    "url-safe": base64.urlsafe_b64encode(BYTES).decode(),
    "openssh": "b3BlbnNzaC1rZXktdjE" * (MILLION // 19),
    "openssh with lengths": "b3BlbnNzaC1rZXktdjEAAAAA" * (MILLION // 24),
    "openssh hex": "6f70656e7373682d6b65792d763100" * (MILLION // 30),
    "der hex": "30" * (MILLION // 2),
    "hex": BYTES[: MILLION // 2].hex(),
}
LIMIT = 10.0  # seconds; before, most of these did not end


@pytest.mark.parametrize("shape", SHAPES)
def test_secrets(shape):
    start = time.process_time()
    found = op5_secrets.spans(SHAPES[shape])
    assert time.process_time() - start < LIMIT
    assert {k for k, _, _ in found} <= {"hex"}


def test_a_secret_at_the_end_of_a_long_text():
    header = base64.urlsafe_b64encode(b'{"alg":"HS256","kid":"' + b"x" * 3000 + b'"}').decode().rstrip("=")
    token = header + "." + base64.urlsafe_b64encode(b'{"a":1}').decode().rstrip("=") + ".c2ln"
    text = SHAPES["ey"] + " " + token
    assert ("token", len(SHAPES["ey"]) + 1, len(text)) in op5_secrets.spans(text)


@pytest.mark.parametrize("text", ["a" + " " * MILLION, "\t" * MILLION + "x", "日" + "\u3000" * MILLION, " \n" * 500_000 + "a b"])
def test_token_counts(text):
    path = public_tokenizers.path(op6_token_counts.TOKENIZER)
    counter = op6_token_counts.PrefixCounter(path)
    start = time.process_time()
    counts = counter.prefix_counts(text)
    assert time.process_time() - start < LIMIT
    short = text[:2000]
    library = tokenizers.Tokenizer.from_file(path)
    assert counts[2000] == counter.prefix_counts(short)[-1] == len(library.encode(short, add_special_tokens=False).ids)
