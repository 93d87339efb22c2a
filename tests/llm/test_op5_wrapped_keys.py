"""Keys in escaped, indented, URL-safe, repeated and hexadecimal form, and tokens before a word."""

import base64
import json
import os
import textwrap

import pytest

from driftline.llm import op5_secrets as sec
from test_op5_secrets import EC, ED25519, LOCKED, OPENSSH, PUBLIC, RSA, part, wrapped

KEYS = [RSA, ED25519, EC, LOCKED, OPENSSH]


def of_kind(text, kind):
    return [text[a:b] for k, a, b in sec.spans(text) if k == kind]


def pem(key):
    return f"-----BEGIN PRIVATE KEY-----\n{wrapped(key)}\n-----END PRIVATE KEY-----\n"


@pytest.mark.parametrize("key", KEYS)
def test_escaped_and_indented(key):
    body = wrapped(key)
    for escape in ("\\n", "\\r\\n", "\\\\n"):
        want = body.replace("\n", escape)
        assert of_kind("x " + pem(key).replace("\n", escape), "key") == [want]
    assert of_kind(json.dumps({"private_key": pem(key)}), "key") == [body.replace("\n", "\\n")]
    for blanks in ("    ", "\t"):
        got = of_kind("key: |\n" + textwrap.indent(pem(key), blanks), "key")
        assert got == [textwrap.indent(body, blanks).lstrip()]


@pytest.mark.parametrize("key", KEYS)
def test_encoded_again(key):
    once = base64.b64encode(pem(key).encode()).decode()
    assert of_kind(f"tls.key: {once}\n", "key") == [once]
    lines = "\n  ".join(textwrap.wrap(once, 76))
    assert of_kind(f"tls.key: |\n  {lines}\nnext: 1", "key") == [lines]
    assert of_kind("k " + pem(key).encode().hex(), "hexkey")
    safe = base64.urlsafe_b64encode(key).decode()
    assert of_kind(f"k={safe} x", "key") == [safe]


@pytest.mark.parametrize("key", KEYS)
def test_hexadecimal(key):
    assert ("hexkey", 2, 2 + 2 * len(key)) in sec.spans(f"k {key.hex()} x")
    lines = "\n  ".join(textwrap.wrap(key.hex(), 60))
    assert of_kind(f"k\n  {lines}\n", "hexkey") == [lines]


@pytest.mark.parametrize("key", [PUBLIC, RSA[:-1], OPENSSH[:-8], os.urandom(300)])
def test_still_no_private_key(key):
    for text in (json.dumps(pem(key)), base64.b64encode(pem(key).encode()).decode(), key.hex(), part(key)):
        assert not [s for s in sec.spans(text) if s[0] in ("key", "hexkey")]


def test_token_before_a_word():
    head, claims, sign = part(b'{"alg":"HS256"}'), part(b'{"sub":1}'), part(os.urandom(32))
    good = f"{head}.{claims}.{sign}"
    for text in (f"{good}.Then", f"{good}.a.b", f'"a\\n{good}"', f"jwt_{good}"):
        assert of_kind(text, "token") == [good]
