"""Secrets in texts: three pattern kinds, and keys and tokens that are confirmed by structure.

A base64 or hexadecimal run is reported only if its decoded bytes are a private key: the nested
lengths of its DER encoding must fill each other exactly and have the fields of PKCS#1, PKCS#8,
SEC 1, DSA or an encrypted PKCS#8 key, or the length-prefixed fields of an OpenSSH key must add
up. Runs may have line ends, real or escaped, and indentation, base64 may be the URL-safe one, and a
run whose bytes are a text is searched once more. A dotted token is reported only if its header decodes to a JSON object with an algorithm, and
its claims (or, for encrypted tokens, the header's `enc`) fit that form.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm.common import map_rows, read_table, tidy

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key", "hexkey")
RANK = {k: i for i, k in enumerate(KINDS)}
MASK = "[secret]"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
# A run of at least so many characters, starting at the first of them, is the same as every
# longest run with the short ones left out.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# A run with two dots at least; it is tried once, from its beginning, and nothing of it is given back.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]*+){2,}+")
HEADER = re.compile(r"e[wy]")
AFTER_BRACE = frozenset(b' \t\r\n"}')
HEAD_CHARS = 256  # of a header are looked at first, then four times as many as before
# Line ends as they are or escaped (also twice), and the indentation of the next line.
BREAK = r"(?:\r?\n|(?:\\{1,2}r)?\\{1,2}n)[\x20\t]*"
DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
BREAKS = re.compile(BREAK)
# DER keys begin with byte 0x30, in base64 M and one of A to P; OpenSSH keys with their magic.
KEY = re.compile(r"(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{14}")
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{BREAK}[A-Za-z0-9+/_-]+)*")
HEXRUN = re.compile(rf"[0-9A-Fa-f]{{40,}}(?:{BREAK}[0-9A-Fa-f]+)*")
HEXDIGITS = re.compile(r"[0-9A-Fa-f]+")
HEXSTART = re.compile(r"(?=30|6f70656e7373682d6b65792d763100)")
PEM_END = re.compile(r"\s*-----END [A-Z0-9 ]*-----\s?")
PEM_BASE64 = "LS0tLS1CRUdJTi"
TEXT_BYTES = frozenset([9, 10, 13, *range(32, 127)])
STANDARD = str.maketrans("-_", "+/")
DEPTH = 2  # decodings of a text inside a text
OPENSSH = b"openssh-key-v1\0"
# Object identifier prefixes (DER) of password-based encryption schemes.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content end) of the item whose tag is at `at`; None if malformed."""
    if at + 2 > len(data):
        return None
    first, at = data[at + 1], at + 2
    if first < 0x80:
        return at, at + first
    size = first & 0x7F
    if not 1 <= size <= 4 or at + size > len(data):
        return None
    length = int.from_bytes(data[at : at + size], "big")
    if length < 0x80 or data[at] == 0:  # DER asks for the shortest form
        return None
    return at + size, at + size + length


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of items that fill data exactly."""
    at, items = 0, []
    while at < len(data):
        found = der_length(data, at)
        if found is None or found[1] > len(data):
            return None
        items.append((data[at], data[found[0] : found[1]]))
        at = found[1]
    return items


def der_key(data: bytes) -> bool:
    """Whether data is exactly one private key in DER."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags == [0x30, 4]:
        scheme = der_items(items[0][1])
        return bool(scheme) and scheme[0][0] == 6 and scheme[0][1].startswith(ENCRYPTION) and bool(items[1][1])
    if tags[0] != 2:
        return False
    version = int.from_bytes(items[0][1], "big")
    if version == 0 and tags in ([2] * 9, [2] * 6):
        return all(len(c) for _, c in items)
    if version == 1 and tags == [2] * 9 + [0x30]:
        return True
    if version == 1 and tags[:2] == [2, 4] and set(tags[2:]) <= {0xA0, 0xA1}:
        return len(items[1][1]) >= 16 and all(der_items(c) for _, c in items[2:])
    if version in (0, 1) and tags[:3] == [2, 0x30, 4] and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        scheme = der_items(items[1][1])
        return bool(scheme) and scheme[0][0] == 6 and bool(der_items(items[2][1]))
    return False


def openssh_length(read: Callable[[int], bytes], most: int) -> int | None:
    """Bytes of the OpenSSH private key at the beginning of some data.

    read(n) gives at least n bytes of the data, or all; `most` is more than it can have. Lengths are
    looked at before what they measure is read, so most of what is no key is never decoded."""
    at = len(OPENSSH)

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">I", read(at), at - 4)[0]

    def field() -> int:
        nonlocal at
        size = number()
        at += size
        if at > most:
            raise struct.error
        return size

    try:
        cipher, kdf = field(), field()
        field()
        keys = number()
        if not 1 <= keys <= 16 or not cipher or not kdf:
            return None
        for _ in range(keys):
            if field() < 8:
                return None
        private = field()
    except struct.error:
        return None
    return at if private and private % 8 == 0 and len(read(at)) >= at else None


def gather(text: str, start: int, wanted: int) -> tuple[str, int]:
    """Up to `wanted` base64 digits from start on, over line breaks, and the place after the last."""
    kept, count, at = [], 0, start
    while count < wanted:
        line = DIGITS.match(text, at, at + wanted - count)
        if not line:
            break
        kept.append(line.group())
        count += len(kept[-1])
        end = at = line.end()
        if count < wanted:
            gap = BREAKS.match(text, at)
            if not gap or not DIGITS.match(text, gap.end(), gap.end() + 1):
                return "".join(kept).translate(STANDARD), end
            at = gap.end()
    return "".join(kept).translate(STANDARD), at


def decoded(digits: str) -> bytes:
    """The whole bytes that base64 digits without padding begin with."""
    spare = len(digits) % 4
    return base64.b64decode(digits[:-1] if spare == 1 else digits + "=" * (-spare % 4))


def reader(text: str, start: int) -> Callable[[int], bytes]:
    """The bytes of the base64 run from start on, decoded as far as they are asked for."""
    held = b""

    def read(wanted: int) -> bytes:
        nonlocal held
        if len(held) < wanted:
            held = decoded(gather(text, start, max(64, 2 * wanted) * 4 // 3 + 4)[0])
        return held

    return read


def confirm_key(text: str, start: int) -> int | None:
    """End of the base64 private key that begins at start, line breaks included."""
    if text.startswith("b3BlbnNzaC1rZXktdjE", start):
        size = openssh_length(reader(text, start), len(text) - start)
    else:
        found = der_length(decoded(gather(text, start, 8)[0]), 0)
        size = found and found[1]
    if not size:
        return None
    # So many base64 characters hold the key; the rest of the run is not part of it.
    wanted = -(-size * 4 // 3)
    if wanted > len(text) - start:
        return None
    digits, at = gather(text, start, wanted)
    if len(digits) < wanted:
        return None
    padding = -wanted % 4
    if text[at : at + padding] == "=" * padding:
        at += padding
    data = decoded(digits)[:size]
    return at if data.startswith(OPENSSH) or der_key(data) else None


def key_spans(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """Private keys in base64 or hexadecimal, and runs that hold a text with such a key."""
    found, done = [], 0
    m = KEY.search(text)
    while m:
        end = confirm_key(text, m.start())
        if end:
            found.append(("key", m.start(), end))
        m = KEY.search(text, end or m.start() + 1)
    for m in HEXRUN.finditer(text):
        found += hex_keys(text, m, depth)
    if depth:
        for m in RUN.finditer(text):
            begin = m.start()
            inner = m.group().find(PEM_BASE64)
            for start in dict.fromkeys((begin, begin + inner if inner >= 0 else begin)):
                if start >= done and (end := text_with_key(text, start, depth)):
                    found.append(("key", start, end))
                    done = end
    return found


def last_of_key(data: bytes, depth: int) -> int:
    """Where the last key of a decoded text ends, its closing PEM line included; 0 without a key."""
    if not TEXT_BYTES.issuperset(data[:30]):
        return 0
    inside = data.decode("latin-1")
    last = max((end for _, _, end in key_spans(inside, depth - 1)), default=0)
    closing = PEM_END.match(inside, last) if last else None
    return closing.end() if closing else last


def text_with_key(text: str, start: int, depth: int) -> int | None:
    """End of the base64 run from start on, as far as its text holds a private key."""
    if not TEXT_BYTES.issuperset(decoded(gather(text, start, 40)[0])):
        return None
    last = last_of_key(decoded(gather(text, start, len(text))[0]), depth)
    if not last:
        return None
    wanted = -(-last * 4 // 3)
    at = gather(text, start, wanted)[1]
    padding = -wanted % 4
    return at + padding if text[at : at + padding] == "=" * padding else at


def hex_keys(text: str, m: re.Match, depth: int) -> list[tuple[str, int, int]]:
    """Private keys, and texts that hold one, in a run of hexadecimal lines."""
    digits, places, at = [], [], m.start()
    while at < m.end():
        line = HEXDIGITS.match(text, at, m.end())
        digits.append(line.group())
        places.append(np.arange(at, line.end()))
        gap = BREAKS.match(text, line.end(), m.end())
        at = gap.end() if gap else m.end()
    run, place = "".join(digits).lower(), np.concatenate(places)
    # A key may begin at an even or at an odd digit.
    both = [bytes.fromhex(run[odd : odd + (len(run) - odd) // 2 * 2]) for odd in (0, 1)]
    found, done = [], 0
    for start in (x.start() for x in HEXSTART.finditer(run)):
        if start < done:
            continue
        data, begin = both[start % 2], start // 2
        if run.startswith("30", start):
            size = (der_length(data[begin : begin + 6], 0) or (0, 0))[1]
            good = 20 <= size <= len(data) - begin and der_key(data[begin : begin + size])
        else:
            size = openssh_length(lambda n: data[begin : begin + n], len(data) - begin)  # noqa: B023
            good = bool(size)
        if good:
            done = start + 2 * size
            found.append(("hexkey", int(place[start]), int(place[done - 1]) + 1))
    if not found and depth:
        last = last_of_key(both[0], depth)
        if last:
            found.append(("hexkey", int(place[0]), int(place[2 * last - 1]) + 1))
    return found


def json_part(text: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def may_be_header(part: str, start: int) -> bool:
    """False if the base64 text of part[start:] does not begin like a JSON object.

    A growing beginning is parsed: most of what is no header fails within its first bytes."""
    wanted = 4
    while True:
        end = min(len(part), start + wanted)
        data = decoded(part[start:end].translate(STANDARD))
        if data[:1] != b"{" or data[1:2] and data[1] not in AFTER_BRACE:
            return False
        if end == len(part):
            return True
        if wanted > 4:
            try:
                json.loads(data.decode("utf-8", "strict"))
                return False  # an object that ends before the part does
            except json.JSONDecodeError as error:
                # An error at the very end, or in a string that goes on, may be mended by what follows.
                if error.pos < len(error.doc) - 8 and not error.msg.startswith(("Unterminated", "Invalid \\")):
                    return False
            except UnicodeDecodeError as error:
                if error.start < len(data) - 4:
                    return False
            except RecursionError:
                return False
        wanted = max(HEAD_CHARS, 4 * wanted)


def confirm_token(text: str) -> bool:
    """Whether a dotted run is a signed or encrypted token."""
    parts = text.split(".")
    header = json_part(parts[0])
    if not header or not isinstance(header.get("alg"), str):
        return False
    if len(parts) == 3:
        unsigned = header["alg"].lower() == "none"
        return json_part(parts[1]) is not None and unsigned == (parts[2] == "")
    return len(parts) == 5 and isinstance(header.get("enc"), str) and all(parts[2:])


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed tokens. Every dotted run is cut at its dots once; a header is a part's end, of 12
    characters at least, with two more parts behind it."""
    found, done = [], 0
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for number, part in enumerate(parts[:-2]):
            for start in HEADER.finditer(part, max(0, done - at), max(0, len(part) - 10)):
                if not may_be_header(part, start.start()):
                    continue
                rest = [part[start.start() :], *parts[number + 1 : number + 5]]
                whole = ".".join(rest)
                # The full stop of a sentence, or a stop and a word, may follow a token, an empty
                # signature may end it.
                for token in dict.fromkeys((whole, whole.rstrip("."), ".".join(rest[:3]), ".".join([*rest[:2], ""]))):
                    if confirm_token(token):
                        done = at + start.start() + len(token)
                        found.append(("token", done - len(token), done))
                        break
                if found and done > at + start.start():
                    break
            at += len(part) + 1
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the order of KINDS."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += token_spans(text)
    found += key_spans(text)
    return sorted(found, key=lambda s: (s[1], RANK[s[0]], s[2]))


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and `secrets`, an array of (kind, start, end) in code points. Null text: none.

    Key is passed on as it is (null, repeated rows stay); other columns are ignored.
    """

    def make():
        def step(rows: Iterator[tuple]) -> Iterator[tuple]:
            for k, value in rows:
                yield k, [{"kind": a, "start": b, "end": c} for a, b, c in spans(value or "")]

        return step

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(df, [key, text], schema, make, lambda r: 64 + 48 * len(r[1]))


def masked(text: str) -> str:
    """The text with every stretch covered by spans replaced by MASK."""
    out, at = [], 0
    for _, start, end in spans(text):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def rewrite_text(df: DataFrame, change: Callable[[str], str], text: str = "text") -> DataFrame:
    """df with the text column changed; null stays null, all other columns stay as they are."""
    schema, at = df.schema, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                columns = batch.slice(start, 256).columns
                columns[at] = pa.array([None if t is None else change(t) for t in columns[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(tidy(run), schema)


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with secrets in its text replaced by MASK; no row is dropped."""
    return rewrite_text(df, masked, text)


def _joined(column) -> object:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(column, one), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets(): base kinds in base_sha256, all kinds in spans."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_secrets(read_table(spark, sf_dir, "documents")))


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
