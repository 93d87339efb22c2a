"""Archives: writer, byte-range reader, revisits."""

import glob
import gzip
import hashlib
import os

import pytest

from driftline.llm import op1_warc as warc
from driftline.session import scratch_path

SCHEMA = "page_id long, url string, html string, first string, digest int"


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def expected(rows, least=100):
    out = []
    for page, _, html, *_ in rows:
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if len((html or "").encode()) >= least and same else None
        sole = sum((h or "") == (html or "") for _, _, h, *_ in rows) == 1
        refers = None if first is None or first == page or sole else first
        kind = "response" if refers is None else "revisit"
        out.append((page, len((html or "").encode()), digest(html), kind, refers))
    return sorted(out, key=str)


def got(records):
    rows = records.collect()
    return sorted(
        (
            (
                r.page_id,
                r.payload_bytes,
                r.stated_digest if r.payload is None else hashlib.sha256(bytes(r.payload)).hexdigest(),
                r.record_type,
                r.refers_to,
            )
            for r in rows
        ),
        key=str,
    )


ROWS = [
    (5, "http://a/ x\r\ny", "é" * 60, "x", 1),
    (3, None, "é" * 60, "x", 1),
    (9, "u", "é" * 60, None, None),
    (9, "u", "é" * 60, None, None),
    (3, "again", "é" * 60, None, None),
    (None, "u", "é" * 60, None, None),
    (None, "u", "only without an id " * 9, None, None),
    (None, "u", "only without an id " * 9, None, None),
    (10, "u", "short", None, None),
    (11, "u", "short", None, None),
    (12, "u", None, None, None),
    (13, "u", "", None, None),
    (14, "u", "WARC/1.1\r\n\r\n\x1f\u008b\x08" * 40, None, None),
    (15, "u", "".join(chr(97 + i * i % 26) for i in range(300_000)), None, None),
    (-7, "u", "x" * 100, None, None),
    (16, "u", "x" * 99, None, None),
    (17, "u", "x" * 100, None, None),
]


@pytest.mark.parametrize("split", [97, 1000, 1 << 22])
def test_round_trip_with_any_split(spark, split):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(2), path)
    records = warc.read_archives(spark, path, split)
    assert got(records) == expected(ROWS)
    assert records.where("error is not null").count() == 0


def test_files_are_plain_gzip_and_damage_is_reported(spark, tmp_path):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path)
    (name,) = [f for f in glob.glob(path.removeprefix("file:") + "/part-*")]
    with open(name, "rb") as file:
        data = file.read()
    assert gzip.decompress(data).count(b"WARC-Record-ID") == len(ROWS)
    at = data.rindex(b"\x1f\x8b\x08", 0, len(data) - 40)
    broken = bytearray(data)
    broken[at + 120] ^= 0xFF  # inside the last record's compressed data
    os.makedirs(tmp_path / "broken")
    (tmp_path / "broken" / "a.warc.gz").write_bytes(bytes(broken) + data)
    found = warc.read_archives(spark, str(tmp_path / "broken"))
    assert found.where("record_type is not null").count() in (2 * len(ROWS) - 1, 2 * len(ROWS))


def test_random_bytes_hold_no_records(spark, tmp_path):
    (tmp_path / "junk.gz").write_bytes((b"\x1f\x8b\x08\x00" + os.urandom(50)) * 200)
    assert warc.read_archives(spark, str(tmp_path), 100).count() == 0


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0
