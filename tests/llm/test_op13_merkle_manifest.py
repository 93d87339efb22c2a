"""The Merkle manifest against a plain recursive one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import op13_merkle_manifest as merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, i int, digest string, path string, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(digests, fanout):
    """(root, [steps of each digest]), a step being (left, right)."""
    steps, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, at in enumerate(place):
            run = digests[at - at % fanout : at - at % fanout + fanout]
            steps[k].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
            place[k] = at // fanout
        digests = [h(*digests[s : s + fanout]) for s in range(0, len(digests), fanout)]
    return digests[0], steps


def brute(rows, fanout):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, inner = [], []
    for source in order:
        members = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, steps = climb([leaf(r) for r in members], fanout)
        roots.append(root)
        inner.append(list(zip(members, steps, strict=True)))
    top, upper = climb(roots, fanout)
    out = []
    for root, group, above in zip(roots, inner, upper, strict=True):
        for row, steps in group:
            out.append((row[0], leaf(row), root, top, tuple(steps + above)))
    return sorted(out, key=str)


def rows_of(number, sources):
    out = [(k, f"s{k % sources}", "en", k, f"Text {k} Ä", 1, 2, "d", "p", 3) for k in range(number)]
    return out


ODD = [
    (None, None, None, None, None, 0, 0, "", "", 0),
    (None, "", None, None, "", 0, 0, "", "", 0),
    (7, "", "x", 1, "Long " * 200_000, 0, 0, "", "", 0),
    *[(9, "ß", "x", 1, "Same", 0, 0, "", "", 0)] * 40,
    (9, "ß", "x", 1, "Other", 0, 0, "", "", 0),
    (-3, "Z", "x", 1, "NUL \x00 and 日本", 0, 0, "", "", 0),
]


@pytest.mark.parametrize("fanout, rows", [(2, rows_of(37, 3)), (16, rows_of(300, 1) + rows_of(20, 18) + ODD), (16, ODD[:1])])
def test_against_a_plain_tree(spark, fanout, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = merkle.manifest(df, fanout=fanout).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in found]
    assert sorted(got, key=str) == brute(rows, fanout)
    assert all(r.folded_root == r.root for r in found)


def test_a_changed_row_is_found(spark):
    rows = rows_of(50, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    values = [F.lit("changed") if c == "text" else F.col(c) for c in merkle.FIELDS]
    found = merkle.manifest(df, tampered=F.when(F.col("doc_id") == 11, merkle.row_digest(values)))
    assert {r.doc_id for r in found.collect() if r.folded_root != r.root} == {11}
    assert merkle.manifest(df.limit(0)).count() == 0


def test_query_lowers_every_fifth(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = merkle.op13_merkle_manifest(spark, small).collect()
    assert len(found) == len(docs)
    for r in found:
        text = docs[r.doc_id].text
        changes = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert r.verified == (not changes)
