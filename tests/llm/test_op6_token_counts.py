"""Token counts of every prefix against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftline.llm import op6_token_counts as tc

PATH = public_tokenizers.path(tc.TOKENIZER)
PARTS = ["'", "l", "ll", "'ll", "'ve", "'r", "re", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​",
         "é", "ß", "²", "¼", "東京", "😀", "a", "the", " the", "1", "23", "!", "<|endoftext|>", "<|endof", "|>", "_", "-", "—", "’s", "ª",
         "́", "ǅ", "\r\n", "٣", "Ⅷ", "\x00", "aaaaaaaaaaaa", "=====", "ационный"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tc.PrefixCounter(PATH)


def test_every_prefix(library, counter):
    draw = random.Random(8)
    for _ in range(400):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        wanted = [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        assert counter.prefix_counts(text).tolist() == wanted, text


def test_long_words(library, counter):
    draw = random.Random(9)
    for text in ("".join(draw.choice("ab") for _ in range(4000)), " " * 3000, "".join(map(chr, draw.choices(range(33, 0x2FFF), k=3000)))):
        assert counter.prefix_counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_longest_prefix_with_falling_counts():
    assert tc.longest_prefix(np.array([0, 1, 2, 3, 2, 3, 4]), 2) == 4
    assert tc.longest_prefix(np.array([0, 1]), 0) == 0


def test_frames(spark, library):
    texts = [None, "", "a<|endoftext|>b", "wörter " * 3000, "wörter " * 3000]
    df = spark.createDataFrame([(i % 3 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    wanted = []
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted.append((i % 3 or None, len((t or "").encode()), n, n > 100))
    found = tc.token_counts(df, PATH, 100)
    assert sorted(map(str, (tuple(r)[:4] for r in found.collect()))) == sorted(map(str, wanted))
    for r in found.where("over_limit").collect():
        text = texts[3]
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 100
        assert len(library.encode(text[: r.fit_chars + 1], add_special_tokens=False).ids) > 100
    tables = tc.prefix_tables(df, PATH).collect()
    assert {(r.n_tokens, int(np.frombuffer(r.counts, "<i4")[-1])) for r in tables} == {(w[2], w[2]) for w in wanted}
    assert tc.token_counts(df.limit(0), PATH, 100).count() == 0


def test_supplied_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in tc.op6_token_counts(spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (found[row.doc_id].n_tokens, found[row.doc_id].over_limit) == (n, n > 1024)
