"""Registered queries: SQL where there is some, the pipeline stage by stage, and the guard."""

import os
import subprocess
import sys

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from driftline.llm import op2_sentencepiece, op5_secrets, queries
from driftline.llm.op4_mixture import mix
from driftline.llm.op9_quality_rules import quality
from driftline.llm.op10_jaccard_join import component_table
from driftline.session import materialise

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    result = con.execute(queries.all_oracles()[name])
    names = [c[0] for c in result.description]
    got = queries.all_queries()[name](spark, small).select(*names)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, result.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.all_queries()) == list(range(1, 14))


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "secrets", "mixture", "sentencepiece"]
    after = {"start": docs}
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        last = after[name] = materialise(stage(spark, last, small), name)
        assert name == names[-1] or last.columns == docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(after["quality_rules"]) == ids(quality(docs).where("kept"))
    joined = component_table(after["quality_rules"], width=5, p=4, q=5).where("doc_id = component_id")
    assert ids(after["jaccard_join"]) == ids(joined)
    before = {r.doc_id: r.text for r in after["jaccard_join"].collect()}
    for r in after["secrets"].collect():
        assert r.text == op5_secrets.masked(before[r.doc_id]) and r.n_chars == len(r.text)
    copies = {r.doc_id: r.copies for r in mix(after["secrets"])[0].collect()}
    assert ids(after["mixture"]) == sorted(i for i, n in copies.items() for _ in range(n))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op2_sentencepiece.MODEL))
    texts = {r.doc_id: r.text for r in after["mixture"].collect()}
    got = last.collect()
    assert len(got) == after["mixture"].count()
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_eos=True)) for r in got)
    assert corpus_pipeline.run(spark, small).count() == len(got)


def test_pipeline_with_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, copies int, _row int"
    good = " ".join(f"word{i} and some" for i in range(40))
    rows = [(1, good, "en", "a", 1, "x", 1, 1), (1, good, "en", "a", 1, "x", 1, 1), (None, good + " x", None, None, None, None, None, None),
            (2, None, None, None, 0, "", 0, 0), (3, "", "en", "b", 0, "", 0, 0)]
    for data in (rows, []):
        last = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            last = materialise(stage(spark, last, ""), name)
            assert name == "sentencepiece" or [f for f in last.columns] == schema.replace(",", "").split()[::2]
        assert last.count() > 0 if data else last.count() == 0


def test_rest_works_without_the_package(tmp_path):
    for name in ("__spark_entry__.py", "check_oracle.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "driftline")
    for name in os.listdir(f"{ROOT}/driftline"):
        if name != "llm":
            os.symlink(f"{ROOT}/driftline/{name}", tmp_path / "driftline" / name)
    code = (
        f"import runpy; e = runpy.run_path({str(tmp_path / '__spark_entry__.py')!r}); q = e['queries'](); "
        "assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e['oracle_sql']()) <= set(q)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
