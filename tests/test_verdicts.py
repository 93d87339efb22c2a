import hashlib
import json

import pytest

from driftline.operators.verdicts import brace_pairs, extract_verdicts

NESTED = {"diagnosis": "d", "recommendations": [{"action": "retrain", "priority": "high", "reason": "r"}], "trigger_retraining": True}


def first_match(text):
    """All balanced objects: a closing brace ends the newest one that is open."""
    open_at, pairs = [], []
    for place, ch in enumerate(text, 1):
        if ch == "{":
            open_at.append(place)
        elif ch == "}" and open_at:
            pairs.append((open_at.pop(), place))
    return sorted(pairs)


@pytest.mark.parametrize("text", ["{}", "a}{b{c}d}e{", "}}{{}}{", "{{{}", "né {日本 {x}} }", "{ { } } { { } }", "x" * 50 + "{" + "y" * 50])
def test_pairs_match_a_scan_from_every_brace(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert sorted((r["start"], r["end"]) for r in brace_pairs(df, "id", "t").collect()) == first_match(text)


def test_verdicts(spark):
    texts = {
        "plain": json.dumps(NESTED),
        "embedded": "thinking... " + json.dumps(NESTED) + " done {",
        "two": '{"note": {"a": 1}} then ' + json.dumps({"diagnosis": "second", "trigger_retraining": False}),
        "only_flag": '{"trigger_retraining": true}',
        "longest": '{"a": 1} {"b": 2, "c": 3} {"d": 4}',
        "null_key": '{"x": "longer than the other one"} {"diagnosis": null}',
        "broken": '{"diagnosis": oops}',
        "cut": '{"diagnosis": "a", }',
        "twice": '{"diagnosis": "a", "diagnosis": "b"}',
        "nan": '{"diagnosis": "x", "psi": NaN, "trigger_retraining": true}',
        "odd_type": '{"diagnosis": 5, "recommendations": "none"}',
        "none": "no braces here",
    }
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    got = {r["id"]: r for r in extract_verdicts(df, "id", "t").collect()}
    assert set(got) == {"plain", "embedded", "two", "only_flag", "longest", "null_key", "twice", "nan", "odd_type"}
    assert got["twice"]["diagnosis"] == "b" and got["nan"]["diagnosis"] == "x" and got["nan"]["trigger_retraining"]
    assert got["odd_type"]["diagnosis"] == "5" and got["odd_type"]["recommendations"] == []
    assert all(r["blob_md5"] == hashlib.md5(r["blob"].encode()).hexdigest() for r in got.values())
    for k in ("plain", "embedded"):
        assert got[k]["diagnosis"] == "d" and got[k]["trigger_retraining"]
        assert [r["action"] for r in got[k]["recommendations"]] == ["retrain"]
    assert got["two"]["diagnosis"] == "second" and got["two"]["recommendations"] == []
    assert got["only_flag"]["trigger_retraining"] and got["only_flag"]["diagnosis"] == ""
    assert got["longest"]["blob"] == '{"b": 2, "c": 3}'
    assert got["null_key"]["blob"] == '{"diagnosis": null}'
