"""Jobs that are run again: after success they change nothing, after a failure they finish."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_checks import SPEC, table

from driftline.operators import models as ml
from driftline.operators.decisions import settle_outbox
from driftline.operators.history import current_aliases, resolve_champions, seconds_since_dispatch
from driftline.plans import monitor as m
from driftline.plans.checks import ReferenceBundle, build_bundle, drift_report, load_bundle
from driftline.session import drop_paths, materialise, recorded_paths
from driftline.sources import sinks

NOW = datetime(2024, 2, 1)


def test_alias_moves_back_and_away(spark, tmp_path):
    path = str(tmp_path / "aliases")
    for version, event in ((1, "a"), (3, "b"), (2, "back"), (3, "b")):  # the last is a retry of the second
        sinks.move_alias(spark, path, "m", "champion", version, event)
    sinks.move_alias(spark, path, "other", "champion", 9, "a")
    moves = sinks.stored(spark, path, sinks.MOVES)
    assert moves.where("model = 'm'").count() == 3
    assert {(r.model, r.version) for r in current_aliases(moves).collect()} == {("m", "2"), ("other", "9")}
    registry = spark.createDataFrame([("m", str(v), None) for v in (1, 2, 3, 10)] + [("other", "1", None)], "model string, version string, alias string")
    found = {r.model: r.uri for r in resolve_champions(registry, moves).collect()}
    # The other model's alias names a version that was never registered.
    assert found == {"m": "models:/m@champion (v2)", "other": "models:/other/1"}
    sinks.move_alias(spark, path, "m", "champion", None, "gone")
    assert resolve_champions(registry, sinks.stored(spark, path, sinks.MOVES)).where("model = 'm'").first().uri == "models:/m/10"
    assert current_aliases(sinks.stored(spark, str(tmp_path / "none"), sinks.MOVES)).count() == 0


def test_outbox(spark):
    audits = spark.createDataFrame(
        [(1, "dispatched", "204"), (2, "dispatched", "204"), (3, "dispatched", "204"), (4, "blocked", "off"), (5, "dry_run", "x"), (6, "dispatched", "204")],
        "id long, decision string, detail string",
    ).withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))"))
    results = [(1, 1, 500), (1, 2, 204), (1, 2, 204), (1, 3, 503), (2, 1, 500), (2, 2, 422), (3, 1, None), (4, 1, 204), (9, 1, 204), (None, 1, 204)]
    settled = settle_outbox(audits, spark.createDataFrame(results, "id long, attempt int, status int"))
    got = {r.id: (r.decision, r.detail) for r in settled.collect()}
    assert got == {
        1: ("dispatched", "204"), 2: ("blocked", "status 422"), 3: ("blocked", "dispatch error"), 4: ("blocked", "off"), 5: ("dry_run", "x"), 6: ("pending", None),
    }
    # A failed dispatch does not hold the next request back, a pending one does.
    since = lambda ids: seconds_since_dispatch(settled.where(F.col("id").isin(ids)), F.lit(NOW)).first().seconds_since
    assert since([2, 3, 4]) is None and since([6]) is not None
    assert settle_outbox(audits, spark.createDataFrame([], "id long, attempt int, status int")).where("decision = 'pending'").count() == 4


def test_requests_and_verdicts_twice(spark, tmp_path):
    tables = m.MonitorTables(str(tmp_path))
    report = spark.createDataFrame([("m", 0.4, 0.12)], "model string, psi_max double, perf_drop double")
    for _ in range(2):
        audits = spark.read.parquet(tables.audits) if _ else None
        assert m.request_retrain(report, "drift", audits, tables, NOW).first()["decision"] == "dispatched"
    assert m.request_retrain(report, "drift", spark.read.parquet(tables.audits), tables, NOW + timedelta(minutes=1)).first()["decision"] == "blocked"
    assert spark.read.parquet(tables.audits).count() == 2
    said = '{"diagnosis": "%s", "recommendations": [], "trigger_retraining": true}'
    for name, ids in (("one", "ab"), ("two", "b")):
        texts = spark.createDataFrame([(i, said % name) for i in ids], "id string, text string")
        m.record_verdicts(texts, "id", "text", tables)
    assert {(r.drift_check_id, r.diagnosis) for r in spark.read.parquet(tables.verdicts).collect()} == {("a", "one"), ("b", "two")}


STEPS = [(ml, "save_model"), (ReferenceBundle, "save"), (sinks, "save_reference"), (sinks, "move_alias"), (sinks, "register_version")]


@pytest.fixture(scope="module")
def trained(spark):
    training = table(spark, 600, 0).cache()
    return training, ml.train(training, ["a", "b"], "label", "id", trees=2)


@pytest.mark.parametrize("where, name", STEPS, ids=[n for _, n in STEPS])
@pytest.mark.parametrize("after", [False, True], ids=["before", "after"])
def test_publishing_fails_and_is_run_again(spark, trained, tmp_path, monkeypatch, where, name, after):
    training, model = trained
    tables = m.MonitorTables(str(tmp_path))
    publish = lambda: m.keep_version(spark, training, model, "label", "id", tables, "churn", 1, segment="seg")
    step = getattr(where, name)

    def broken(*args, **options):
        if after:
            step(*args, **options)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(where, name, broken)
        with pytest.raises(RuntimeError, match="lost"):
            publish()
    assert sinks.is_registered(spark, tables.registry, "churn", 1) == (after and name == "register_version")
    publish()
    publish()
    bundle = load_bundle(spark, f"{tables.root}/models/churn/v=1/reference")
    assert bundle.baseline[1] == 600 and bundle.counts.where("feature = 'a'").agg(F.sum("n_ref")).first()[0] == 600
    assert ml.load_model(spark, f"{tables.root}/models/churn/v=1").features == model.features
    assert spark.read.parquet(tables.registry).count() == 1 and spark.read.parquet(tables.aliases).count() == 1
    assert spark.read.parquet(f"{tables.root}/reference/churn/v=1").count() == 600


def test_a_bundle_without_the_segment_is_refused_by_name(spark):
    scored = table(spark, 400, 0)
    spec = SPEC.__class__(**{**SPEC.__dict__, "segment": None})
    bundle = build_bundle(scored, spec)
    with pytest.raises(ValueError, match="seg"):
        drift_report(None, table(spark, 400, 1), SPEC.__class__(**{**SPEC.__dict__, "segment": "seg"}), bundle=bundle)


def test_recorded_tables_can_be_dropped(spark):
    with recorded_paths() as paths:
        kept = materialise(spark.range(3), "recorded")
    assert len(paths) == 1 and kept.count() == 3
    path = paths[0]
    drop_paths(spark, paths)
    assert paths == [] and sinks.stored(spark, path, "id long").count() == 0
