"""State of long streams: day parts, unmatched labels, cooldown in event time."""

from datetime import datetime, timedelta

import brute
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.streaming import common
from driftline.streaming.cooldown import cooldown_in_event_time, open_decisions, read_decisions
from driftline.streaming.day_parts import DayParts, newest_wins
from driftline.streaming.label_f1 import labelled_predictions, scores_by_day, write_labelled
from driftline.streaming.window_psi import read_running, write_running

BASE = datetime(2024, 1, 1)
ROW = "id bigint, ts timestamp_ntz"


def test_parts_of_a_day_do_not_add_up(spark, tmp_path):
    table = DayParts(str(tmp_path), fan_in=3)
    most = 0
    for batch in range(20):
        rows = [(batch * 10 + k, BASE + timedelta(hours=4 * batch)) for k in range(2)] + [(batch * 10 + 9, None)]
        table.add(spark.createDataFrame(rows, ROW).coalesce(1), F.to_date("ts"), batch)
        most = max(most, len(table.pieces(spark, 1)))
    got = sorted(r.id for r in table.read(spark).collect())
    assert got == sorted(b * 10 + k for b in range(20) for k in (0, 1, 9))
    assert most <= 8  # two days, each two parts on two levels, and none of other days
    by_day = {}
    for day, part in table.pieces(spark):
        by_day.setdefault(day, []).append(part)
    assert all(len(by_day[str((BASE + timedelta(days=d)).date())]) == 1 for d in range(2))
    newest = {r.ts.date() for r in table.read(spark, 1).collect()}
    assert newest == {(BASE + timedelta(hours=76)).date(), (BASE + timedelta(hours=76)).date() - timedelta(days=1)}
    assert len(list((tmp_path / "lists").iterdir())) <= 2
    live = {f"part_name={p}" for _, p in table.pieces(spark)}
    kept = {p.name for p in (tmp_path / "parts").iterdir() if any(p.rglob("*.parquet"))}
    assert len(kept - live) <= 6  # what the list before the newest one still needs


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    table = DayParts(str(tmp_path), fan_in=2)
    for batch in range(5):
        for _ in range(2):
            table.add(spark.createDataFrame([(batch, BASE)], ROW), F.to_date("ts"), batch)
    assert sorted(r.id for r in table.read(spark).collect()) == list(range(5))
    table.add(spark.createDataFrame([], ROW), F.to_date("ts"), 5)
    assert table.read(spark).count() == 5
    fresh = DayParts(str(tmp_path / "other"))
    fresh.add(spark.createDataFrame([], ROW), F.to_date("ts"), 0)
    assert fresh.read(spark).columns == ["id", "ts"] and fresh.read(spark).count() == 0


def test_running_values_keep_the_newest(spark, tmp_path):
    table = DayParts(str(tmp_path), newest_wins(["k"], "n"), fan_in=2)
    for batch in range(6):
        rows = [("all", batch), (f"own {batch}", batch)]
        table.add(spark.createDataFrame(rows, "k string, n bigint"), F.lit("2024-01-01").cast("date"), batch)
    assert {r.k: r.n for r in table.read(spark).collect()} == {"all": 5} | {f"own {b}": b for b in range(6)}


def test_scores_without_a_label_are_given_up(spark, tmp_path):
    n = 600
    scores = [(i, BASE + timedelta(minutes=10 * i), 0.5) for i in range(n)]
    labels = [(i, BASE + timedelta(minutes=10 * i + 30), 1) for i in range(n) if i % 3]
    s_ddl, l_ddl = "id bigint, ts timestamp_ntz, score double", "id bigint, label_ts timestamp_ntz, label int"
    for part in (slice(0, n // 2), slice(n // 2, n)):
        spark.createDataFrame(scores[part], s_ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    for low, high in ((0, n // 2), (n // 2, n)):
        mine = [x for x in labels if low <= x[0] < high]
        spark.createDataFrame(mine, l_ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    own = common.stateful_session(spark, 2)
    s = common.event_stream(own, str(tmp_path / "s"), "*.parquet", T.StructType.fromDDL(s_ddl), "ts")
    lab = common.event_stream(own, str(tmp_path / "l"), "*.parquet", T.StructType.fromDDL(l_ddl), "label_ts")
    joined = labelled_predictions(s, lab, "id", "24 HOURS", "1 hour", unmatched=True)
    write_labelled(joined, str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.id for r in rows if r.label is not None} == {i for i in range(n) if i % 3}
    given_up = [r.id for r in rows if r.label is None]
    assert len(given_up) == len(set(given_up))
    # The watermark is an hour before the newest time of the stream that is behind; a label may take a day.
    sure = {i for i in range(n) if i % 3 == 0 and 10 * i < 10 * (n - 1) - 60 - 24 * 60 - 60}
    assert sure <= set(given_up) <= {i for i in range(n) if i % 3 == 0}
    write_running(scores_by_day(s, "1 hour"), ["day"], "n_samples", "day", str(tmp_path / "n"), str(tmp_path / "n-state"))
    days = {r.day: r.n_samples for r in read_running(spark, ["day"], "n_samples", str(tmp_path / "n")).collect()}
    assert days == {BASE.date() + timedelta(days=d): min(144, n - 144 * d) for d in range(5)}


def test_event_time_decisions_do_not_depend_on_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    times = {0: rng.integers(0, 40 * 60, 120), 1: rng.integers(0, 40 * 60, 15)}
    rows = [(m, 1000 * m + i, int(t)) for m, ts in times.items() for i, t in enumerate(ts)]
    # Arrival is shuffled by less than the lateness of two hours.
    rows = sorted(rows, key=lambda r: r[2] + rng.integers(0, 115))
    ddl = "model bigint, id bigint, ts timestamp_ntz"
    too_late = [(0, 5000, 1), (1, 5001, 2)]
    arrivals = [rows[:30], rows[30:60], rows[60:100], rows[100:] + too_late, [(7, 6000, None)]]
    own, log, out = common.stateful_session(spark, 2), str(tmp_path / "log"), str(tmp_path / "out")
    for part in arrivals:
        made = [(m, i, None if t is None else BASE + timedelta(minutes=t)) for m, i, t in part]
        spark.createDataFrame(made, ddl).coalesce(1).write.mode("append").parquet(log)
        stream = common.event_stream(own, log, "*.parquet", T.StructType.fromDDL(ddl), "ts")
        common.run_available(cooldown_in_event_time(stream, 90, 120, out).option("checkpointLocation", str(tmp_path / "state")))
    decided = read_decisions(spark, out).select("model", "id", "ts", "dispatched")
    waiting = open_decisions(spark, out, 90).select("model", "id", "ts", "dispatched")
    assert 0 < waiting.count() < 40
    got = decided.unionByName(waiting).collect()
    assert sorted(r.id for r in got) == sorted(i for _, i, _ in rows)
    for model, ts in times.items():
        sent = {int((r.ts - BASE).total_seconds()) // 60 for r in got if r.model == model and r.dispatched}
        assert sent == brute.greedy(sorted(ts.tolist()), 90)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/late").collect()) == [5000, 5001, 6000]
    assert len(list((tmp_path / "out" / "open").glob("batch=*"))) <= 2


def test_state_is_stored_by_its_changes(spark):
    """A write to the state costs no look-up to count its rows, and a batch stores changes, not whole files."""
    own = common.stateful_session(spark, 3)
    prefix = "spark.sql.streaming.stateStore.rocksdb"
    assert own.conf.get(f"{prefix}.trackTotalNumberOfRows") == "false"
    assert own.conf.get(f"{prefix}.changelogCheckpointing.enabled") == "true"
    assert spark.conf.get(f"{prefix}.trackTotalNumberOfRows", "unset") != "false"
