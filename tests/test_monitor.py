"""Monitor: fixture rows L1–L4, chunked scans = single-chunk scans, stream = batch."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fumble.operators import monitor
from fumble.plans.queries_monitor import training_log
from fumble.streaming import monitor_stream

NAN = float("nan")


def _log(spark, rows):
    return spark.createDataFrame(rows, "run_id long, step long, metric string, value double")


def test_L1_spike_after_skipped_null(spark):
    rows = [(1, i, "loss", v) for i, v in enumerate([1.0, 2.0, 2.1, None, 4.3])]
    out = [(r.step, r.loss_spike_to) for r in monitor.loss_spikes(_log(spark, rows)).collect()]
    assert out == [(4, 4.3)]


def test_L2_nan_never_alerts(spark):
    rows = [(1, i, "loss", v) for i, v in enumerate([1.0, NAN, 5.0])]
    log = _log(spark, rows)
    assert monitor.loss_spikes(log).count() == 0
    assert monitor.invalid_values(log).count() == 1


def test_L3_new_best(spark):
    rows = [(1, i, "eval_reward/mean", v) for i, v in enumerate([0.5, 0.5, 0.7, NAN, 0.6])]
    best = monitor.running_best(monitor.evaluation_rewards(_log(spark, rows)))
    assert sorted(r.step for r in best.collect()) == [0, 2]


def test_L4_fallback_to_final_state(spark):
    rewards = spark.createDataFrame([(1, 50, 0.9), (1, 100, 0.1)], "run_id long, step long, reward double")
    ckpts = spark.createDataFrame([(1, 20), (1, 40), (1, 60)], "run_id long, step long")
    r = monitor.best_checkpoint(rewards, ckpts).first()
    assert r.best_step == 50 and r.source == "final training state" and r.path is None
    ckpts2 = spark.createDataFrame([(1, 50)], "run_id long, step long")
    r2 = monitor.best_checkpoint(rewards, ckpts2, "out").first()
    assert r2.source == "best checkpoint" and r2.path == "out/checkpoint-50"


def test_alternative_reward_name(spark):
    rows = [(1, 0, "eval_rewards/mean", 0.3), (1, 1, "eval_reward/mean", 0.2), (1, 2, "eval_rewards/mean", 0.4)]
    best = monitor.running_best(monitor.evaluation_rewards(_log(spark, rows)))
    assert sorted(r.step for r in best.collect()) == [0, 2]


@pytest.mark.parametrize("chunk", [7, 101, 1000])
def test_chunked_scans_equal_unchunked(spark, chunk):
    log = training_log(spark, SF01)
    big = 1 << 40

    def rows(df):
        return sorted(tuple(None if x != x else x for x in r) for r in df.collect())

    assert rows(monitor.loss_spikes(log, chunk_steps=chunk)) == rows(monitor.loss_spikes(log, chunk_steps=big))
    a, fa = monitor.error_counts(log, chunk_steps=chunk)
    b, fb = monitor.error_counts(log, chunk_steps=big)
    assert rows(a) == rows(b) and rows(fa) == rows(fb)
    rw = monitor.evaluation_rewards(log)
    assert rows(monitor.running_best(rw, chunk_steps=chunk)) == rows(monitor.running_best(rw, chunk_steps=big))


def same(x):
    return "nan" if x is not None and x != x else x


@pytest.mark.parametrize("chunk", [1, 2, 3, 1 << 40])
def test_nulls_at_chunk_edges(spark, chunk):
    log = _log(spark, [(1, 0, "loss", NAN), (1, 5, "loss", None), (1, 6, "loss", 1.0), (2, 0, "loss", None), (2, 3, "x", None)])
    running, final = monitor.error_counts(log, chunk_steps=chunk)
    assert sorted(tuple(r) for r in running.collect()) == [(1, 0, 1), (1, 5, 1), (1, 6, 1)]
    assert sorted(tuple(r) for r in final.collect()) == [(1, 1), (2, 0)]


def test_ties_at_one_step_have_an_order(spark):
    log = _log(spark, [(1, 0, "loss", 1.0), (1, 0, "loss", 4.0), (1, 1, "loss", 5.0), (1, 0, "eval_reward/mean", NAN), (1, 0, "eval_reward/mean", 0.5)])
    for chunk in (1, 1 << 40):
        assert [tuple(r) for r in monitor.loss_spikes(log, chunk_steps=chunk).collect()] == [(1, 0, 1.0, 4.0)]
    assert [tuple(r) for r in monitor.running_best(monitor.evaluation_rewards(log)).collect()] == [(1, 0, 0.5)]


SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"


def arriving(spark, tmp_path, batches, delay, forget=None):
    """Events of batches of rows (run, step, seconds, metric, value), a file a micro-batch."""
    src = str(tmp_path / "in")
    for rows in batches:
        df = spark.createDataFrame([(step, run, m, 1_700_000_000 + t, v) for run, step, t, m, v in rows], "event_id long, user_id long, event_type string, t long, value double")
        df.select("event_id", "user_id", "event_type", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(src)
    as_log = lambda ev: ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "ts", F.col("event_type").alias("metric"), "value")
    log = monitor_stream.events_log_stream(monitor_stream.stream_session(spark), src, SCHEMA, as_log, max_files=1)
    for name, events in (("ordered", monitor_stream.monitor_events(log, delay, forget)), ("invalid", monitor_stream.invalid_events(log))):
        monitor_stream.start(events, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "ordered")).collect()
    return sorted((r.run_id, r.step, r.kind, same(r.value_from), same(r.value)) for r in out), spark.read.parquet(str(tmp_path / "invalid"))


END = monitor_stream.END_OF_RUN


def test_stream_waits_for_rows_within_the_delay(spark, tmp_path):
    """Step 3 comes a micro-batch after step 4: no false spike from 1 to 3."""
    got, _ = arriving(spark, tmp_path, [[(7, 1, 0, "loss", 1.0), (7, 4, 3, "loss", 3.0)], [(7, 3, 2, "loss", 2.0), (7, 5, 100, "loss", 2.0)], [(7, 9, 101, END, None)]], 60)
    assert got == []


def test_stream_late_rows_are_kept_and_change_nothing(spark, tmp_path):
    got, invalid = arriving(spark, tmp_path, [[(7, 1, 0, "loss", 1.0), (7, 9, 500, "loss", 1.5)], [(7, 10, 900, "loss", 1.0)], [(7, 2, 1, "loss", 9.0), (7, 3, 2, "loss", NAN), (8, 1, 0, "loss", 1.0), (8, 2, 1, "loss", 5.0)],
                                              [(7, 99, 2000, END, None), (8, 99, 2000, END, None)]], 60)
    assert got == [(7, 2, "late", None, 9.0), (7, 3, "late", None, "nan"), (8, 2, "loss_spike", 1.0, 5.0)]
    assert [(r.run_id, r.step, same(r.value)) for r in invalid.collect()] == [(7, 3, "nan")]  # J2 loses nothing


def test_stream_state_outlives_a_gap(spark, tmp_path):
    reward = "eval_reward/mean"
    got, _ = arriving(spark, tmp_path, [[(7, 1, 0, reward, 5.0), (7, 2, 1, "loss", NAN)], [(7, 3, 10**6, reward, 3.0)], [(7, 4, 2 * 10**6, reward, 6.0), (7, 5, 2 * 10**6 + 1, END, None)]], 60)
    assert [g for g in got if g[2] == "new_best"] == [(7, 1, "new_best", None, 5.0), (7, 4, "new_best", None, 6.0)]
    assert [g[:2] + g[4:] for g in got if g[2] == "total_errors"] == [(7, 2, 1.0), (7, 3, 1.0), (7, 4, 1.0)]


def test_stream_tells_nan_from_null(spark, tmp_path):
    got, invalid = arriving(spark, tmp_path, [[(7, 1, 0, "loss", None), (7, 2, 1, "loss", NAN), (7, 3, 2, "loss", float("inf"))], [(7, 4, 3, END, None)]], 60)
    assert [g[1:3] + g[4:] for g in got] == [(2, "total_errors", 1.0), (3, "total_errors", 2.0)]
    assert sorted((r.step, same(r.value)) for r in invalid.collect()) == [(2, "nan"), (3, float("inf"))]


def test_an_idle_run_releases_once_other_runs_pass_it(spark, tmp_path):
    """Run 7 logs nothing after its spike and never ends; run 8 moves the watermark on."""
    batches = [[(7, 1, 0, "loss", 1.0), (7, 2, 1, "loss", 5.0), (8, 1, 0, "loss", 1.0)], [(8, 2, 500, "loss", 1.0)], [(8, 3, 1000, "loss", 1.0)], [(8, 4, 1500, "loss", 1.0)]]
    got, _ = arriving(spark, tmp_path, batches, 60)
    assert got == [(7, 2, "loss_spike", 1.0, 5.0)]


def test_rows_behind_a_timer_are_late(spark, tmp_path):
    """What a timer has released is passed, also for the run's own later rows."""
    batches = [[(7, 5, 5, "loss", 1.0), (8, 1, 0, "loss", 1.0)], [(8, 2, 500, "loss", 1.0)], [(8, 3, 1000, "loss", 1.0)], [(7, 1, 1, "loss", 9.0), (7, 6, 400, "loss", 3.0), (7, 9, 1001, END, None)]]
    got, _ = arriving(spark, tmp_path, batches, 60)
    assert got == [(7, 1, "late", None, 9.0), (7, 6, "loss_spike", 1.0, 3.0)]


def test_rows_after_the_end_are_late_and_change_nothing(spark, tmp_path):
    reward = "eval_reward/mean"
    batches = [[(7, 1, 0, reward, 5.0), (7, 2, 1, "loss", NAN), (7, 3, 2, END, None)], [(7, 4, 3, reward, 1.0), (7, 5, 4, "loss", NAN), (8, 1, 1, "loss", 1.0)], [(7, 6, 5, reward, 9.0)], [(7, 7, 6, END, None), (8, 2, 9, END, None)]]
    got, _ = arriving(spark, tmp_path, batches, 60)
    assert got == [(7, 1, "new_best", None, 5.0), (7, 2, "total_errors", None, 1.0), (7, 4, "late", None, 1.0), (7, 5, "late", None, "nan"), (7, 6, "late", None, 9.0)]


def test_an_ended_run_is_forgotten_when_asked_to(spark, tmp_path):
    far = [(8, i, 1000 * i, "loss", 1.0) for i in range(1, 5)]
    batches = [[(7, 1, 0, "loss", 1.0), (7, 2, 2, END, None)], far[:1], far[1:2], [(7, 1, 1000, "loss", 1.0), (7, 2, 1001, "loss", 9.0), far[2]], [(7, 3, 1002, END, None), far[3]]]
    got, _ = arriving(spark, tmp_path, batches, 60, forget=300)
    assert got == [(7, 2, "loss_spike", 1.0, 9.0)]


def test_a_stream_that_stops_and_goes_on_loses_and_repeats_nothing(spark, tmp_path):
    """Each arrival in a query of its own, all with one checkpoint."""
    src, as_log = str(tmp_path / "in"), lambda ev: ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "ts", F.col("event_type").alias("metric"), "value")
    batches = [[(7, 1, 0, "loss", 1.0), (7, 4, 50, "loss", 2.0)], [(7, 2, 20, "loss", 3.0), (7, 5, 900, "loss", 5.0)], [(7, 6, 1000, END, None)]]
    for rows in batches:
        df = spark.createDataFrame([(step, run, m, 1_700_000_000 + t, v) for run, step, t, m, v in rows], "event_id long, user_id long, event_type string, t long, value double")
        df.select("event_id", "user_id", "event_type", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(src)
        log = monitor_stream.events_log_stream(monitor_stream.stream_session(spark), src, SCHEMA, as_log, max_files=1)
        monitor_stream.start(monitor_stream.monitor_events(log, 60), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    got = sorted((r.step, r.kind, r.value_from, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(2, "loss_spike", 1.0, 3.0), (5, "loss_spike", 2.0, 5.0)]


def test_arrivals_have_as_many_files_as_their_rows_need(spark, monkeypatch):
    """No arrival goes through one file whole, and the events are the batch's."""
    from fumble.plans import queries_monitor as Q

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(Q, "FILE_ROWS", max(1, spark.read.parquet(f"{sf}/events.parquet").count() // 40), raising=False)
    path = Q._arriving(spark, sf)[0]
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) > 3 * Q.ARRIVALS
    got, want = Q.q_stream_errors(spark, sf), Q.q_error_counts(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stream_equals_batch_over_shuffled_files(spark):
    from fumble.plans import queries_monitor as Q

    for stream, batch in ((Q.q_stream_spikes, Q.q_loss_spikes), (Q.q_stream_best, Q.q_running_best), (Q.q_stream_errors, Q.q_error_counts), (Q.q_stream_invalid, Q.q_invalid_values)):
        rows = [sorted(tuple(map(same, r)) for r in f(spark, SF01).collect()) for f in (stream, batch)]
        assert rows[0] == rows[1] and rows[0]
