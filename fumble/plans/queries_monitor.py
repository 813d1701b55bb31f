"""Registered queries of the ``monitor`` job (J1–J5, I6) on the events table.

The training log is derived from ``events``: run = user, step = event id
(monotone with the timestamp), ``loss`` = value of view and click events,
``eval_reward/mean`` = value of purchase events, other event types keep their
name. The table holds no invalid numbers, so NaN and +Inf are injected
deterministically (event id multiples of 97 and 89) in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import monitor
from ..session import checkpoint_path
from ..sources.tables import load
from ..streaming import monitor_stream

# Checkpoint rotation of the reference's trainer.
SAVE_EVERY, KEEP_LAST = 20, 2
OUTPUT_DIR = "checkpoints"


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(load(spark, sf_dir, "events")).drop("ts")


def log_of(ev: DataFrame) -> DataFrame:
    """Events as log rows (run_id, step, metric, value, ts)."""
    metric = (F.when(F.col("event_type").isin("view", "click"), F.lit(monitor.LOSS))
              .when(F.col("event_type") == "purchase", F.lit(monitor.REWARD_NAMES[0]))
              .otherwise(F.col("event_type")))
    value = (F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
             .when(F.col("event_id") % 89 == 0, F.lit(float("inf")))
             .otherwise(F.col("value")))
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                     metric.alias("metric"), value.alias("value"), F.col("ts").cast("timestamp").alias("ts"))


LOG_SQL = (
    "(SELECT user_id AS run_id, event_id AS step, "
    f"CASE WHEN event_type IN ('view', 'click') THEN '{monitor.LOSS}' WHEN event_type = 'purchase' THEN '{monitor.REWARD_NAMES[0]}' "
    "ELSE event_type END AS metric, "
    "CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE value END AS value "
    "FROM events)"
)
REWARDS_SQL = f"(SELECT run_id, step, value AS reward FROM {LOG_SQL} WHERE metric = '{monitor.REWARD_NAMES[0]}')"


def _kind(v):
    return F.when(F.isnan(v), F.lit("nan")).when(v > 0, F.lit("inf")).otherwise(F.lit("-inf"))


def q_loss_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.loss_spikes(training_log(spark, sf_dir))


def q_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = monitor.invalid_values(training_log(spark, sf_dir))
    return iv.select("run_id", "step", "metric", _kind(F.col("value")).alias("value_kind"))


def q_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    running, _final = monitor.error_counts(training_log(spark, sf_dir))
    return running


def q_final_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _running, final = monitor.error_counts(training_log(spark, sf_dir))
    return final


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.evaluation_rewards(training_log(spark, sf_dir))


def q_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.running_best(_rewards(spark, sf_dir))


def q_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = training_log(spark, sf_dir)
    ckpts = monitor.saved_checkpoints(log.select("run_id", "step"), SAVE_EVERY, KEEP_LAST)
    return monitor.best_checkpoint(monitor.evaluation_rewards(log), ckpts, OUTPUT_DIR)


# Streaming: the events arrive so many times, in order of event time plus a draw below the delay,
# each time in files of about FILE_ROWS rows.
ARRIVALS, DELAY_SECONDS = 5, 6 * 3600
FILE_ROWS = 1 << 20
BUCKETS = 64  # of runs for each such file of an arrival


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[str, StructType, int]:
    """Event files below the shared folder as they arrive, and how many make an
    arrival: shuffled by less than the delay, and last an end row of each run.
    A run has one file an arrival, so its rows keep the order of the arrivals."""
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = checkpoint_path(spark, f"arrivals-{uuid.uuid4().hex}")
    at = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(DELAY_SECONDS))
    low, high, n = ev.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    files = max(1, -(-n // (ARRIVALS * FILE_ROWS)))
    part = F.least(F.floor((at - low) * ARRIVALS / F.greatest(F.lit((high or 0) - (low or 0)), F.lit(1))), F.lit(ARRIVALS - 1))
    for i in range(ARRIVALS):  # one write after the other, so that the files' times keep the order
        ev.filter(part == i).repartition(files, "user_id").write.mode("append").parquet(path)
    ends = ev.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts"))
    ends.select("event_id", "user_id", F.lit(monitor_stream.END_OF_RUN).alias("event_type"), "ts", F.lit(None).cast("double").alias("value")).repartition(files, "user_id").write.mode("append").parquet(path)
    return path, ev.schema, files


def _streamed(spark: SparkSession, sf_dir: str, events) -> DataFrame:
    """What ``events`` of the arriving log puts into its sink, as many files as an arrival has a micro-batch."""
    path, schema, files = _arriving(spark, sf_dir)
    log = monitor_stream.events_log_stream(monitor_stream.stream_session(spark), path, schema, log_of, max_files=files)
    name = f"monitor-{uuid.uuid4().hex}"
    query = monitor_stream.start(events(log, files), name=name)
    query.awaitTermination()
    return spark.read.parquet(checkpoint_path(spark, f"{name}/events"))


def _ordered(log: DataFrame, files: int) -> DataFrame:
    return monitor_stream.monitor_events(log, DELAY_SECONDS, buckets=BUCKETS * files)


def q_stream_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _streamed(spark, sf_dir, _ordered).filter("kind = 'loss_spike'")
    return e.select("run_id", "step", F.col("value_from").alias("loss_spike_from"), F.col("value").alias("loss_spike_to"))


def q_stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, _ordered).filter("kind = 'new_best'").select("run_id", "step", F.col("value").alias("reward"))


def q_stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _streamed(spark, sf_dir, _ordered).filter("kind = 'total_errors'")
    return e.select("run_id", "step", F.col("value").cast("long").alias("total_errors"))


def q_stream_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = _streamed(spark, sf_dir, lambda log, _files: monitor_stream.invalid_events(log))
    return iv.select("run_id", "step", "metric", _kind(F.col("value")).alias("value_kind"))


def oracles() -> dict[str, str]:
    batch = _batch_oracles()
    same = {"monitor_stream_spikes": "loss_spikes", "monitor_stream_best": "running_best", "monitor_stream_errors": "error_counts", "monitor_stream_invalid": "invalid_values"}
    return batch | {k: batch[v] for k, v in same.items()}


def _batch_oracles() -> dict[str, str]:
    valid = "(value IS NOT NULL AND NOT isnan(value))"
    return {
        "loss_spikes": (
            "SELECT run_id, step, prev AS loss_spike_from, value AS loss_spike_to FROM ("
            "SELECT run_id, step, value, lag(value) OVER (PARTITION BY run_id ORDER BY step) AS prev "
            f"FROM {LOG_SQL} WHERE metric = '{monitor.LOSS}' AND value IS NOT NULL) "
            f"WHERE {valid} AND prev IS NOT NULL AND NOT isnan(prev) AND value > prev * {monitor.SPIKE_FACTOR}"
        ),
        "invalid_values": (
            "SELECT run_id, step, metric, CASE WHEN isnan(value) THEN 'nan' WHEN value > 0 THEN 'inf' ELSE '-inf' END AS value_kind "
            f"FROM {LOG_SQL} WHERE isnan(value) OR isinf(value)"
        ),
        "error_counts": (
            "SELECT run_id, step, total_errors FROM (SELECT run_id, step, "
            "CAST(sum(hits) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_errors "
            "FROM (SELECT run_id, step, sum(CASE WHEN isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS hits "
            f"FROM {LOG_SQL} GROUP BY run_id, step)) WHERE total_errors > 0"
        ),
        "final_error_counts": (
            "SELECT run_id, CAST(sum(CASE WHEN isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS BIGINT) AS final_error_count "
            f"FROM {LOG_SQL} GROUP BY run_id"
        ),
        "running_best": (
            "SELECT run_id, step, reward FROM (SELECT run_id, step, reward, max(reward) OVER (PARTITION BY run_id ORDER BY step "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {REWARDS_SQL} WHERE reward IS NOT NULL AND NOT isnan(reward)) "
            "WHERE reward > coalesce(b, '-inf'::DOUBLE)"
        ),
        "best_checkpoint": (
            "WITH r AS (SELECT * FROM " + REWARDS_SQL + " WHERE reward IS NOT NULL AND NOT isnan(reward) AND reward > '-inf'::DOUBLE), "
            "b AS (SELECT run_id, arg_max(step, (reward, -step)) AS best_step, max(reward) AS best_reward FROM r GROUP BY run_id), "
            f"c AS (SELECT run_id, step FROM (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS k "
            f"FROM (SELECT DISTINCT run_id, step FROM {LOG_SQL} WHERE step % {SAVE_EVERY} = 0)) WHERE k <= {KEEP_LAST}), "
            f"runs AS (SELECT DISTINCT run_id FROM {REWARDS_SQL}) "
            "SELECT runs.run_id, b.best_step, b.best_reward, "
            "CASE WHEN c.step IS NOT NULL THEN 'best checkpoint' ELSE 'final training state' END AS source, "
            f"CASE WHEN c.step IS NOT NULL THEN '{OUTPUT_DIR}/checkpoint-' || CAST(b.best_step AS VARCHAR) END AS path "
            "FROM runs LEFT JOIN b USING (run_id) LEFT JOIN c ON c.run_id = b.run_id AND c.step = b.best_step"
        ),
    }


def queries() -> dict:
    return {
        "loss_spikes": q_loss_spikes,
        "invalid_values": q_invalid_values,
        "error_counts": q_error_counts,
        "final_error_counts": q_final_error_counts,
        "running_best": q_running_best,
        "best_checkpoint": q_best_checkpoint,
        "monitor_stream_spikes": q_stream_spikes,
        "monitor_stream_best": q_stream_best,
        "monitor_stream_errors": q_stream_errors,
        "monitor_stream_invalid": q_stream_invalid,
    }
