"""Training-log monitoring (J1–J5, I6), job ``monitor`` — batch form.

Input is a long log ``(run_id, step, metric, value)``: one row per logged
number, in step order within a run.

Every per-run running quantity (previous loss, running maximum, running
error count) is a prefix scan. A plain window ``partitionBy(run_id)`` would
put a whole run — possibly a third of all rows — into one task, so the scans
are split in two levels:

1. rows are cut into chunks of ``chunk_steps`` consecutive steps; each
   (run, chunk) is summarised with an ordinary partial/final aggregation;
2. the per-chunk summaries (one row per chunk, tiny) are scanned per run to
   give each chunk the value carried in from all earlier chunks;
3. the summaries are joined back on (run, chunk) and the scan inside each
   chunk runs as a window ``partitionBy(run_id, chunk)``.

Each window partition is then bounded by ``chunk_steps`` steps, whatever the
size of a run, and no step is dropped.

NaN is handled explicitly: Spark orders NaN above every number, Python
compares it as false, so NaN values never become "previous loss" or "best".

Several numbers of one metric at one step are ordered by value, NaN last; an
evaluation logged twice at a step counts with its largest valid reward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spike threshold and metric names.
SPIKE_FACTOR = 2.0
LOSS = "loss"
REWARD_NAMES = ("eval_reward/mean", "eval_rewards/mean")
CHUNK_STEPS = 1 << 16


def _valid(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def _chunked(df: DataFrame, chunk_steps: int) -> DataFrame:
    """Rows dealt by (run, chunk) once; the per-step and per-chunk aggregates,
    the join and the window of a chunk all use that one exchange."""
    return df.withColumn("_chunk", F.floor(F.col("step") / chunk_steps).cast("bigint")).repartition("run_id", "_chunk")


def loss_spikes(log: DataFrame, factor: float = SPIKE_FACTOR, chunk_steps: int = CHUNK_STEPS,
                metric: str = LOSS) -> DataFrame:
    """Rows where ``loss > factor × previous recorded loss``.

    The previous loss is the last earlier event of the run that carried a
    loss (NaN included, as the reference stores it; comparisons with NaN are
    false, so a NaN on either side never alerts). Output:
    ``(run_id, step, loss_spike_from, loss_spike_to)``.
    """
    # A null loss makes the reference's comparison fail before it is stored,
    # so only non-null losses (NaN included) are "recorded".
    losses = _chunked(log.filter((F.col("metric") == metric) & F.col("value").isNotNull())
                      .select("run_id", "step", "value"), chunk_steps)
    # previous loss inside the chunk; both uses below read one exchange
    w = Window.partitionBy("run_id", "_chunk").orderBy("step", "value")
    placed = losses.select("run_id", "_chunk", "step", "value", F.lag("value").over(w).alias("prev"), F.row_number().over(w).alias("_rn"),
                           F.count(F.lit(1)).over(Window.partitionBy("run_id", "_chunk")).alias("_n"))
    inside = placed.filter("_rn > 1").select("run_id", "step", "value", "prev")
    # a chunk's first loss follows the last one of the chunk before: at most two rows of each chunk
    ends = placed.filter("_rn = 1 OR _rn = _n")
    before = F.lag("value").over(Window.partitionBy("run_id").orderBy("_chunk", "_rn"))
    first = ends.withColumn("prev", before).filter("_rn = 1").select("run_id", "step", "value", "prev")
    with_prev = inside.unionByName(first)
    spike = (
        _valid(F.col("value")) & _valid(F.col("prev")) & (F.col("value") > F.col("prev") * factor)
    )
    return with_prev.filter(spike).select(
        "run_id", "step", F.col("prev").alias("loss_spike_from"), F.col("value").alias("loss_spike_to"))


def invalid_values(log: DataFrame) -> DataFrame:
    """Every logged number that is NaN or ±Inf, as ``(run_id, step, metric, value)``."""
    v = F.col("value")
    return log.filter(F.isnan(v) | (F.abs(v) == float("inf"))).select("run_id", "step", "metric", "value")


def error_counts(log: DataFrame, chunk_steps: int = CHUNK_STEPS) -> tuple[DataFrame, DataFrame]:
    """Running invalid-value count per logged event (emitted once the
    count is > 0) and the final count per run.

    Returns ``(running(run_id, step, total_errors), final(run_id, final_error_count))``.
    """
    v = F.col("value")
    invalid = F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))  # a null number is not an error
    hits = _chunked(log.select("run_id", "step", invalid.cast("bigint").alias("hit")), chunk_steps)
    per_step = hits.groupBy("run_id", "_chunk", "step").agg(F.sum("hit").alias("hits"))
    per_chunk = per_step.groupBy("run_id", "_chunk").agg(F.sum("hits").alias("_n"))
    wc = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select("run_id", "_chunk", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_carry"))
    w = Window.partitionBy("run_id", "_chunk").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        per_step.join(carried, on=["run_id", "_chunk"])
        .select("run_id", "step", (F.col("_carry") + F.sum("hits").over(w)).alias("total_errors"))
        .filter(F.col("total_errors") > 0)
    )
    final = log.groupBy("run_id").agg(F.count_if(invalid).alias("final_error_count"))
    return running, final


def evaluation_rewards(evals: DataFrame) -> DataFrame:
    """The reward of an evaluation = first present of the two metric names.

    ``evals`` is long ``(run_id, step, metric, value)``; output
    ``(run_id, step, reward)`` with null when neither name was logged.
    """
    names = list(REWARD_NAMES)
    picked = evals.filter(F.col("metric").isin(*names)).groupBy("run_id", "step").agg(
        *[F.coalesce(F.max(F.when((F.col("metric") == n) & _valid(F.col("value")), F.col("value"))),
                     F.max(F.when(F.col("metric") == n, F.col("value")))).alias(f"_r{i}") for i, n in enumerate(names)])
    return picked.select("run_id", "step", F.coalesce(*[F.col(f"_r{i}") for i in range(len(names))]).alias("reward"))


def running_best(rewards: DataFrame, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Evaluations whose reward is strictly greater than every earlier one
    of the run (first wins ties; null and NaN never count).

    Output ``(run_id, step, reward)`` — one row per "new best" event.
    """
    r = _chunked(rewards.filter(_valid(F.col("reward"))).select("run_id", "step", "reward"), chunk_steps)
    # the best before inside the chunk, and the chunk's best
    w = Window.partitionBy("run_id", "_chunk").orderBy("step")
    placed = r.select("run_id", "_chunk", "step", "reward", F.max("reward").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
                      F.max("reward").over(Window.partitionBy("run_id", "_chunk")).alias("_m"), F.row_number().over(w).alias("_rn"))
    wc = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.filter("_rn = 1").select("run_id", "_chunk", F.max("_m").over(wc).alias("_carry"))
    j = placed.join(carried, on=["run_id", "_chunk"], how="left")
    floor = F.coalesce(F.greatest("_in", "_carry"), F.lit(float("-inf")))  # greatest skips nulls
    return j.filter(F.col("reward") > floor).select("run_id", "step", "reward")


def checkpoint_path(output_dir: Column | str, step: Column) -> Column:
    """``{output_dir}/checkpoint-{step}``."""
    od = F.lit(output_dir) if isinstance(output_dir, str) else output_dir
    return F.concat(od, F.lit("/checkpoint-"), step.cast("string"))


def best_checkpoint(rewards: DataFrame, checkpoints: DataFrame, output_dir: str = "checkpoints") -> DataFrame:
    """J5 + I6: per run, the checkpoint of the best reward if it exists.

    The best is the largest valid reward, the earliest step on ties. It is
    kept only if ``checkpoints(run_id, step)`` lists it (left semi join);
    otherwise the run falls back to its final state. Output
    ``(run_id, best_step, best_reward, source, path)`` with ``source`` in
    {"best checkpoint", "final training state"}.
    """
    valid = rewards.filter(_valid(F.col("reward")))
    best = valid.filter(F.col("reward") > float("-inf")).groupBy("run_id").agg(
        F.max(F.struct(F.col("reward"), (-F.col("step")).alias("neg_step"))).alias("b"))
    best = best.select("run_id", (-F.col("b.neg_step")).alias("best_step"), F.col("b.reward").alias("best_reward"))
    exists = best.join(checkpoints.select("run_id", F.col("step").alias("best_step")),
                       on=["run_id", "best_step"], how="left_semi").select("run_id", F.lit(True).alias("_exists"))
    runs = rewards.select("run_id").distinct()
    out = runs.join(best, on="run_id", how="left").join(exists, on="run_id", how="left")
    found = F.coalesce(F.col("_exists"), F.lit(False))
    return out.select(
        "run_id", "best_step", "best_reward",
        F.when(found, F.lit("best checkpoint")).otherwise(F.lit("final training state")).alias("source"),
        F.when(found, checkpoint_path(output_dir, F.col("best_step"))).alias("path"),
    )


def saved_checkpoints(steps: DataFrame, save_every: int, keep_last: int) -> DataFrame:
    """Checkpoints that still exist after training: every ``save_every`` steps,
    only the last ``keep_last`` kept per run (the rotation of the trainer)."""
    saved = steps.filter(F.col("step") % save_every == 0).select("run_id", "step").distinct()
    w = Window.partitionBy("run_id").orderBy(F.col("step").desc())
    return saved.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep_last).drop("_k")
