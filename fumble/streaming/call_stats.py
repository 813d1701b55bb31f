"""Statistics of reward calls as they arrive (H3, H4, H7), with a call counter for each run.

A stream of scored rows ``(run_id, call, seq, reward, char_accuracy,
perfect_match)``: ``call`` names the reward call of a run, ``seq`` gives its
place among the calls of one arrival. Every micro-batch is reduced to a row for
each call by partial aggregation, so a run that makes most of the calls costs
no more than the others, and two narrow tables keep what is known, both parted
by the micro-batch that wrote them:

* ``sums``: count, sums and extremes of the rows of a call in this micro-batch;
* ``counter``: calls that this micro-batch saw first, with their numbers, and
  the run's counter after them.

The counter goes on from what earlier micro-batches wrote. A micro-batch that
Spark runs again, after a lost driver for example, reads only what lies before
it and replaces its own part by dynamic partition overwrite: it changes nothing,
and no call is counted twice. A call whose rows come in several micro-batches
keeps its number and its sums add up.

Means and the population deviation come from sums about each micro-batch's own
mean, joined as they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_path
from ..sources import files

SUMS = "run_id string, call string, n_rows long, reward_mean double, reward_m2 double, reward_min double, reward_max double, accuracy double, perfect long, micro_batch long"
COUNTER = "run_id string, call string, call_count long, micro_batch long"


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("run_id").cast("string").alias("run_id"), F.col("call").cast("string").alias("call")).agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_rows"), F.avg("reward").alias("reward_mean"),
        (F.var_pop("reward") * F.count("reward")).alias("reward_m2"), F.min("reward").alias("reward_min"), F.max("reward").alias("reward_max"),
        F.sum("char_accuracy").alias("accuracy"), F.count_if(F.coalesce("perfect_match", F.lit(False))).alias("perfect"))


def record_calls(rows: DataFrame, micro_batch: int, path: str) -> None:
    """Take a micro-batch into the tables below ``path``; may be repeated."""
    spark = rows.sparkSession
    some = _sums(rows).persist()
    try:
        before = _read(spark, f"{path}/counter", COUNTER).filter(F.col("micro_batch") < micro_batch)
        new = some.join(before.select("run_id", "call"), ["run_id", "call"], "left_anti")
        last = before.groupBy("run_id").agg(F.max("call_count").alias("last"))
        place = F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "call"))  # over the calls of one micro-batch
        counted = new.join(last, "run_id", "left").select("run_id", "call", (F.coalesce("last", F.lit(0)) + place).cast("long").alias("call_count"))
        files.write_keyed(counted.withColumn("micro_batch", F.lit(micro_batch).cast("long")), f"{path}/counter", ("micro_batch",))
        files.write_keyed(some.drop("seq").withColumn("micro_batch", F.lit(micro_batch).cast("long")), f"{path}/sums", ("micro_batch",))
    finally:
        some.unpersist()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def call_stats(spark: SparkSession, path: str) -> DataFrame:
    """H3 with the call counter, a row for each call recorded below ``path``."""
    sums = _read(spark, f"{path}/sums", SUMS)
    n = F.sum("n_rows")
    mean = F.sum(F.col("n_rows") * F.col("reward_mean")) / n
    # squares about the whole mean: those about each part's mean and of the parts' means about it
    square = F.sum(F.col("reward_m2") + F.col("n_rows") * F.col("reward_mean") * F.col("reward_mean")) / n - mean * mean
    stats = sums.groupBy("run_id", "call").agg(
        n.alias("n_rows"), (F.sum("accuracy") / n).alias("mean_char_accuracy"), (F.sum("perfect") / n).alias("perfect_match_ratio"),
        mean.alias("reward_mean"), F.min("reward_min").alias("reward_min"), F.max("reward_max").alias("reward_max"),
        F.when(F.count(F.lit(1)) == 1, F.sqrt(F.max(F.col("reward_m2") / F.col("n_rows")))).otherwise(F.sqrt(F.greatest(square, F.lit(0.0)))).alias("reward_std"))
    return stats.join(_read(spark, f"{path}/counter", COUNTER).select("run_id", "call", "call_count"), ["run_id", "call"])


def start(rows: DataFrame, path: str | None = None, trigger: dict | None = None, name: str = "calls"):
    """Record a stream of scored rows; tables and progress lie below ``path``,
    by default in the shared folder, so a restarted driver goes on from there."""
    path = path or checkpoint_path(rows.sparkSession, name)
    q = rows.writeStream.foreachBatch(lambda df, i: record_calls(df, i, path)).option("checkpointLocation", f"{path}/progress").outputMode("append")
    return q.trigger(**(trigger or {"availableNow": True})).start()
