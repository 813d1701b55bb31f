"""Plan shape: the properties the scale design relies on stay in the plan."""

from conftest import SF01
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from fumble.functions.text import rand_u
from fumble.operators import sample
from fumble.plans.common import all_pairs
from fumble.operators import score
from fumble.sources.tables import load


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_sampling_uses_partial_window_group_limit(spark):
    docs = load(spark, SF01, "documents").select("doc_id", "source")
    p = sample.sample_per_source(docs, k=20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p


def test_distance_computed_once_per_row(spark):
    s = score.score(all_pairs(spark, SF01), pred_col="typos", expected_col="correct", keep=["pair_id"])
    optimized = s._jdf.queryExecution().optimizedPlan().toString()
    # one banded + one full call for the raw texts, the same for normalised texts
    assert optimized.count("levenshtein(") == 4


def test_realignment_aggregates_before_the_join(spark):
    q = E.queries()["realign_completions"](spark, SF01)
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in p and "md5" in p


def test_scans_prune_columns(spark):
    q = E.queries()["loss_spikes"](spark, SF01)
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p


def executed(df):
    """The plan that ran, with AQE's choices."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count(name)


def test_sample_rounds_cut_equals_full_pass(spark):
    """The draws' cut never changes the sample, also where it keeps too few and the full pass steps in."""
    docs = load(spark, SF01, "documents").select("doc_id", "source")
    rows = lambda df: sorted((r.doc_id, r.source, r["round"]) for r in df.collect())
    want = []
    for r in range(4):
        one = docs.withColumn("u", rand_u(42, "sample", F.lit(r), F.col("doc_id")))
        w = Window.partitionBy("source").orderBy("u", "doc_id")
        want += [(x.doc_id, x.source, r) for x in one.withColumn("rn", F.row_number().over(w)).filter("rn <= 7").collect()]
    for spare in (8.0, 0.0, -7.0):  # enough; often too few; none at all
        assert rows(sample.sampled_keys(sample.narrow_keys(docs), rounds=4, k=7, spare=spare)) == sorted(want), spare


def test_realignment_moves_digests_once(spark):
    q = E.queries()["realign_completions"](spark, SF01)
    assert nodes(q, "Exchange hashpartitioning") <= 3 and "RoundRobin" not in q._jdf.queryExecution().executedPlan().toString()


def test_passages_are_cropped_before_they_are_spread(spark):
    p = all_pairs(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    above = p.split("RoundRobin")[0]
    assert "substring" in p.split("RoundRobin")[1] and ".text" not in above


def test_monitor_shares_one_exchange_by_run_and_chunk(spark):
    q = E.queries()["loss_spikes"](spark, SF01)
    assert nodes(q, "Exchange hashpartitioning") <= 4


def test_loss_spikes_read_their_log_once(spark):
    """Both uses of a chunk's rows share one exchange, and with it the read of the table."""
    from fumble.operators import monitor
    from fumble.plans.queries_monitor import training_log

    df = monitor.loss_spikes(training_log(spark, SF01))
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan parquet") == 1 and "ReusedExchange" in ran
