"""Reward calls recorded as they arrive: numbering, repeated micro-batches, statistics."""

import random
import statistics

from fumble.session import checkpoint_path
from fumble.streaming import call_stats as S

SCHEMA = "run_id string, call string, seq long, reward double, char_accuracy double, perfect_match boolean"


def rows_of(seed=1, calls=12):
    rng = random.Random(seed)
    return [(run, f"c{c}", c, rng.gauss(2, 1), rng.random(), rng.random() < 0.3) for run in ("a", "b", "c") for c in range(calls if run != "c" else 3) for _ in range(rng.randrange(1, 9))]


def seen(spark, path):
    return sorted((r.run_id, r.call, r.call_count, r.n_rows, *(round(x, 9) for x in (r.mean_char_accuracy, r.perfect_match_ratio, r.reward_mean, r.reward_min, r.reward_max, r.reward_std))) for r in S.call_stats(spark, path).collect())


def wanted(rows):
    out = []
    for run, call in sorted({r[:2] for r in rows}):
        some = [r for r in rows if r[:2] == (run, call)]
        rewards = [r[3] for r in some]
        out.append((run, call, int(call[1:]) + 1, len(some), *(round(x, 9) for x in (statistics.fmean(r[4] for r in some), sum(r[5] for r in some) / len(some), statistics.fmean(rewards), min(rewards), max(rewards), statistics.pstdev(rewards)))))
    return out


def test_a_repeated_micro_batch_changes_nothing(spark):
    path, rows = checkpoint_path(spark, "calls-test"), rows_of()
    batch = lambda i: spark.createDataFrame([r for r in rows if r[2] // 4 == i], SCHEMA).repartition(3)
    for i in range(3):
        S.record_calls(batch(i), i, path)
    first = seen(spark, path)
    assert first == wanted(rows)
    S.record_calls(batch(2), 2, path)  # as after a driver lost before the commit
    assert seen(spark, path) == first


def test_a_call_in_several_micro_batches_counts_once(spark):
    path, rows = checkpoint_path(spark, "calls-parts-test"), rows_of(2)
    for i in range(4):
        S.record_calls(spark.createDataFrame([r for j, r in enumerate(rows) if min(3, r[2] // 4 + j % 2) == i], SCHEMA), i, path)
    got = seen(spark, path)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in wanted(rows)]
    for run in "abc":  # numbers without a gap, and none given twice
        numbers = sorted(g[2] for g in got if g[0] == run)
        assert numbers == list(range(1, len(numbers) + 1))


def test_empty_micro_batches_and_tables(spark):
    path = checkpoint_path(spark, "calls-empty-test")
    assert seen(spark, path) == []
    S.record_calls(spark.createDataFrame([], SCHEMA), 0, path)
    assert seen(spark, path) == []
    S.record_calls(spark.createDataFrame([("a", "c0", 0, None, None, None), ("a", "c0", 0, 1.0, 0.5, True)], SCHEMA), 1, path)
    one = S.call_stats(spark, path).first()
    assert (one.call_count, one.n_rows, one.reward_min, one.reward_max) == (1, 2, 1.0, 1.0)


def test_a_stream_goes_on_where_it_stopped(spark):
    path, rows = checkpoint_path(spark, "calls-stream-test"), rows_of(3)
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 4 == i], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        S.start(log, f"{path}/stats").awaitTermination(120)
    assert seen(spark, f"{path}/stats") == wanted(rows)
