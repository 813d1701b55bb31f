"""What bounds the memory and time of Python steps over texts and of the monitor's state."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fumble.functions import metrics as M
from fumble.functions import noise_compat
from fumble.plans import common, queries_corpus, queries_reward
from fumble.session import BATCH_ROWS, text_session
from fumble.sources import files
from fumble.streaming import monitor_stream as MS


class Handle:
    """A stateful processor's handle that counts what is stored."""

    def __init__(self):
        self.values, self.maps, self.timers, self.stored = {}, {}, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.values.get(name), exists=lambda: name in self.values, update=lambda v: self.values.__setitem__(name, v), clear=lambda: self.values.pop(name, None))

    def getMapState(self, name, key, schema):
        def update(k, v):
            self.stored += len(v[0])
            self.maps[k] = v

        return SimpleNamespace(getValue=self.maps.get, containsKey=self.maps.__contains__, keys=lambda: iter(list(self.maps)), updateValue=update, removeKey=self.maps.pop)

    def registerTimer(self, at):
        self.timers.add(at)


def monitored(batches, delay=800):
    p, handle = MS.MonitorProcessor(delay, None), Handle()
    p.init(handle)
    out = []
    for rows in batches:
        f = pd.DataFrame([(t, t, metric, v, "number") for t, metric, v in rows], columns=["ts_ms", "step", "metric", "value", "value_is"])
        out += [r for x in p.handleInputRows((1,), iter([f]), None) for r in x.itertuples(index=False, name=None)]
    return out, handle


def test_rows_released_by_their_own_batch_are_not_stored():
    rows = [(100 * i, MS.LOSS, 1.0 + 9 * (i % 2)) for i in range(200)]
    end = (19900, MS.END_OF_RUN, 0.0)
    whole, handle = monitored([[*rows, end]])
    assert len(whole) == 100 and handle.stored == 0 and not handle.timers and not handle.maps
    mixed = rows[:103] + [rows[104], rows[103]]
    parts, handle = monitored([mixed, rows[105:], [end]])
    assert parts == whole and handle.stored <= 2 * 10 and not handle.maps and handle.values["run"][-1] == []


def test_runs_of_a_bucket_share_calls_stretches_and_timers():
    """What a call of Python or of the state costs is that of buckets, not of runs; each run's events are those it has alone."""
    rng, big = random.Random(6), 1 << 60  # names that floats do not tell apart
    names = [None, *(big + i for i in range(40))]
    rows = [(rng.choice(names), 50 * i + rng.randrange(300), rng.choice([1.0, 3.0, float("nan")])) for i in range(2000)]
    batches = [rows[:700], rows[700:1500], [r for r in rows[1500:] if r[0] != big], [(n, 200_000, None) for n in names]]

    class Counted(Handle):
        calls = 0

        def registerTimer(self, at):
            self.calls += 1
            super().registerTimer(at)

    def frame(batch):
        rows = [(None if n is None else str(n), t, t, MS.LOSS if v is not None else MS.END_OF_RUN, v, "nan" if v != v else "number" if v is not None else "null") for n, t, v in batch]
        return pd.DataFrame(rows, columns=["run", "ts_ms", "step", "metric", "value", "value_is"])

    def events(parts):
        p, handle, out = MS.MonitorProcessor(800, None), Counted(), []
        p.init(handle)
        for part in parts:
            f = frame(part)
            cut = [f.iloc[:300], f.iloc[300:]]  # as many frames as a batch takes
            out += [tuple(None if pd.isna(x) else x for x in r) for x in p.handleInputRows((3,), iter([c for c in cut if len(c)]), None) for r in x.itertuples(index=False, name=None)]
        return out, handle

    together, handle = events(batches)
    assert not handle.maps and handle.calls <= len(batches)
    for n in names:
        alone, _ = events([part for b in batches if (part := [r for r in b if r[0] == n])])
        assert alone == [e for e in together if e[0] == n] and alone


def test_distances_equal_the_bit_parallel_ones():
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("abcdefg\u00e9 ") for _ in range(n))
    pairs = [(None, "a"), ("a", None), ("", "abc"), ("x" * 70, "y" * 70)]
    for n in (1, 63, 64, 65, 130, 300) * 12:
        t = draw(n)
        u = "".join(draw(1) if rng.random() < rng.choice([0.02, 0.2]) else c for c in t)
        i, j = rng.randrange(n), rng.randrange(n)
        pairs += [(t, u), (t, (u[:i] + u[i + 1 :])[:j] + "z" + (u[:i] + u[i + 1 :])[j:]), (t, u + t), (t[3:], u)]
    want = [None if a is None or b is None else M.bitparallel_distance(a, b) for a, b in pairs]
    assert M.distances([a for a, _ in pairs], [b for _, b in pairs]) == want


def test_noisy_texts_of_one_length_take_the_band(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(20)]
    noisy = ["".join("z" if rng.random() < 0.1 else c for c in t) for t in texts]
    want = [M.bitparallel_distance(a, b) for a, b in zip(texts, noisy, strict=True)]
    monkeypatch.setattr(M, "bitparallel_distance", lambda a, b: pytest.fail("the whole table was run"))
    assert M.distances(texts, noisy) == want


def test_python_steps_get_small_batches(spark, tmp_path):
    n = 4 * BATCH_ROWS
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = text_session(spark)
    assert text_session(spark) is own and text_session(own) is own and own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    built = (common.all_pairs(spark, str(tmp_path)), queries_corpus.q_compat_noise(spark, str(tmp_path)), queries_corpus.q_prepared_row_errors(spark, str(tmp_path)))
    assert {int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) for df in built} == {BATCH_ROWS}
    assert built[0].count() == n


def test_compat_words_are_narrow():
    words = noise_compat.Words(0, 10, (8, 10), 1 << 12)
    assert {words.typo.itemsize, words.passed.itemsize, *(at.itemsize for at, _ in words.below.values())} == {4}


def test_evaluation_tables_pass_the_documents_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"one two three four {i} five", "en", f"s{i % 2}") for i in range(40)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = [], files.write_scalars
    monkeypatch.setattr(files, "write_scalars", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, path)))
    rows = queries_reward.q_evaluation_tables(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * 2 * 2 and len(plans) == 4 and not any("Python" in p for p in plans)
