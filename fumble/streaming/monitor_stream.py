"""Training-log monitor as a Structured Streaming job (J1, J3, J4; J2 stateless).

The reference reacts to callbacks that arrive in step order. Here the log is a
stream ``(run_id, step, ts, metric, value)`` whose rows may arrive up to
``delay`` late. Runs are dealt into ``buckets`` by a hash, since a call of Python
and what it asks of the state take much longer than a row; one call takes all
rows that a micro-batch has of a bucket. ``transformWithStateInPandas`` keeps per
bucket

* ``held``: the rows that may still be overtaken, a map from a stretch of event
  time (an eighth of the delay) to its rows, so that a batch rewrites only the
  stretches that its rows fall into or leave; rows that are released by the batch
  that brings them never enter it;
* ``run``: for each run last loss, best reward, invalid-value count, the place up
  to which rows have been released and whether the run has ended; the next timer
  and the held stretches.

A run's rows of a stretch are released, in ``(ts, step)`` order, once the run's
own latest event time is ``delay`` past the stretch, or the watermark is: a bucket
has an event-time timer at the end of its first held stretch, so an idle run is
released as soon as other runs move the watermark on.
What follows sees the same order as the batch form. A row behind what its run
has released can no longer take its place: it is emitted as ``late`` with its
metric and value and changes no state. Spark itself drops no row: the watermark
is set on a copy of the event time that the stateful step does not read.

An end row (metric ``END_OF_RUN``) releases all that is held; a small mark stays,
so that rows after it are ``late`` too. With ``forget_seconds`` the mark goes
once the watermark is that much past the end; a later row starts the run anew.

Invalid numbers (J2) need no order and come from a stateless query.

One micro-batch of one bucket is held in memory; ``max_files`` of
``events_log_stream`` bounds what a micro-batch reads. A checkpoint belongs to
its number of buckets.

Events: ``(run_id, step, kind, metric, value_from, value)`` with ``kind`` in
``loss_spike``, ``new_best``, ``total_errors``, ``late``. NaN and null are kept
apart on the way through pandas by a column that names what a value is.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import monitor
from ..operators.monitor import LOSS, REWARD_NAMES, SPIKE_FACTOR
from ..session import ensure_checkpoint_dir, ship_package

END_OF_RUN = "__end_of_run__"
EVENT_SCHEMA = "run_id long, step long, kind string, metric string, value_from double, value double, value_is string"
EVENT_COLUMNS = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
# a list has an element for each run, or for each held row
RUN_SCHEMA = ("run_id array<long>, last_loss array<double>, has_loss array<boolean>, best array<double>, errors array<long>, front_ts array<long>, "
              "front_step array<long>, last_ts array<long>, ended array<boolean>, timer long, stretches array<long>")
HELD_SCHEMA = "run_id array<long>, ts array<long>, step array<long>, metric array<string>, value array<double>"
STRETCHES = 8  # of the delay
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAX_FILES = 64
BUCKETS = 4096


class Run:
    """A run's running quantities; ``step`` takes all numbers of one step, in order."""

    __slots__ = ("last_loss", "has_loss", "best", "errors", "front", "last_ts", "ended")

    def __init__(self, last_loss=None, has_loss=False, best=None, errors=0, front_ts=None, front_step=None, last_ts=None, ended=False):
        self.last_loss, self.has_loss, self.best, self.errors = last_loss, has_loss, best, errors
        self.front = None if front_ts is None else (front_ts, front_step)  # place released up to
        self.last_ts, self.ended = last_ts, ended  # latest event time

    def fields(self) -> tuple:
        return self.last_loss, self.has_loss, self.best, self.errors, *(self.front or (None, None)), self.last_ts, self.ended

    def step(self, numbers: list[tuple[str, float]]) -> Iterator[tuple]:
        """(kind, metric, value_from, value) of the events of the step's non-null numbers."""
        for metric, value in numbers:
            if metric == LOSS:
                if self.has_loss and value > self.last_loss * SPIKE_FACTOR:  # false with NaN on either side
                    yield "loss_spike", metric, self.last_loss, value
                self.last_loss, self.has_loss = value, True
            self.errors += math.isnan(value) or math.isinf(value)
        for name in REWARD_NAMES:  # the first name that the step has is its evaluation
            rewards = [v for m, v in numbers if m == name]
            if rewards:
                valid = max((v for v in rewards if not math.isnan(v)), default=-math.inf)
                if valid > (-math.inf if self.best is None else self.best):
                    self.best = valid
                    yield "new_best", name, None, valid
                break
        if self.errors:
            yield "total_errors", None, None, float(self.errors)


def _kind(value: float | None) -> str:
    return "null" if value is None else "nan" if math.isnan(value) else "number"


def _release(run_id: int, run: Run, rows: list[tuple]) -> Iterator[tuple]:
    """Events of rows (run, ts, step, metric, value) in order, step by step."""
    for step, group in groupby(rows, key=itemgetter(2)):
        for kind, metric, was, now in run.step([(m, v) for _, _, _, m, v in group if v is not None]):
            yield run_id, step, kind, metric, was, now, _kind(now)


def _order(row: tuple) -> tuple:
    _, ts, step, metric, value = row
    return ts, step, metric or "", value is None, value is not None and math.isnan(value), value or 0.0


def _value(value: float | None, value_is: str) -> float | None:
    return {"null": None, "nan": math.nan}.get(value_is, value)


def _frame(events: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(events, columns=EVENT_COLUMNS)
    f["run_id"] = pd.array([e[0] for e in events], "Int64")  # exact beside a null
    return f


class MonitorProcessor(StatefulProcessor):
    """Holds the rows of a bucket's runs by stretches of event time and releases them in order; see the module's text."""

    def __init__(self, delay_ms: int, forget_ms: int | None):
        self.delay, self.stretch, self.forget = delay_ms, max(1, delay_ms // STRETCHES), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_SCHEMA)
        self.held = handle.getMapState("held", "stretch long", HELD_SCHEMA)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict[int | None, Run], int | None, set[int]]:
        """(the runs, the next timer, held stretches)"""
        state = self.run.get()
        if state is None:
            return {}, None, set()
        *fields, timer, stretches = state
        return {run_id: Run(*some) for run_id, *some in zip(*fields, strict=True)}, timer, set(stretches)

    def _write(self, runs: dict[int | None, Run], timer: int | None, stretches: set[int]) -> None:
        """Also asks for a timer where something is due before the next one."""
        due = [(min(stretches) + 1) * self.stretch] if stretches else []
        if self.forget is not None:
            due += [min(ends)] if (ends := [run.last_ts + self.forget for run in runs.values() if run.ended]) else []
        if due and (timer is None or min(due) < timer):
            timer = min(due)
            self.handle.registerTimer(timer)
        if runs:
            columns = zip(*((run_id, *run.fields()) for run_id, run in runs.items()), strict=True)
            self.run.update((*map(list, columns), timer, sorted(stretches)))
        else:
            self.run.clear()

    def _stored(self, stretch: int) -> list[tuple]:
        return list(zip(*self.held.getValue((stretch,)), strict=True))

    def _released(self, runs: dict[int | None, Run], upto: dict[int | None, float], stretches: set[int], new: dict[int, list]) -> list[tuple]:
        """Events of each run's rows in stretches that end by its ``upto``, held or
        new, which leave both; rows that stay in such a stretch are stored anew."""
        rows, last = defaultdict(list), max(upto.values(), default=-math.inf)
        for stretch in [k for k in {*stretches, *new} if (k + 1) * self.stretch <= last]:
            some, end, stay = new.pop(stretch, []), (stretch + 1) * self.stretch, []
            known = self._stored(stretch) if stretch in stretches else []
            for row in (*known, *some):
                (rows[row[0]] if upto.get(row[0], -math.inf) >= end else stay).append(row)
            if not stay and known:
                self.held.removeKey((stretch,))
                stretches.remove(stretch)
            elif stay and (some or len(stay) < len(known)):
                self._hold(stretch, stay, stretches)
        events = []
        for run_id, some in rows.items():
            some.sort(key=_order)  # rows of one (ts, step) lie in one stretch, so steps are released whole
            runs[run_id].front = some[-1][1:3]
            events += _release(run_id, runs[run_id], some)
        return events

    def _hold(self, stretch: int, rows: list[tuple], stretches: set[int]) -> None:
        self.held.updateValue((stretch,), tuple(map(list, zip(*rows, strict=True))))
        stretches.add(stretch)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, timer, stretches = self._read()
        out, new, seen, ends = [], defaultdict(list), set(), set()
        for f in rows:
            # a frame without the runs' names is of one run, its key
            names = [None if x is None or x != x else int(x) for x in f["run"]] if "run" in f else [key[0]] * len(f)
            for run_id, ts, step, metric, value, value_is in zip(names, f["ts_ms"].tolist(), f["step"].tolist(), f["metric"], f["value"].tolist(), f["value_is"], strict=True):
                run = runs.get(run_id)
                if run is None:
                    run = runs[run_id] = Run()
                seen.add(run_id)
                if run.last_ts is None or ts > run.last_ts:
                    run.last_ts = ts
                if metric == END_OF_RUN:
                    ends.add(run_id)
                elif run.ended or (run.front is not None and (ts, step) <= run.front):
                    out.append((run_id, step, "late", metric, None, _value(value, value_is), value_is))
                else:
                    new[ts // self.stretch].append((run_id, ts, step, metric, _value(float(value), value_is)))
        for run_id in ends:
            runs[run_id].ended = True
        upto = {run_id: math.inf if runs[run_id].ended else runs[run_id].last_ts - self.delay for run_id in seen}
        out += self._released(runs, upto, stretches, new)
        for stretch, some in new.items():  # the rows that may still be overtaken
            self._hold(stretch, (self._stored(stretch) if stretch in stretches else []) + some, stretches)
        self._write(runs, timer, stretches)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, timer, stretches = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        events = self._released(runs, dict.fromkeys(runs, now), stretches, {})
        if self.forget is not None:
            runs = {run_id: run for run_id, run in runs.items() if not (run.ended and now >= run.last_ts + self.forget)}
        self._write(runs, None if timer is not None and timer <= now else timer, stretches)
        if events:
            yield _frame(events)


def monitor_events(log: DataFrame, delay_seconds: float = 3600, forget_seconds: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Ordered events J1, J3, J4 and late rows of a streaming log. The session
    of the stream must name the state store ``STATE_STORE`` (``stream_session``).
    A bucket's rows of one micro-batch should be some ten thousand."""
    value_is = F.when(F.col("value").isNull(), "null").when(F.isnan("value"), "nan").otherwise("number")
    seen = log.withColumn("seen", F.col("ts").cast("timestamp")).withWatermark("seen", f"{int(delay_seconds * 1000)} milliseconds")
    # runs' names as text: pandas would turn whole numbers beside a null into floats
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket")
    marked = seen.select(bucket, F.col("run_id").cast("long").cast("string").alias("run"), "step", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "metric", "value", value_is.alias("value_is"))
    processor = MonitorProcessor(int(delay_seconds * 1000), None if forget_seconds is None else int(forget_seconds * 1000))
    events = marked.groupBy("bucket").transformWithStateInPandas(processor, EVENT_SCHEMA, "append", "eventTime")
    value = F.when(F.col("value_is") == "nan", F.lit(float("nan"))).otherwise(F.col("value"))
    return events.withColumn("value", value).drop("value_is")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB;
    the settings of ``spark`` stay as they are."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def invalid_events(log: DataFrame) -> DataFrame:
    """J2 on a stream: no state, no order, no row lost."""
    return monitor.invalid_values(log.filter(F.col("metric") != END_OF_RUN))


def events_log_stream(spark: SparkSession, path: str, schema, to_log, max_files: int = MAX_FILES) -> DataFrame:
    """A folder of event files as a stream of log rows; ``to_log`` maps events to the log."""
    return to_log(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path))


def start(events: DataFrame, sink_path: str | None = None, checkpoint_location: str | None = None,
          trigger: dict | None = None, name: str = "monitor"):
    """Append events to a Parquet sink (exactly once with the checkpoint
    location). ``trigger`` defaults to ``availableNow``.

    Without explicit paths both live under the shared folder named by
    ``spark.checkpoint.dir`` (``<dir>/<name>/events`` and ``<dir>/<name>/state``),
    so a restarted driver finds the committed offsets and state again."""
    from ..session import checkpoint_path

    spark = events.sparkSession
    sink_path = sink_path or checkpoint_path(spark, f"{name}/events")
    checkpoint_location = checkpoint_location or checkpoint_path(spark, f"{name}/state")
    q = (events.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint_location).outputMode("append"))
    return q.trigger(**(trigger or {"availableNow": True})).start()
