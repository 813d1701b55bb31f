"""Percent texts as Python prints them, and tables of metrics that are written again."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fumble.operators import report
from fumble.session import checkpoint_path
from fumble.sources import files


def numbers():
    rng = random.Random(8)
    ties = [s * k / 2**j for j in range(1, 9) for k in range(1, 60) for s in (1, -1)]
    near = [math.nextafter(x, d) for x in ties for d in (-math.inf, math.inf)]
    wide = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 15) for _ in range(2000)]
    return [0.0, -0.0, 0.125, 0.005, 1.005, 2.675, 0.995, 9.995, -1e-9, 2.5, 0.5, 1.5, 99.995, 1e15 + 0.3, 123456789012345.675, 1e18, math.nan, math.inf, -math.inf, *ties, *near, *wide]


@pytest.mark.parametrize(("digits", "signed"), [(0, False), (1, True), (2, False), (2, True), (4, False)])
def test_as_python_prints(spark, digits, signed):
    values = numbers()
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    got = {r.i: r.t for r in df.select("i", report.fixed_text(F.col("v"), digits, signed).alias("t")).collect()}
    pattern = f"{{:{'+' if signed else ''}.{digits}f}}"
    for i, v in enumerate(values):
        if abs(v) < 2**53 / 10**digits or not math.isfinite(v):
            assert got[i] == pattern.format(v), (v, digits)


def test_percent_text_takes_the_product_as_python_does(spark):
    rng = random.Random(9)
    values = [i / 800 for i in range(1200)] + [rng.random() for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    got = {r.i: (r.a, r.b) for r in df.select("i", report.percent_text(F.col("v")).alias("a"), report.percent_text(F.col("v"), signed=True, suffix="pp").alias("b")).collect()}
    assert got == {i: (f"{v * 100:.2f}%", f"{v * 100:+.2f}pp") for i, v in enumerate(values)}
    assert spark.range(1).select(report.percent_text(F.lit(None).cast("double")).alias("x")).first().x is None


def test_metrics_written_again_replace_themselves(spark):
    path = checkpoint_path(spark, "scalars-test")
    row = lambda run, i, a, b: spark.createDataFrame([(run, i, a, b)], "run_id string, eval_idx int, cer double, acc double")
    files.write_scalars(row("a/b c", 0, 0.5, 1.0), path)
    files.write_scalars(row("a/b c", 1, 0.25, None), path)
    files.write_scalars(row("r2", 0, 0.1, 0.2).unionByName(row("r2", 1, 0.3, 0.4)), path)
    files.write_scalars(row("a/b c", 0, 0.75, 2.0), path)  # the first evaluation once more, with other values
    got = sorted(tuple(r) for r in files.read_scalars(spark, path).select("run_id", "eval_idx", "metric", "value").collect())
    want = [("a/b c", 0, "acc", 2.0), ("a/b c", 0, "cer", 0.75), ("a/b c", 1, "acc", None), ("a/b c", 1, "cer", 0.25), ("r2", 0, "acc", 0.2), ("r2", 0, "cer", 0.1), ("r2", 1, "acc", 0.4), ("r2", 1, "cer", 0.3)]
    assert got == want


def test_records_by_key(spark):
    path = checkpoint_path(spark, "records-keyed-test")
    rows = lambda run, n: spark.range(n).select(F.lit(run).alias("run_id"), F.lit(3).alias("eval_idx"), "id")
    for run, n in (("x", 50), ("y", 7), ("x", 20), ("x", 20)):
        files.write_keyed(rows(run, n), path, ("run_id", "eval_idx"))
    assert {r.run_id: r.n for r in spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {"x": 20, "y": 7}
