"""Whole permutations, disjoint splits and how often sampling reads its table."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from fumble.operators import render, sample


def draw(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def test_every_row_has_its_place(spark):
    keys = [f"k{i}" for i in range(3000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, position_before long").repartition(5)
    got = {r.key: r.position for r in sample.shuffled(df, ["key"], seed=42).collect()}
    order = sorted(keys, key=lambda k: (draw(42, "shuffle", k), k))
    assert got == {k: i for i, k in enumerate(order)}
    other = {r.key: r.position for r in sample.shuffled(df, ["key"], seed=43).collect()}
    assert other != got and sorted(other.values()) == list(range(3000))


def test_repeated_keys_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [(None, 2)] * 20 + [("b", None)], "key string, n long")
    rows = sample.shuffled(df, ["key"]).collect()
    assert sorted(r.position for r in rows) == list(range(71)) and sum(r.n == 1 for r in rows) == 50
    assert sample.shuffled(df.limit(0), ["key"]).collect() == []


def test_plan_of_a_permutation_has_no_single_task(spark):
    df = spark.range(1000).selectExpr("id AS key").repartition(4)
    plan = sample.shuffled(df, ["key"])._jdf.queryExecution().toString()
    single = [x for x in plan.split("== Physical Plan ==")[1].splitlines() if "SinglePartition" in x]
    assert len(single) <= 1  # the window over the shares' sizes


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5])
def test_equal_texts_are_on_one_side(spark, share):
    rows = [(i, f"text {i % 400}" if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    split = sample.disjoint_split(df, share, seed=5)
    sides = defaultdict(set)
    for r in split.collect():
        sides[r.text].add(r.side)
    assert all(len(s) == 1 for s in sides.values())
    tests = sum(s == {"test"} for s in sides.values())
    assert abs(tests - share * len(sides)) < 60
    one = sample.leaks(split.filter("side = 'train'"), split.filter("side = 'test'")).first()
    assert (one.test_texts, one.shared_texts) == (tests, 0)


def test_leaks_counts_texts_once(spark):
    part = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    one = sample.leaks(part("a", "a", "b", None), part("a", "a", "c", "")).first()
    assert (one.test_texts, one.shared_texts) == (3, 2)
    assert tuple(sample.leaks(part(), part()).first()) == (0, 0)


def test_normalised_texts_can_decide(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["A b", "a  B", "a b"] * 30)], "doc_id long, text string")
    sides = sample.disjoint_split(df, 0.5, text=F.lower(F.regexp_replace("text", " +", " "))).select("side").distinct().count()
    assert sides == 1


def counted(spark, df):
    """The table, and a counter of the rows that were read from it."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names)

    return df.mapInArrow(run, df.schema), read


def test_sampling_reads_its_table_twice(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source", "lang")
    n = docs.count()
    table, read = counted(spark, docs)
    sample.sample_rounds(table, rounds=10, k=5).collect()
    assert read.value == 2 * n
    table, read = counted(spark, docs)
    narrow = sample.narrow_keys(table)
    for rounds, seed in ((20, 1), (5, 2)):
        sample.sampled_keys(narrow, rounds, k=5, seed=seed).collect()
    assert read.value == n


def test_strict_role_lookup(spark):
    msgs = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]
    df = spark.createDataFrame([(msgs,)], "m array<struct<role string, content string>>")
    look = lambda role, n, strict: df.select(render.nth_of_role(F.col("m"), role, n, strict=strict).alias("x")).first().x
    assert [look("user", n, True) for n in (0, 1)] == ["a", "c"] and look("assistant", 0, True) == "b"
    assert look("user", 2, False) is None and look("system", 0, False) is None
    for role, n in (("user", 2), ("system", 0)):
        with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
            look(role, n, True)
