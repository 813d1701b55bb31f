"""A caller's own code over batches of rows: rewards, prepare steps, errors of single rows."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from fumble.operators import calls, corrupt, reward
from fumble.plans.queries_reward import length_reward
from fumble.session import checkpoint_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ok", "raise", "short", "long"]), max_size=40), st.integers(1, 9))
def test_only_failing_rows_fail(rows, call_rows):
    def call(first, last):
        some = list(enumerate(rows))[first:last]
        if bad := [i for i, x in some if x == "raise"]:
            raise KeyError(bad[0])
        return [i for i, x in some for _ in range({"ok": 1, "short": 0, "long": 2}[x])]

    # a row too many and one too few in a call look right in number, so these are kept apart here
    if "short" in rows and "long" in rows:
        rows = ["ok" if x == "long" else x for x in rows]
    results, errors = calls.settled(call, len(rows), call_rows)
    for i, x in enumerate(rows):
        want = {"ok": (i, None), "raise": (None, f"KeyError: {i}"), "short": (None, "ValueError: 0 results for 1 rows"), "long": (None, "ValueError: 2 results for 1 rows")}[x]
        assert (results[i], errors[i]) == want


def test_few_more_calls_for_a_few_errors():
    made = []

    def call(first, last):
        made.append(last - first)
        if first <= 500 < last:
            raise ValueError("500")
        return list(range(first, last))

    results, errors = calls.settled(call, 1024, 64)
    assert errors[500] == "ValueError: 500" and sum(e is not None for e in errors) == 1
    assert len(made) <= 16 + 2 * 6


def messages(text):
    return [{"role": "assistant", "content": text}]


def test_batch_reward(spark):
    rows = [(i, f"p {t}", c, g, t) for i, (c, g, t) in enumerate([("abc", "abcd", "x"), ("", "", ""), ("abc", None, "x"), ("ab", "ab", "y")] * 50, start=1)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, completion string, correct_text string, typo_text string").repartition(3)
    got = {r.pair_id: (r.reward, r.error) for r in reward.batch_reward(df, length_reward, columns=("pair_id",), call_rows=7).collect()}
    assert len(got) == len(rows)
    for i, _, c, g, _ in rows:
        if i % 97 == 0:
            assert got[i] == (0.0, f"ValueError: no reward for pair {i}")
        elif g is None:
            assert got[i][0] == 0.0 and got[i][1].startswith("TypeError")
        elif i % 89 == 0:
            assert got[i] == (0.0, "TypeError: a reward is a number, not a text")
        else:
            assert got[i] == (min(len(c), len(g)) / max(len(c), len(g), 1), None)


def test_batch_reward_over_message_lists(spark):
    schema = "pair_id long, prompt string, completion array<struct<role string, content string>>, correct_text string, typo_text string"
    df = spark.createDataFrame([(1, "p t", messages("abcd"), "ab", "t"), (2, "p t", [], "ab", "t"), (3, "p t", None, "ab", "t")], schema)
    got = {r.pair_id: (r.reward, (r.error or "").split(":")[0]) for r in reward.batch_reward(df, length_reward, columns=("pair_id",)).collect()}
    assert got == {1: (0.5, ""), 2: (0.0, "IndexError"), 3: (0.0, "TypeError")}


def test_rewards_that_are_no_plain_numbers(spark):
    import numpy as np

    df = spark.createDataFrame([(i, "p", "c", "t", "x") for i in range(5)], "i long, prompt string, completion string, correct_text string, typo_text string")
    given_ = [True, np.float32(0.5), math.nan, None, 7]
    got = reward.batch_reward(df, lambda prompts, completions, correct_text, typo_text, i: [given_[j] for j in i], name="mine", columns=("i",)).orderBy("i").collect()
    assert [r.mine for r in got[:2]] == [1.0, 0.5] and math.isnan(got[2].mine) and (got[3].mine, got[4].mine) == (0.0, 7.0)
    assert [r.error is None for r in got] == [True, True, True, False, True]


def test_empty_table_and_taken_names(spark):
    df = spark.createDataFrame([], "prompt string, completion string, correct_text string, typo_text string")
    assert reward.batch_reward(df, lambda *a: [], name="r").collect() == []
    with pytest.raises(ValueError, match="error"):
        calls.with_step(df.selectExpr("*", "1 AS error"), lambda prompt: prompt, ["prompt"], "x", T.StringType(), str)


def test_prepare_step_errors_are_kept_by_row(spark):
    rows = [(i, "s", None if i % 10 == 3 else f"text\n{i}" * (i % 4)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)

    def step(doc_id, text):
        if any(i % 13 == 0 for i in doc_id):
            raise RuntimeError("thirteen")
        return [(t, 5 if i % 7 == 0 else json.dumps(t.upper())) for i, t in zip(doc_id, text, strict=True)]

    ok, bad = corrupt.prepare_rows(docs, step, checkpoint_path(spark, "prepare-test"), inputs=("doc_id", "text"))
    good, errors = {r.doc_id: (r.correct, r.typos) for r in ok.collect()}, {r.doc_id: r.error for r in bad.collect()}
    assert len(good) + len(errors) == len(rows) and not good.keys() & errors.keys()
    for i, _, t in rows:
        if i % 13 == 0:
            assert errors[i] == "RuntimeError: thirteen"
        elif i % 7 == 0:
            assert errors[i] == "TypeError: a prepared pair is two texts"
        elif t is None:
            assert errors[i].startswith("AttributeError")
        else:
            assert good[i] == (t.replace("\n", " "), json.dumps(t.upper()).replace("\n", " "))
