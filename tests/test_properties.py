"""Properties: implementations agree, noise keeps shape, rewards stay in range."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01
from fumble.functions import metrics as M
from fumble.functions.noise import keyboard_noise, noise_text
from fumble.plans import queries_reward
from fumble.session import spread
from fumble.sources.tables import load


def textbook_distance(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_noise_native_equals_arrow_on_all_documents(spark):
    docs = spread(load(spark, SF01, "documents").select("doc_id", "text"))
    a = docs.select("doc_id", keyboard_noise(F.col("text"), F.col("doc_id"), impl="native").alias("a"))
    b = docs.select("doc_id", keyboard_noise(F.col("text"), F.col("doc_id"), impl="arrow").alias("b"))
    assert a.join(b, "doc_id").filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=300))
def test_noise_keeps_length_and_spaces_on_ascii(text):
    out = noise_text(text, "k", 10)
    assert len(out) == len(text)
    assert [i for i, c in enumerate(text) if c == " "] == [i for i, c in enumerate(out) if c == " "]
    assert len(text.split()) == len(out.split())


def test_noise_rate_is_eleven_percent():
    text = "abcdefghij" * 20000
    out = noise_text(text, "rate", 10)
    changed_or_drawn = sum(1 for a, b in zip(text, out) if a != b)
    # 11 % of keys are redrawn; a redraw keeps the key itself with prob 1/len(neighbours)
    assert 0.08 < changed_or_drawn / len(text) < 0.11


def test_distance_impls_agree_with_textbook(spark):
    rng = random.Random(7)
    alphabet = "abcąę😀 \t"
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        rows.append((a, b, textbook_distance(a, b)))
    rows += [("x" * 300, "y" * 290, 300), ("kitten", "sitting", 3)]
    df = spark.createDataFrame(rows, "a string, b string, want long")
    out = df.select("want", M.edit_distance("a", "b").alias("n"), M.edit_distance("a", "b", "arrow").alias("r"),
                    M.edit_distance("b", "a").alias("sym")).collect()
    for r in out:
        assert r["n"] == r["want"] == r["r"] == r["sym"]
    for a, b, want in rows:
        assert M.bitparallel_distance(a, b) == want


def test_score_impls_agree_on_pairs(spark):
    from fumble.operators import score
    from fumble.plans.common import all_pairs

    p = all_pairs(spark, SF01)
    a = score.score(p, pred_col="typos", expected_col="correct", keep=["pair_id"], impl="native")
    b = score.score(p, pred_col="typos", expected_col="correct", keep=["pair_id"], impl="arrow")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_total_reward_in_range(spark):
    r = queries_reward.q_total_reward(spark, SF01)
    lo, hi = r.agg(F.min("reward"), F.max("reward")).first()
    assert 0.0 <= lo and hi <= 8.0
