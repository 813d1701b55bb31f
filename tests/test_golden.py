"""Golden rows of FIXTURES.md through the Spark operators."""

import pytest
from pyspark.sql import functions as F

from fumble.functions import metrics as M
from fumble.operators import align, reward

C = "To jest przykładowy tekst z wieloma słowami."
T = "To jst przykładowy tekzt z wielloma słowami."
K = "jst -> jest, tekzt -> tekst, wielloma -> wieloma"


def test_texts_are_44_chars():
    assert len(C) == 44 and len(T) == 44


@pytest.mark.parametrize("impl", ["native", "arrow"])
def test_metrics_M(spark, impl):
    rows = [
        ("M1", C, C), ("M2", T, C), ("M3", C[:22], C), ("M4", C * 3, C),
        ("M5", "", C), ("M6", None, C), ("M7", "x", ""),
    ]
    df = spark.createDataFrame(rows, "id string, pred string, exp string")
    out = {r["id"]: r for r in df.select("id", *M.typo_metrics(F.col("pred"), F.col("exp"), impl=impl)).collect()}
    expect = {
        "M1": (1, 0, 1.0, 1.0, 0.0), "M2": (0, 3, 0.931818, 0.931818, 0.068182),
        "M3": (0, 22, 0.5, 0.5, 0.5), "M4": (0, 88, -1.0, 0.333333, 2.0),
        "M5": (0, 44, 0.0, 0.0, 1.0), "M6": (0, 999, 0.0, 0.0, 1.0), "M7": (0, 1, 0.0, 0.0, 0.0),
    }
    for k, (em, d, ca, wa, cer) in expect.items():
        r = out[k]
        assert r["exact_match"] == em, k
        assert r["char_distance"] == d, k
        assert r["char_accuracy"] == pytest.approx(ca, abs=1e-6), k
        assert r["word_accuracy"] == pytest.approx(wa, abs=1e-6), k
        assert r["cer"] == pytest.approx(cer, abs=1e-6), k


def test_positional_reward_R(spark):
    rows = [("R1", C, C), ("R2", T, C), ("R3", C[:22], C), ("R4", C * 3, C), ("R5", "", C), ("R6", "", "")]
    df = spark.createDataFrame(rows, "id string, completion string, correct string")
    out = {r["id"]: r for r in reward.positional_reward(df).collect()}
    expect = {"R1": (44, 1.0, 3.0), "R2": (17, 0.386364, 0.386364), "R3": (22, 0.5, 0.5),
              "R4": (44, 1.0, 0.5), "R5": (0, 0.0, 0.0), "R6": (0, 0.0, 1.0)}
    for k, (m, acc, rew) in expect.items():
        assert out[k]["matches"] == m, k
        assert out[k]["char_accuracy"] == pytest.approx(acc, abs=1e-6), k
        assert out[k]["reward"] == pytest.approx(rew, abs=1e-6), k


def test_reasoning_reward_F(spark):
    layouts = [
        ("F1", f"<think>Widzę kilka błędów w tekście</think><answer>{C}</answer>"),
        ("F2", f"<answer>{C}</answer>"),
        ("F3", C),
        ("F4", "<think>błąd</think><answer>zły tekst</answer>"),
        ("F5", f"<answer>{C}</answer><think>{K}</think>"),
        ("F6", f"<think>{K}</think><answer>{C}</answer>"),
        ("F7", ""),
    ]
    df = spark.createDataFrame([(i, c, C, T) for i, c in layouts], "id string, completion string, correct string, typos string")
    out = {r["id"]: r for r in reward.reasoning_reward(reward.with_word_corrections(df)).collect()}
    expect = {
        "F1": (1.0, 4.5, 0.14, 5.64, 0.0, None),
        "F2": (0.3, 4.5, 0.0, 3.0, 0.0, None),
        "F3": (0.0, 4.5, 0.0, 3.0, 0.0, 1.0),
        "F4": (1.0, 0.818182, 0.15, 1.968182, 0.795455, None),
        "F5": (0.5, 4.5, 1.74, 4.0, 0.0, None),
        "F6": (1.0, 4.5, 1.74, 7.24, 0.0, None),
        "F7": (0.0, 0.0, 0.0, 0.0, 1.0, None),
    }
    for k, (fmt, ans, thk, tot, cer, outside) in expect.items():
        r = out[k]
        assert r["format_score"] == pytest.approx(fmt, abs=1e-6), k
        assert r["answer_score"] == pytest.approx(ans, abs=1e-6), k
        assert r["think_score"] == pytest.approx(thk, abs=1e-3), k
        assert r["reward"] == pytest.approx(tot, abs=1e-3), k
        assert r["cer"] == pytest.approx(cer, abs=1e-6), k
        if outside is None:
            assert r["outside_ratio_recorded"] is None, k
        else:
            assert r["outside_ratio_recorded"] == pytest.approx(outside), k
    assert out["F2"]["think_penalty"] == pytest.approx(1.8)
    assert out["F5"]["format_penalty"] == pytest.approx(2.74, abs=1e-3)
    assert out["F6"]["typos_mentioned"] == 3 and out["F6"]["corrections_total"] == 3


def test_alignment_T():
    assert align.phrase_pairs("Dokąd nocą tupta jeż?", "Dokąf nocą tupta jeż?") == [("Dokąf", "Dokąd")]
    assert align.phrase_pairs(C, T) == [("jst", "jest"), ("tekzt", "tekst"), ("wielloma", "wieloma")]


def test_thinking_target_T1(spark):
    df = spark.createDataFrame([("Dokąd nocą tupta jeż?", "Dokąf nocą tupta jeż?")], "correct string, typos string")
    out = align.thinking_pairs(df).first()
    assert out["target"] == "<think>\\nDokąf -> Dokąd\\n</think>\\n<answer>Dokąd nocą tupta jeż?</answer>"
    empty = align.thinking_pairs(spark.createDataFrame([("a b", "a b")], "correct string, typos string")).first()
    assert empty["target"] == "<think>\\n\\n</think>\\n<answer>a b</answer>"
