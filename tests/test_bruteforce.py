"""Queries without a SQL oracle, checked from the rules of the operators."""

import random
from collections import Counter

import pytest
from conftest import SF001
from fumble.functions import tags as TG
from fumble.operators import align, reward
from fumble.plans import queries_reward as Q
from fumble.plans.common import all_pairs


@pytest.fixture(scope="module")
def pairs(spark):
    return {r["pair_id"]: (r["correct"], r["typos"], r["lang"]) for r in all_pairs(spark, SF001).collect()}


def rebuilt(source, blocks_of):
    """The target that the changed blocks lead to: every source block is found
    at or after the end of the one before and exchanged."""
    out, at = [], 0
    for old, new in blocks_of:
        if old:
            first = next(i for i in range(at, len(source)) if source[i : i + len(old)] == old)
        else:
            return None  # an addition has no place of its own
        out += source[at:first] + new
        at = first + len(old)
    return out + source[at:]


def test_blocks_rebuild_the_target():
    """Equal words and changed blocks alternate and give both texts."""
    rng = random.Random(7)
    for _ in range(3000):
        source = [f"s{rng.randrange(9)}" for _ in range(rng.randrange(14))]
        target = [w if rng.random() < 0.7 else f"t{rng.randrange(9)}" for w in source if rng.random() < 0.9]
        blocks = list(align.changed_blocks(source, target))
        assert all(old != new for old, new in blocks)
        assert Counter(source) - Counter(w for old, _ in blocks for w in old) == Counter(target) - Counter(w for _, new in blocks for w in new)
        if all(old for old, _ in blocks) and len(set(source)) == len(source):
            assert rebuilt(source, blocks) == target


@pytest.mark.parametrize("original,typos,phrases,words", [
    ("a b c", "a b c", [], []),
    ("a b c", "a x c", [("x", "b")], [("x", "b")]),
    ("a b c", "a c", [("", "b")], [("", "b")]),
    ("a c", "a b c", [("b", "")], [("b", "")]),
    ("", "x y", [("x y", "")], [("x", ""), ("y", "")]),
    ("x y", "", [("", "x y")], [("", "x"), ("", "y")]),
    ("a b c d", "a x d", [("x", "b c")], [("x", "b")]),        # a surplus word is left out
    ("Ala ma", "ala ma", [("ala", "Ala")], []),                # D2 ignores case
])
def test_hand_made_corrections(original, typos, phrases, words):
    assert align.phrase_pairs(original, typos) == phrases
    assert align.word_pairs(typos, original) == words


def test_correction_counts_of_all_documents(spark, pairs):
    want = Counter()
    for correct, typos, lang in pairs.values():
        want.update((lang, *p) for p in align.phrase_pairs(correct, typos))
    got = {(r.lang, r.typo, r.correct): r.n for r in Q.q_correction_counts(spark, SF001).collect()}
    assert got == dict(want)


def test_thinking_targets_end_with_the_correct_text(spark, pairs):
    whole = {r["pair_id"]: (r["correct"], r["typos"]) for r in all_pairs(spark, SF001, trim=False).collect()}
    for r in Q.q_thinking_target(spark, SF001).collect():
        correct, typos = whole[r.pair_id]
        body, answer = r.target[len("<think>" + align.SEP):].split(align.SEP + "</think>" + align.SEP + "<answer>")
        assert answer == correct + "</answer>" and r.typos == typos
        n = len(align.phrase_pairs(correct, typos))
        assert body.count(align.ARROW) + body.count(align.DELETE_PREFIX) + body.count(align.INSERT_PREFIX) == n


# One row for each band, cap and penalty, worked out by hand. The correct text has ten characters.
T = "abcde fghi"
BASE = {"think": 0.0, "format": 1.0, "answer": 4.5, "total": None}
ROWS = [
    # completion, corrections, format, answer, think, reward
    (f"<think>{'b' * 9}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.0, 5.5),
    (f"<think>{'b' * 10}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.05, 5.55),
    (f"<think>{'b' * 49}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.245, 5.745),
    (f"<think>{'b' * 50}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.5, 6.0),
    (f"<think>{'b' * 300}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.5, 6.0),
    (f"<think>{'b' * 400}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.25, 5.75),
    (f"<think>{'b' * 500}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.0, 5.5),
    (f"<think>{'b' * 501}</think><answer>{T}</answer>", [], 1.0, 4.5, 0.1, 5.6),
    (f"<think>zamiast</think><answer>{T}</answer>", [], 1.0, 4.5, 0.15, 5.65),
    (f"<think>zamiast powinno pomył zmieni</think><answer>{T}</answer>", [], 1.0, 4.5, 0.14 + 0.5, 6.14),         # 28 characters, four stems of which 0.5 counts
    (f"<think>xx yy</think><answer>{T}</answer>", [("xx", "qq"), ("zz", "yy")], 1.0, 4.5, 0.75, 6.25),   # half of each
    (f"<think>xx</think><answer>{T}</answer>", [("xx", "")], 1.0, 4.5, 0.75, 6.25),                      # nothing to correct
    (f"<answer>{T}</answer>", [], 0.3, 4.5, 0.0, 3.0),                                                   # cap without reasoning
    (T, [], 0.0, 4.0 + 0.5 - 0.0, 0.0, 3.0),                                                             # no tags: all outside, format stays 0
    (f"<answer>{T}</answer><think>{'b' * 50}</think>", [], 0.5, 4.5, 0.5, 4.0),                          # cap out of order
    (f"<think>{'b' * 50}</think><answer>{T}{T}</answer>", [], 1.0, (0.0 + 1.5 * 0.5) * 0.8, 0.5, 2.1),     # an answer twice as long
]


def test_hand_made_rewards(spark):
    rows = [(i, T, c, [{"typo": a, "correct": b} for a, b in corrs]) for i, (c, corrs, *_) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "i int, correct string, completion string, word_corrections array<struct<typo:string,correct:string>>")
    got = {r.i: r for r in reward.reasoning_reward(df).collect()}
    for i, (_, _, fmt, ans, think, total) in enumerate(ROWS):
        r = got[i]
        assert [r.format_score, r.answer_score, r.think_score, r.reward] == pytest.approx([fmt, ans, think, total]), ROWS[i][0][:60]


def test_failed_rows_record_nothing_but_the_error(spark):
    schema = "i int, correct string, completion string, word_corrections array<struct<typo:string,correct:string>>"
    rows = [(0, None, f"<think>b</think><answer>{T}</answer>", []), (1, T, f"<think>b</think><answer>{T}</answer>", None), (2, T, f"<answer>{T}</answer>", None)]
    got = {r.i: r.asDict() for r in reward.reasoning_reward(spark.createDataFrame(rows, schema)).collect()}
    for i in (0, 1):
        left = {k: v for k, v in got[i].items() if k not in ("i", "correct", "completion", "word_corrections")}
        assert left.pop("reward") == 0.0 and left.pop("error") and not any(v is not None for v in left.values())
    # without a closed think block the corrections are never asked for
    assert got[2]["error"] is None and got[2]["reward"] == 3.0


def test_every_branch_is_met_by_the_registered_layouts(spark):
    """Counts over all documents: a branch that no layout reaches would prove nothing."""
    r = Q._reasoning(spark, SF001, "positional").cache()
    n = lambda cond: r.filter(cond).count()
    for cond in ("think_len < 10", "think_len >= 10 and think_len < 50", "think_len between 50 and 300", "think_len between 301 and 500", "think_len > 500",
                 "think_mentions = 0", "think_mentions > 0", "typo_coverage > 0 and typo_coverage < 1", "correction_coverage > 0", "outside_penalty = 0.5",
                 "outside_penalty < 0.5", "outside_ratio > 0 and outside_penalty is null", "length_penalty", "exact", "think_penalty > 0", "format_penalty > 0",
                 "cer > 0 and cer < 1 and has_answer", "format_score = 1", "format_score = 0.5", "format_score = 0", "has_think and not proper_format and has_answer"):
        assert n(cond) > 0, cond
    failed = Q._failing(spark, SF001)
    assert failed.filter("error is not null").count() > 0 and len(TG.ERROR_STEMS) == 10
    r.unpersist()
