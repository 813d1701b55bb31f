"""Reward operators (F11–F20, G1–G8, I2–I4), job ``reward``.

``completions ⋈ pairs -> per-row reward components``. Each component is a
column; a component the reference only records in some cases ("presence of
a key is data") is a nullable column that is null when absent.

The word alignment needed by the reasoning reward depends only on the pair,
not on the completion, so it is computed once per pair and then joined to
the pair's completions (several generations per prompt).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics as M
from ..functions import tags as TG
from ..functions.text import col_, py_strip, words_joined
from . import align, calls

# Reward weights and limits of the reasoning reward.
FORMAT_PROPER, FORMAT_BOTH, FORMAT_ANSWER_ONLY = 1.0, 0.5, 0.3
OUTSIDE_LIMIT, OUTSIDE_MAX_PENALTY = 0.1, 0.5
CHAR_WEIGHT, WORD_WEIGHT, EXACT_BONUS = 2.5, 1.5, 0.5
LONG_RATIO, LONG_FACTOR = 1.2, 0.8
STEM_WEIGHT, STEM_MAX = 0.15, 0.5
COVERAGE_WEIGHT = 0.75
CAP_NO_THINK, CAP_BAD_FORMAT = 3.0, 4.0
# Positional reward.
PERFECT_BONUS = 2.0
RATIO_LOW, RATIO_HIGH, RATIO_FACTOR = 0.5, 2.0, 0.5


def unwrap_completion(c: Column, strip: bool) -> Column:
    """A string completion as is, or the first message's ``content`` of a
    message list; a failure (null) becomes ''. E8a strips, E8b does not."""
    return py_strip(F.coalesce(c, F.lit(""))) if strip else F.coalesce(c, F.lit(""))


def unwrap_messages(messages: Column, strip: bool) -> Column:
    """E8 for ``array<struct<role, content>>`` completions."""
    first = F.get(messages, 0)["content"]
    v = F.coalesce(first, F.lit(""))
    return py_strip(v) if strip else v


# ------------------------------------------------------------------ G1

def positional_reward(df: DataFrame, completion: str = "completion", correct: str = "correct") -> DataFrame:
    """G1 with F11–F13: matches / len(correct), +2 on equality, ×0.5 when the
    length ratio is below 0.5 or above 2. Completion is stripped (E8a)."""
    comp = unwrap_completion(F.col(completion), strip=True)
    exp = F.col(correct)
    s = df.withColumn("_c", comp)
    c = F.col("_c")
    matches = M.positional_matches(c, exp)
    n = F.length(exp)
    acc = F.when(n > 0, matches / n).otherwise(F.lit(0.0))
    perfect = c == exp
    ratio = M.length_ratio(c, exp)
    base = acc + F.when(perfect, F.lit(PERFECT_BONUS)).otherwise(F.lit(0.0))
    reward = F.when((ratio < RATIO_LOW) | (ratio > RATIO_HIGH), base * RATIO_FACTOR).otherwise(base)
    return s.select(
        *[x for x in df.columns if x != completion],
        c.alias(completion),
        matches.alias("matches"),
        acc.cast("double").alias("char_accuracy"),
        n.cast("bigint").alias("expected_len"),
        F.length(c).cast("bigint").alias("actual_len"),
        perfect.alias("perfect_match"),
        F.coalesce(reward.cast("double"), F.lit(0.0)).alias("reward"),
        F.when(F.col(correct).isNull(), F.lit("missing correct text")).alias("error"),
    )


# ------------------------------------------------------------------ G2–G6

def format_reward_cols(c: Column) -> dict[str, Column]:
    """1.0 proper / 0.5 both / 0.3 answer only / 0, minus min(0.5, ratio)
    when the outside ratio exceeds 0.1 (floor 0). ``outside_penalty`` and
    ``outside_ratio_recorded`` are null unless the penalty applied."""
    return _format_from(TG.has_think(c), TG.has_answer(c), TG.proper_format(c), TG.outside_ratio(c))


def _format_from(think: Column, answer: Column, proper: Column, ratio: Column) -> dict[str, Column]:
    raw = (
        F.when(proper, F.lit(FORMAT_PROPER))
        .when(think & answer, F.lit(FORMAT_BOTH))
        .when(answer, F.lit(FORMAT_ANSWER_ONLY))
        .otherwise(F.lit(0.0))
    )
    penalised = ratio > OUTSIDE_LIMIT
    penalty = F.least(F.lit(OUTSIDE_MAX_PENALTY), ratio)
    score = F.when(penalised, F.greatest(F.lit(0.0), raw - penalty)).otherwise(raw)
    return {
        "has_think": think, "has_answer": answer, "proper_format": proper,
        "outside_ratio": ratio,
        "format_score": score,
        "outside_penalty": F.when(penalised, penalty),
        "outside_ratio_recorded": F.when(penalised, ratio),
    }


def _answer_from(pred: Column, correct: Column, d: Column, wd: Column,
                 pw: Column | None = None, ew: Column | None = None) -> dict[str, Column]:
    cer = M.cer_reward(d, F.length(correct))
    pw = words_joined(pred) if pw is None else pw
    ew = words_joined(correct) if ew is None else ew
    longest = F.greatest(F.length(pw), F.length(ew))
    wacc = F.when(longest > 0, 1 - wd / longest).otherwise(F.lit(0.0))
    base = F.greatest(F.lit(0.0), CHAR_WEIGHT * (1 - cer)) + F.greatest(F.lit(0.0), WORD_WEIGHT * wacc)
    exact = pred == correct
    with_bonus = base + F.when(exact, F.lit(EXACT_BONUS)).otherwise(F.lit(0.0))
    long_ = M.length_ratio(pred, correct) > LONG_RATIO
    score = F.when(long_, with_bonus * LONG_FACTOR).otherwise(with_bonus)
    return {
        "predicted_text": pred, "cer": cer, "word_acc": wacc, "answer_score": score,
        "exact": F.when(exact, F.lit(True)), "length_penalty": F.when(long_, F.lit(True)),
    }


def answer_text(c: Column) -> Column:
    """F16 as used by the answer reward: the answer block if closed, else the stripped completion."""
    return F.when(TG.has_answer(c), TG.extract_answer(c)).otherwise(py_strip(c))


def with_answer_reward(df: DataFrame, completion: str = "completion", correct: str = "correct",
                       impl: str = "native") -> DataFrame:
    """G3 over a DataFrame, one distance per row and text pair (staged)."""
    s1 = df.withColumn("_pred", answer_text(F.col(completion)))
    s2 = s1.select("*", words_joined("_pred").alias("_pw"), words_joined(correct).alias("_ew"))
    s3 = M.with_two_distances(s2, "_pred", correct, "_pw", "_ew", impl=impl)
    cols = _answer_from(F.col("_pred"), F.col(correct), F.col("_d"), F.col("_wd"), F.col("_pw"), F.col("_ew"))
    return s3.select(*df.columns, *[v.alias(k) for k, v in cols.items()])


def length_band(n: Column) -> Column:
    """G4 length part: <10 → 0; <50 → 0.25·n/50; ≤300 → 0.5; ≤500 → 0.5(1-(n-300)/200); else 0.1."""
    return (
        F.when(n < 10, F.lit(0.0))
        .when(n < 50, 0.25 * (n / 50))
        .when(n <= 300, F.lit(0.5))
        .when(n <= 500, 0.5 * (1 - (n - 300) / 200))
        .otherwise(F.lit(0.1))
    )


def _thinking_from(think: Column, low: Column, n: Column, word_corrs: Column,
                   stems: tuple[str, ...] = TG.ERROR_STEMS) -> dict[str, Column]:
    mentions = TG.stem_mentions(low, stems)
    typos = F.filter(word_corrs, lambda p: p["typo"] != "")
    fixes = F.filter(word_corrs, lambda p: p["correct"] != "")
    typos_hit = F.size(F.filter(typos, lambda p: F.instr(low, F.lower(p["typo"])) > 0)).cast("bigint")
    fixes_hit = F.size(F.filter(fixes, lambda p: F.instr(low, F.lower(p["correct"])) > 0)).cast("bigint")
    n_typos, n_fixes = F.size(typos).cast("bigint"), F.size(fixes).cast("bigint")
    typo_cov = F.when(n_typos > 0, typos_hit / n_typos).otherwise(F.lit(0.0))
    fix_cov = F.when(n_fixes > 0, fixes_hit / n_fixes).otherwise(F.lit(0.0))
    score = (length_band(n) + F.least(F.lit(STEM_MAX), mentions * STEM_WEIGHT)
             + COVERAGE_WEIGHT * typo_cov + COVERAGE_WEIGHT * fix_cov)
    only = lambda x: F.when(think, x)
    return {
        "think_score": F.when(think, score).otherwise(F.lit(0.0)),
        "think_len": only(n.cast("bigint")), "think_mentions": only(mentions),
        "typos_mentioned": only(typos_hit), "typos_total": only(n_typos), "typo_coverage": only(typo_cov),
        "corrections_mentioned": only(fixes_hit), "corrections_total": only(n_fixes),
        "correction_coverage": only(fix_cov),
    }


def with_word_corrections(pairs: DataFrame, typo_col: str = "typos", correct_col: str = "correct") -> DataFrame:
    """D2 once per pair (the reasoning reward's typo list)."""
    return pairs.withColumn("word_corrections", align.corrections(correct_col, typo_col, mode="word"))


def reasoning_reward(df: DataFrame, completion: str = "completion", correct: str = "correct",
                     word_corrs: str = "word_corrections", impl: str = "native",
                     stems: tuple[str, ...] = TG.ERROR_STEMS) -> DataFrame:
    """Format + answer + reasoning, capped at 3.0 without a think
    block and at 4.0 when not properly ordered; failed rows give 0.0.

    ``df`` holds one completion per row next to its pair's ``correct`` text
    and D2 corrections (see ``with_word_corrections``). Tag tests, the answer
    distance and the reasoning text are each computed once per row in
    successive projections.
    """
    base = df.withColumn("_c", unwrap_completion(F.col(completion), strip=False))
    c = F.col("_c")
    # tag tests and the reasoning text once per row
    tagged = base.select("*", TG.has_think(c).alias("_ht"), TG.has_answer(c).alias("_ha"),
                         TG.proper_format(c).alias("_pf"), TG.outside_ratio(c).alias("_or"),
                         TG.extract_reasoning(c).alias("_think"))
    tagged = tagged.select("*", F.lower("_think").alias("_tlow"), F.length("_think").alias("_tlen"))
    fmt = _format_from(F.col("_ht"), F.col("_ha"), F.col("_pf"), F.col("_or"))
    thk = _thinking_from(F.col("_ht"), F.col("_tlow"), F.col("_tlen"), F.col(word_corrs), stems)
    staged = with_answer_reward(tagged, "_c", correct, impl).select(
        *df.columns, "_c", "predicted_text", "cer", "word_acc", "answer_score", "exact", "length_penalty",
        *[v.alias(k) for k, v in {**fmt, **thk}.items()])
    total = F.col("format_score") + F.col("answer_score") + F.col("think_score")
    capped = (
        F.when(~F.col("has_think"), F.least(total, F.lit(CAP_NO_THINK)))
        .when(~F.col("proper_format"), F.least(total, F.lit(CAP_BAD_FORMAT)))
        .otherwise(total)
    )
    # the aligner is reached only with a closed think block
    failed = F.col(correct).isNull() | (F.col("has_think") & F.col(word_corrs).isNull())
    scored = staged.drop("_c").select(
        "*",
        F.when(~F.col("has_think") & (total > CAP_NO_THINK), total - CAP_NO_THINK).alias("think_penalty"),
        F.when(F.col("has_think") & ~F.col("proper_format") & (total > CAP_BAD_FORMAT),
               total - CAP_BAD_FORMAT).alias("format_penalty"),
        capped.cast("double").alias("reward"),
        failed.alias("_failed"),
    )
    # a failed row records its error and a reward of 0, and no component
    parts = [x for x in scored.columns if x not in (*df.columns, "reward", "_failed")]
    return scored.select(
        *df.columns,
        *[F.when(~F.col("_failed"), F.col(x)).alias(x) for x in parts],
        F.when(F.col("_failed"), F.lit(0.0)).otherwise(F.col("reward")).alias("reward"),
        F.when(F.col("_failed"), F.lit("missing pair text")).alias("error"),
    )


def legacy_reward(df: DataFrame, completion: str = "completion", correct: str = "correct",
                  impl: str = "native") -> DataFrame:
    """The earlier profile — format 1/0.5/0.3; answer ``3(1-cer)`` inside
    answer tags or ``2(1-cer)`` on the whole completion; reasoning 0.5 when
    20 < length < 500 plus 0.5 when one of six stems occurs."""
    c = unwrap_completion(F.col(completion), strip=False)
    exp = F.col(correct)
    think, answer, proper = TG.has_think(c), TG.has_answer(c), TG.proper_format(c)
    fmt = (F.when(proper, F.lit(1.0)).when(think & answer, F.lit(0.5)).when(answer, F.lit(0.3)).otherwise(F.lit(0.0)))
    # one text and so one distance per row: the answer block, or the whole completion
    text = F.when(answer, TG.extract_answer(c)).otherwise(c)
    weight = F.when(answer, F.lit(3.0)).otherwise(F.lit(2.0))
    ans = F.greatest(F.lit(0.0), weight * (1 - M.cer_reward(M.edit_distance(text, exp, impl), F.length(exp))))
    content = TG.extract_reasoning(c)
    n = F.length(content)
    stem_hit = TG.stem_mentions(F.lower(content), TG.LEGACY_STEMS) > 0
    thk = F.when(think & (n > 20) & (n < 500),
                 F.lit(0.5) + F.when(stem_hit, F.lit(0.5)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    return df.select("*", fmt.alias("format_score"), ans.alias("answer_score"), thk.alias("think_score"),
                     (fmt + ans + thk).alias("reward"))


def completion_text(completions: DataFrame, strip: bool = False) -> DataFrame:
    """``completion`` as text, from a string or from a message list in
    ``messages`` where that is given."""
    if "messages" not in completions.columns:
        return completions.withColumn("completion", unwrap_completion(F.col("completion"), strip))
    text = F.when(F.col("messages").isNotNull(), unwrap_messages(F.col("messages"), strip)).otherwise(unwrap_completion(F.col("completion"), strip))
    return completions.withColumn("completion", text).drop("messages")


def join_completions(completions: DataFrame, pairs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Completions with their pairs on the pair's key, never by position.

    Returns (matched, unmatched completions): what finds no pair is reported
    instead of silently cut off (Q11). A pair has any number of completions;
    AQE splits the join where one pair has very many."""
    matched = completions.join(pairs, on=key, how="inner")
    unmatched = completions.join(pairs.select(*key), on=key, how="left_anti")
    return matched, unmatched


def user_reward(df: DataFrame, fn: Callable[[DataFrame], Column], name: str = "user_reward") -> DataFrame:
    """A user's reward, a function from the scored rows to a column (an
    expression, or a ``pandas_udf('double')`` applied to named columns)."""
    return df.withColumn(name, fn(df))


def _number(x: object) -> float:
    if isinstance(x, str):
        raise TypeError("a reward is a number, not a text")
    return float(x)


def batch_reward(df: DataFrame, fn: Callable[..., list], name: str = "reward", prompt: str = "prompt", completion: str = "completion", correct: str = "correct_text",
                 typos: str = "typo_text", columns: tuple[str, ...] = (), call_rows: int = calls.CALL_ROWS) -> DataFrame:
    """U1 with G7: a user's reward as a plain function of batches of rows,
    ``fn(prompts, completions, correct_text, typo_text, **columns) -> numbers``.

    A completion is a text or a list of messages, as the column holds it;
    ``columns`` names further columns that are handed over by their names. A row
    for which the function raises, or returns what is no number, has a reward of
    0.0 and its error; the other rows of the batch keep their rewards."""
    def step(**lists: list) -> list:
        return fn(lists[prompt], lists[completion], lists[correct], lists[typos], **{c: lists[c] for c in columns})

    rated = calls.with_step(df, step, [prompt, completion, correct, typos, *columns], name, T.DoubleType(), _number, call_rows)
    return rated.withColumn(name, F.when(F.col("error").isNotNull(), F.lit(0.0)).otherwise(F.col(name)))
