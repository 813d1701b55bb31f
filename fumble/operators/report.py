"""Aggregations and reports (H1–H10, J6), job ``report``.

All aggregates are algebraic (sum / count / min / max / sum of squares), so
Spark plans a partial aggregation in every map task and a final one after
the shuffle; no group is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evaluation means of an empty evaluation (H1).
EMPTY_EVALUATION = {"exact_match_rate": 0.0, "avg_char_accuracy": 0.0, "avg_word_accuracy": 0.0, "avg_cer": 1.0}


def evaluation_means(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H1: mean exact match, char accuracy, word accuracy, CER (per group).

    A global evaluation of zero rows yields ``0, 0, 0, 1``.
    """
    aggs = [
        F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"),
        F.avg("char_accuracy").alias("avg_char_accuracy"),
        F.avg("word_accuracy").alias("avg_word_accuracy"),
        F.avg("cer").alias("avg_cer"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    if by:
        return scored.groupBy(*by).agg(*aggs)
    out = scored.groupBy().agg(*aggs)
    return out.select(
        *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in EMPTY_EVALUATION.items()], "n_rows"
    )


def baseline_comparison(means: DataFrame, run_col: str = "run_id", eval_col: str = "eval_idx") -> DataFrame:
    """H2 + J6: each evaluation against the first evaluation of its run.

    improvement = current − baseline (reversed for CER);
    pct_change = improvement / max(baseline, 0.001) × 100.
    """
    w = Window.partitionBy(run_col).orderBy(eval_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    metrics = [("exact_match_rate", "exact_match", False), ("avg_char_accuracy", "char_accuracy", False),
               ("avg_word_accuracy", "word_accuracy", False), ("avg_cer", "cer", True)]
    cols: list[Column] = [F.col(run_col), F.col(eval_col)]
    for src, name, lower_is_better in metrics:
        base = F.first(F.col(src)).over(w)
        cur = F.col(src)
        imp = (base - cur) if lower_is_better else (cur - base)
        cols += [
            base.alias(f"baseline_{name}"),
            cur.alias(f"current_{name}"),
            imp.alias(f"improvement_{name}"),
            (imp / F.greatest(base, F.lit(0.001)) * 100).alias(f"pct_change_{name}"),
        ]
    return means.select(*cols)


def reward_batch_stats(df: DataFrame, batch_col: str = "batch", reward_col: str = "reward") -> DataFrame:
    """H3: mean/min/max/population std of reward, mean char accuracy, perfect
    ratio; a failed row is not perfect."""
    return df.groupBy(batch_col).agg(
        F.avg("char_accuracy").alias("mean_char_accuracy"),
        F.avg(F.coalesce(F.col("perfect_match"), F.lit(False)).cast("double")).alias("perfect_match_ratio"),
        F.avg(reward_col).alias("reward_mean"),
        F.min(reward_col).alias("reward_min"),
        F.max(reward_col).alias("reward_max"),
        F.stddev_pop(reward_col).alias("reward_std"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def component_batch_stats(df: DataFrame, batch_col: str = "batch") -> DataFrame:
    """Batch statistics of the reasoning reward.

    CER and word accuracy skip failed rows (null components); format, thinking
    and answer scores count failed rows as 0.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.groupBy(batch_col).agg(
        F.avg("cer").alias("character_error_rate"),
        F.avg(1 - F.col("word_acc")).alias("word_error_rate"),
        F.avg("word_acc").alias("word_accuracy"),
        F.avg(z("format_score")).alias("format_score"),
        F.avg(z("think_score")).alias("thinking_score"),
        F.avg(z("answer_score")).alias("answer_score"),
        F.avg("reward").alias("reward_mean"),
        F.min("reward").alias("reward_min"),
        F.max("reward").alias("reward_max"),
        F.stddev_pop("reward").alias("reward_std"),
        F.avg((z("think_score") > 0).cast("double")).alias("has_think_ratio"),
        F.avg(F.coalesce(F.col("exact"), F.lit(False)).cast("double")).alias("exact_match_ratio"),
        F.count_if(F.col("think_penalty").isNotNull()).cast("bigint").alias("think_penalty_count"),
        F.count_if(F.col("format_penalty").isNotNull()).cast("bigint").alias("format_penalty_count"),
        F.count_if(F.col("outside_penalty").isNotNull()).cast("bigint").alias("outside_penalty_count"),
        F.avg(F.coalesce(F.col("outside_ratio_recorded"), F.lit(0.0))).alias("mean_outside_ratio"),
        F.avg(F.coalesce(F.col("typos_mentioned"), F.lit(0)).cast("double")).alias("mean_typos_mentioned"),
        F.avg(F.coalesce(F.col("typos_total"), F.lit(0)).cast("double")).alias("mean_typos_total"),
        F.avg(F.coalesce(F.col("corrections_mentioned"), F.lit(0)).cast("double")).alias("mean_corrections_mentioned"),
        F.avg(F.coalesce(F.col("corrections_total"), F.lit(0)).cast("double")).alias("mean_corrections_total"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def first_batch_profile(df: DataFrame, run_col: str = "run_id", batch_col: str = "batch", text_col: str = "completion",
                        reward_col: str = "reward") -> DataFrame:
    """H7: completion-length and reward profile of the first batch of each run.

    Every batch is profiled by a partial aggregate - one narrow row each - and
    the profile of the least batch is kept, so texts are read once and no join
    is needed."""
    n = F.length(F.col(text_col))
    per_batch = df.groupBy(run_col, batch_col).agg(
        F.avg(n).alias("mean_len"), F.min(n).cast("bigint").alias("min_len"), F.max(n).cast("bigint").alias("max_len"),
        F.avg(reward_col).alias("reward_mean"), F.min(reward_col).alias("reward_min"),
        F.max(reward_col).alias("reward_max"),
        F.count_if(F.col(reward_col) > 0).cast("bigint").alias("nonzero"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    names = [c for c in per_batch.columns if c != run_col]
    first = per_batch.groupBy(run_col).agg(F.min_by(F.struct(*names), batch_col).alias("p"))
    return first.select(run_col, *[F.col(f"p.{c}").alias(c) for c in names])


def example_rows(df: DataFrame, batch_col: str = "batch", order_col: str = "pos", per_batch: int = 3,
                 every: int = 10) -> DataFrame:
    """H8: first ``per_batch`` rows of every ``every``-th batch (a top-k per
    group); batches count from 1, so the 10th, 20th ... are shown.

    Works on any columns: pick narrow keys first and score what was picked."""
    w = Window.partitionBy(batch_col).orderBy(order_col)
    return (
        df.filter((F.col(batch_col) > 0) & (F.col(batch_col) % every == 0))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= per_batch)
        .drop("_rn")
    )


def reasoning_examples(scored: DataFrame, width: int = 100) -> DataFrame:
    """H8, reasoning form: the extracted answer (else the first ``width``
    characters and ``...``), CER, format flags, outside share and the typos
    and corrections that were mentioned, as ``k/n``."""
    cut = F.concat(F.substring("completion", 1, width), F.lit("..."))
    ratio = lambda a, b: F.concat(F.coalesce(F.col(a), F.lit(0)).cast("string"), F.lit("/"), F.coalesce(F.col(b), F.lit(0)).cast("string"))
    keep = [c for c in ("batch", "pair_id", "doc_id", "gen_idx", "layout") if c in scored.columns]
    return scored.select(
        *keep,
        F.when(F.col("has_answer"), F.col("predicted_text")).otherwise(cut).alias("shown"),
        "cer", "has_think", "has_answer", "proper_format",
        percent_text(F.coalesce(F.col("outside_ratio"), F.lit(0.0)), digits=0).alias("outside"),
        ratio("typos_mentioned", "typos_total").alias("typos"),
        ratio("corrections_mentioned", "corrections_total").alias("corrections"),
        "reward",
    )


# Row labels of the comparison table.
COMPARISON_LABELS = (("exact_match", "Exact Match"), ("char_accuracy", "Char Accuracy"),
                     ("word_accuracy", "Word Accuracy"), ("cer", "CER (lower=better)"))


SPLIT = 134217729.0  # 2^27 + 1, parts a double into two halves of its digits


def fixed_text(v: Column, digits: int, signed: bool = False) -> Column:
    """a double with ``digits`` decimals, rounded as its exact binary value
    is, ties to even; ``signed`` writes a plus too.

    The product with 10^digits is rounded to a double; only where that stands
    half way between two whole numbers does its rounding error decide, which the
    products of the factors' halves give exactly. From 2^53 / 10^digits on, Java's
    formatter writes the number."""
    scale = float(10**digits)
    by_high = scale * SPLIT - (scale * SPLIT - scale)
    by_low = scale - by_high

    def bound(c: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is worked out once a row."""
        return F.element_at(F.transform(F.array(c), use), 1)

    def rounded(size: Column) -> Column:
        def of_high(high: Column) -> Column:
            low, product = size - high, size * scale
            error = ((high * by_high - product) + high * by_low + low * by_high) + low * by_low

            def of_whole(whole: Column) -> Column:
                rest = product - whole
                odd = F.pmod(whole, F.lit(2)) == 1
                up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
                return whole + F.when(up, 1).otherwise(0)

            return bound(F.floor(product), of_whole)

        return bound(size * SPLIT - (size * SPLIT - size), of_high)

    def digits_of(n: Column) -> Column:
        if not digits:
            return n.cast("string")
        return F.concat(F.floor(n / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"))

    size = F.abs(v)
    most = float(2**53) / scale  # beyond, the product of a whole number of units is shown by the formatter
    shown = bound(F.when(size < most, rounded(size)), digits_of)
    plain = F.when(F.isnan(v), "nan").when(size == float("inf"), "inf").when(size < most, shown).otherwise(F.format_string(f"%.{digits}f", size))
    negative = (v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-")))
    sign = F.when(~F.isnan(v) & negative, "-").otherwise("+" if signed else "")
    return F.when(v.isNotNull(), F.concat(sign, plain))


def percent_text(c: Column, digits: int = 2, signed: bool = False, suffix: str = "%") -> Column:
    """a fraction as display text, e.g. ``12.34%`` or ``+1.50pp``; see ``fixed_text``."""
    return F.concat(fixed_text(c * 100, digits, signed), F.lit(suffix))


def comparison_display(cmp: DataFrame, run_col: str = "run_id", eval_col: str = "eval_idx") -> DataFrame:
    """H2 display: one row per (run, evaluation, metric) with the formatted
    baseline, current value, improvement in points and relative change."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(f"baseline_{k}").alias("b"), F.col(f"current_{k}").alias("c"),
                 F.col(f"improvement_{k}").alias("i"), F.col(f"pct_change_{k}").alias("p"))
        for k, label in COMPARISON_LABELS])
    x = cmp.select(run_col, eval_col, F.explode(rows).alias("r"))
    return x.select(
        run_col, eval_col, F.col("r.metric").alias("metric"),
        percent_text(F.col("r.b")).alias("baseline"), percent_text(F.col("r.c")).alias("current"),
        percent_text(F.col("r.i"), signed=True, suffix="pp").alias("improvement"),
        F.concat(fixed_text(F.col("r.p"), 1, signed=True), F.lit("%")).alias("pct_change"),
    )
