"""Evaluation scoring (F1–F10, I1), job ``score``.

``predictions ⋈ pairs -> per-row metrics``. Generation itself is not part of
the engine: predictions arrive as a table ``(idx, prompt, completion)`` or as
a column next to the pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.text import norm_key, truncate

METRIC_COLUMNS = ["exact_match", "char_accuracy", "word_accuracy", "cer", "char_distance"]


def score(df: DataFrame, pred_col: str = "prediction", expected_col: str = "correct",
          impl: str = "native", keep: list[str] | None = None) -> DataFrame:
    """Per-row metric record (F3–F10) next to the kept columns.

    The edit distance is computed once per row and reused by the derived
    metrics (Catalyst's CollapseProject keeps one ``levenshtein`` call).
    """
    keep = keep if keep is not None else [c for c in df.columns]
    return M.score_frame(df, pred_col, expected_col, keep, impl=impl)


def realign_completions(prompts: DataFrame, results: DataFrame) -> DataFrame:
    """Put each generated completion back at its prompt's index.

    ``prompts(idx, prompt)``, ``results(ridx, prompt, completion)``. The key
    is the prompt with all whitespace removed, lower-cased (null -> '').
    Among prompts sharing a key only the largest ``idx`` receives the
    completion; among results sharing a key the one with the largest ``ridx``
    wins; prompts without a result get null. Both sides are reduced to one
    row per key before the join, so duplicated keys cannot multiply rows.
    """
    # Texts become 128-bit digests where they are read; prompts and results are
    # then reduced per digest in one aggregation, and only (index, completion)
    # goes back to the prompts.
    digest = F.unhex(F.md5(norm_key("prompt")))
    nothing = F.lit(None)
    kind = dict(results.dtypes)["completion"]
    both = prompts.select(digest.alias("key"), F.col("idx"), nothing.cast("long").alias("ridx"), nothing.cast(kind).alias("completion")).unionByName(
        results.select(digest.alias("key"), nothing.cast("long").alias("idx"), F.col("ridx").cast("long"), "completion"))
    last = F.max(F.when(F.col("ridx").isNotNull(), F.struct("ridx", "completion")))
    per_key = both.groupBy("key").agg(F.max("idx").alias("idx"), last.alias("r"))
    placed = per_key.filter(F.col("idx").isNotNull() & F.col("r").isNotNull()).select("idx", F.col("r.completion").alias("completion"))
    return prompts.join(placed, on="idx", how="left")


def evaluation_records(scored: DataFrame, typo_col: str = "typos", expected_col: str = "correct",
                       pred_col: str = "prediction", width: int = 200) -> DataFrame:
    """H9: one display row per example, texts truncated to ``width`` characters."""
    keep = [c for c in scored.columns if c not in (typo_col, expected_col, pred_col, "exact_match", "char_accuracy",
                                                    "word_accuracy", "cer", "char_distance")]
    return scored.select(
        *keep,
        truncate(typo_col, width).alias("typo_text"),
        truncate(expected_col, width).alias("correct_text"),
        truncate(pred_col, width).alias("prediction"),
        "exact_match", "char_accuracy", "word_accuracy", "cer",
    )
