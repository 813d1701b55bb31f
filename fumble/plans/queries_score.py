"""Registered queries of the ``score`` and ``report`` jobs.

Metrics are computed on the given texts. DuckDB's ``levenshtein`` counts
bytes, so the oracle maps the alphabet's non-ASCII characters to unused
one-byte codes inside that call (``common.distance_sql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import keyboard_noise, noise_sql_duckdb
from ..functions.text import WS_RE2
from ..operators import corrupt, report, sample, score
from ..session import rebalance
from ..sources.tables import load
from .common import DIST_IMPL, K_PER_SOURCE, NOISE_IMPL, NOISE_SEED, PROB, SEED, all_pairs, distance_sql, id_sql, pairs_sql, r6, u_sql

NOISE_LEVELS = (0.0, 0.05, 0.1, 0.2)


def _metric_cols():
    return ["exact_match", r6(F.col("char_accuracy")).alias("char_accuracy"),
            r6(F.col("word_accuracy")).alias("word_accuracy"), r6(F.col("cer")).alias("cer"), "char_distance"]


def q_typo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3–F10 for every document's pair, prediction = the uncorrected typo text."""
    pairs = all_pairs(spark, sf_dir)
    return score.score(pairs, pred_col="typos", expected_col="correct", keep=["pair_id"], impl=DIST_IMPL).select(
        "pair_id", *_metric_cols())


def q_evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: one display row per pair (texts truncated to 200 characters)."""
    pairs = all_pairs(spark, sf_dir).withColumn("prediction", F.col("typos"))
    scored = score.score(pairs, pred_col="prediction", expected_col="correct",
                         keep=["pair_id", "typos", "correct", "prediction"], impl=DIST_IMPL)
    rec = score.evaluation_records(scored)
    return rec.select("pair_id", "typo_text", "correct_text", "prediction", "exact_match",
                      *[r6(F.col(c)).alias(c) for c in ("char_accuracy", "word_accuracy", "cer")])


def _means(scored: DataFrame, by: list[str]) -> DataFrame:
    m = report.evaluation_means(scored, by=by)
    return m.select(*by, *[r6(F.col(c)).alias(c) for c in
                           ("exact_match_rate", "avg_char_accuracy", "avg_word_accuracy", "avg_cer")], "n_rows")


def q_metrics_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 per language over every document's pair."""
    pairs = all_pairs(spark, sf_dir)
    return _means(score.score(pairs, pred_col="typos", expected_col="correct", keep=["lang"], impl=DIST_IMPL), ["lang"])


def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> B1 (20 per source) -> C1 -> C2 -> C3 (the minimum slice)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    sampled = sample.sample_per_source(docs, k=K_PER_SOURCE, seed=SEED)
    passages = rebalance(corrupt.make_passages(sampled, seed=SEED, keep=("lang",)))
    pairs, _ = corrupt.pairs_of_passages(passages, external=None, noise_seed=NOISE_SEED, prob=PROB, keep=("lang",))
    return pairs


def q_noise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How bad is keyboard noise per language if nothing is corrected? (flagship)"""
    pairs = sampled_pairs(spark, sf_dir)
    return _means(score.score(pairs, pred_col="typos", expected_col="correct", keep=["lang"], impl=DIST_IMPL), ["lang"])


def q_baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 + J6: several evaluations of every document's pair (one per noise
    level; the first is the baseline), compared with the first, per language.

    The levels are generated per row (one scan, no join) and carried as a
    column into the noise expression.
    """
    from .common import all_passages
    p = all_passages(spark, sf_dir)
    levels = F.array(*[F.struct(F.lit(i).alias("eval_idx"), F.lit(x).alias("prob")) for i, x in enumerate(NOISE_LEVELS)])
    e = p.select("lang", "pair_id", "passage", F.explode(levels).alias("lv"))
    noisy = keyboard_noise(F.col("passage"), F.col("pair_id"), prob=F.col("lv.prob"), seed=NOISE_SEED, impl=NOISE_IMPL)
    allp = e.select(F.col("lang").alias("run_id"), F.col("lv.eval_idx").alias("eval_idx"),
                    corrupt.flatten_newlines("passage").alias("correct"), corrupt.flatten_newlines(noisy).alias("prediction"))
    scored = score.score(allp, keep=["run_id", "eval_idx"], impl=DIST_IMPL)
    means = report.evaluation_means(scored, by=["run_id", "eval_idx"])
    cmp = report.baseline_comparison(means)
    return cmp.select("run_id", "eval_idx", *[r6(F.col(c)).alias(c) for c in cmp.columns if c not in ("run_id", "eval_idx")])


def q_comparison_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 display, F22: the comparison as printed."""
    return report.comparison_display(q_baseline_comparison(spark, sf_dir))


# ------------------------------------------------------------------ oracles

def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def _words_sql(x: str) -> str:
    return f"regexp_replace({_strip_sql(x)}, '{WS_RE2}+', ' ', 'g')"


def metrics_sql(pred: str, exp: str) -> str:
    """DuckDB select-list of the five metrics on the given texts."""
    d = distance_sql(pred, exp)
    n = f"length({exp})"
    pw, ew = _words_sql(pred), _words_sql(exp)
    wd = distance_sql(pw, ew)
    return (
        f"CASE WHEN {pred} IS NULL OR {exp} IS NULL THEN 0 ELSE CAST({_strip_sql(pred)} = {_strip_sql(exp)} AS INTEGER) END AS exact_match, "
        f"CASE WHEN {pred} IS NULL OR {exp} IS NULL THEN 0.0 WHEN {n} > 0 THEN ({n} - {d}) / CAST({n} AS DOUBLE) ELSE 0.0 END AS char_accuracy, "
        f"CASE WHEN {pred} IS NULL OR {exp} IS NULL THEN 0.0 WHEN length({ew}) > 0 THEN 1 - {wd} / CAST(greatest(length({pw}), length({ew})) AS DOUBLE) ELSE 0.0 END AS word_accuracy, "
        f"CASE WHEN {pred} IS NULL OR {exp} IS NULL THEN 1.0 WHEN {n} > 0 THEN {d} / CAST({n} AS DOUBLE) ELSE 0.0 END AS cer, "
        f"CASE WHEN {pred} IS NULL OR {exp} IS NULL THEN 999 ELSE CAST({d} AS BIGINT) END AS char_distance"
    )


def _round_metrics(src: str, keys: str) -> str:
    return (
        f"SELECT {keys}, exact_match, round(char_accuracy, 6) AS char_accuracy, round(word_accuracy, 6) AS word_accuracy, "
        f"round(cer, 6) AS cer, char_distance FROM (SELECT {keys}, {metrics_sql('typos', 'correct')} FROM {src})"
    )


def _means_sql(src: str, by: str) -> str:
    return (
        f"SELECT {by}, round(avg(exact_match), 6) AS exact_match_rate, round(avg(char_accuracy), 6) AS avg_char_accuracy, "
        f"round(avg(word_accuracy), 6) AS avg_word_accuracy, round(avg(cer), 6) AS avg_cer, count(*) AS n_rows "
        f"FROM (SELECT {by}, {metrics_sql('typos', 'correct')} FROM {src}) GROUP BY {by}"
    )


def _sampled_pairs_sql() -> str:
    crop = (
        "substr(text, CAST(" + u_sql("crop", "doc_id", "0") + " % (length(text) - least(1000, length(text)) + 1) AS BIGINT) + 1, "
        "least(1000, length(text)))"
    )
    sampled = (
        "(SELECT doc_id, source, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "
        f"{u_sql('sample', "'0'", 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= {K_PER_SOURCE})"
    )
    passages = (
        "(SELECT pair_id, doc_id, lang, array_to_string(list_slice(string_split(p0, ' '), 2, len(string_split(p0, ' ')) - 1), ' ') AS passage "
        f"FROM (SELECT {id_sql('pair', 'doc_id', '0')} AS pair_id, doc_id, lang, {crop} AS p0 FROM {sampled}))"
    )
    noisy = noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR)", prob=PROB, seed=NOISE_SEED)
    return (
        "(SELECT pair_id, doc_id, lang, replace(passage, chr(10), chr(32)) AS correct, "
        f"replace({noisy}, chr(10), chr(32)) AS typos FROM {passages})"
    )


def _baseline_sql() -> str:
    from .common import passages_sql
    parts = []
    for i, prob in enumerate(NOISE_LEVELS):
        noisy = noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR)", prob=prob, seed=NOISE_SEED)
        parts.append(
            f"SELECT lang AS run_id, {i} AS eval_idx, replace(passage, chr(10), chr(32)) AS correct, "
            f"replace({noisy}, chr(10), chr(32)) AS typos FROM {passages_sql(trim=True)}"
        )
    src = "(" + " UNION ALL ".join(parts) + ")"
    means = (
        "(SELECT run_id, eval_idx, avg(exact_match) AS exact_match_rate, avg(char_accuracy) AS avg_char_accuracy, "
        "avg(word_accuracy) AS avg_word_accuracy, avg(cer) AS avg_cer "
        f"FROM (SELECT run_id, eval_idx, {metrics_sql('typos', 'correct')} FROM {src}) GROUP BY run_id, eval_idx)"
    )
    cols = []
    for src_col, name, lower in [("exact_match_rate", "exact_match", False), ("avg_char_accuracy", "char_accuracy", False),
                                 ("avg_word_accuracy", "word_accuracy", False), ("avg_cer", "cer", True)]:
        base = f"first_value({src_col}) OVER (PARTITION BY run_id ORDER BY eval_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        imp = f"({base} - {src_col})" if lower else f"({src_col} - {base})"
        cols += [f"round({base}, 6) AS baseline_{name}", f"round({src_col}, 6) AS current_{name}",
                 f"round({imp}, 6) AS improvement_{name}",
                 f"round({imp} / greatest({base}, 0.001) * 100, 6) AS pct_change_{name}"]
    return f"SELECT run_id, CAST(eval_idx AS INTEGER) AS eval_idx, {', '.join(cols)} FROM {means}"


def _display_sql() -> str:
    rows = [f"SELECT run_id, eval_idx, '{label}' AS metric, printf('%.2f%%', baseline_{k} * 100) AS baseline, printf('%.2f%%', current_{k} * 100) AS current, "
            f"printf('%+.2fpp', improvement_{k} * 100) AS improvement, printf('%+.1f%%', pct_change_{k}) AS pct_change FROM cmp" for k, label in report.COMPARISON_LABELS]
    return f"WITH cmp AS ({_baseline_sql()}) {' UNION ALL '.join(rows)}"


def oracles() -> dict[str, str]:
    return {
        "comparison_display": _display_sql(),
        "typo_metrics": _round_metrics(pairs_sql(), "pair_id"),
        "metrics_by_lang": _means_sql(pairs_sql(), "lang"),
        "noise_report": _means_sql(_sampled_pairs_sql(), "lang"),
        "baseline_comparison": _baseline_sql(),
        "evaluation_records": (
            "SELECT pair_id, substr(typos, 1, 200) AS typo_text, substr(correct, 1, 200) AS correct_text, "
            "substr(typos, 1, 200) AS prediction, exact_match, round(char_accuracy, 6) AS char_accuracy, "
            "round(word_accuracy, 6) AS word_accuracy, round(cer, 6) AS cer "
            f"FROM (SELECT pair_id, typos, correct, {metrics_sql('typos', 'correct')} FROM {pairs_sql()})"
        ),
    }


def queries() -> dict:
    return {
        "typo_metrics": q_typo_metrics,
        "metrics_by_lang": q_metrics_by_lang,
        "noise_report": q_noise_report,
        "baseline_comparison": q_baseline_comparison,
        "comparison_display": q_comparison_display,
        "evaluation_records": q_evaluation_records,
    }
