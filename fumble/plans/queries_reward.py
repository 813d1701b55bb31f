"""Registered queries of the ``reward`` and ``mine`` jobs (D*, F11–F20, G*, H3–H8, H10).

Completions are derived from every document's pair: perfect / uncorrected /
first half for the positional reward, and tag layouts for the reasoning
reward (rows per pair generated with ``explode`` over an array — no join).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as TG
from ..functions.noise import noise_sql_duckdb
from ..operators import align, corrupt, render, report, reward
from ..session import checkpoint_path, cut_lineage
from ..sources import files
from ..sources.tables import load
from ..streaming import call_stats
from .common import (DIST_IMPL, EXTERNAL_PROB, EXTERNAL_SEED, NOISE_IMPL, NOISE_SEED, PROB, SEED, all_pairs, all_passages, distance_sql,
                     external_typos, pairs_sql, passages_sql, r6, u_sql)
from .queries_score import _strip_sql, _words_sql

# Completion layouts of the reference's reward self-tests.
LAYOUT_THINK_TEXT = "Widzę kilka błędów w tekście"
LAYOUT_BAD_THINK, LAYOUT_BAD_ANSWER = "błąd", "zły tekst"


def positional_completions(pairs: DataFrame) -> DataFrame:
    """gen 0 = correct text, 1 = typo text, 2 = first half of the correct text."""
    half = F.substring("correct", 1, (F.length("correct") / 2).cast("int"))
    gens = F.array(
        F.struct(F.lit(0).alias("gen_idx"), F.col("correct").alias("completion")),
        F.struct(F.lit(1).alias("gen_idx"), F.col("typos").alias("completion")),
        F.struct(F.lit(2).alias("gen_idx"), half.alias("completion")),
    )
    return pairs.select("pair_id", "source", "correct", "typos", F.explode(gens).alias("g")).select(
        "pair_id", "source", "correct", "typos", "g.gen_idx", "g.completion")


# Further layouts of the tag reward, one of them per pair: what the layouts
# above leave out. A layout is a list of parts, from which both engines build
# the completion: text; a column; (character, n times, per n characters of the
# correct text) - n alone if the last is 0; "fixes" lists the first corrections.
THINK = f"<think>{LAYOUT_THINK_TEXT}</think>"
TAGGED = [THINK + "<answer>", "$correct", "</answer>"]
STEM = "zamiast"
EXTRA_LAYOUTS = [
    [THINK + "<answer>", "$typos", "</answer>"],                       # 5: the uncorrected text as answer
    [THINK + "<answer>", "$correct", " ", "$correct", "</answer>"],    # 6: an answer over 1.2 times as long
    [*TAGGED, ("x", 1, 19)],                                           # 7: little text outside the tags
    [*TAGGED, ("x", 3, 7)],                                            # 8: a third outside
    [*TAGGED, ("x", 4, 1)],                                            # 9: most of it outside
    ["<answer>", "$correct", "</answer>" + THINK],                     # 10: the answer first
    ["<think>", "fixes", "</think><answer>", "$correct", "</answer>"],  # 11: the first corrections as reasoning
    *[[f"<think>{STEM}", ("b", n - len(STEM), 0), "</think><answer>", "$correct", "</answer>"]
      for n in (9, 49, 50, 300, 301, 500, 501)],                       # 12-18: the bounds of the length bands
]
FIXES = 3


def _extra_layout(parts: list) -> Column:
    def one(part) -> Column:
        if part == "fixes":
            first = F.slice("positional", 1, FIXES)
            return F.array_join(F.transform(first, lambda p: F.concat(p["typo"], F.lit(" -> "), p["correct"])), " ")
        if isinstance(part, tuple):
            char, n, per = part
            return F.repeat(F.lit(char), F.lit(n) if not per else F.floor(F.length("correct") * n / per).cast("int"))
        return F.col(part[1:]) if part.startswith("$") else F.lit(part)

    return F.concat(*[one(x) for x in parts])


def _extra_layout_sql(parts: list) -> str:
    def one(part) -> str:
        if part == "fixes":
            return f"array_to_string(list_transform(pos_words[1:{FIXES}], lambda p: coalesce(p[1], '') || ' -> ' || coalesce(p[2], '')), ' ')"
        if isinstance(part, tuple):
            char, n, per = part
            return f"repeat('{char}', {n})" if not per else f"repeat('{char}', CAST(floor(length(correct) * {n} / {per}) AS BIGINT))"
        return part[1:] if part.startswith("$") else f"'{part}'"

    return " || ".join(one(x) for x in parts)


def layout_completions(pairs: DataFrame) -> DataFrame:
    """Layouts 1..4 of the reasoning self-test over each pair's correct text, and
    one of the further layouts 5..18, in turn over the pairs."""
    c = F.col("correct")
    extra = F.coalesce(*[F.when(F.col("pair_id") % len(EXTRA_LAYOUTS) == i, _extra_layout(x)) for i, x in enumerate(EXTRA_LAYOUTS)])
    gens = F.array(
        F.struct(F.lit(1).alias("layout"), F.concat(F.lit(f"<think>{LAYOUT_THINK_TEXT}</think><answer>"), c, F.lit("</answer>")).alias("completion")),
        F.struct(F.lit(2).alias("layout"), F.concat(F.lit("<answer>"), c, F.lit("</answer>")).alias("completion")),
        F.struct(F.lit(3).alias("layout"), c.alias("completion")),
        F.struct(F.lit(4).alias("layout"), F.lit(f"<think>{LAYOUT_BAD_THINK}</think><answer>{LAYOUT_BAD_ANSWER}</answer>").alias("completion")),
        F.struct((F.col("pair_id") % len(EXTRA_LAYOUTS) + 5).cast("int").alias("layout"), extra.alias("completion")),
    )
    cols = [x for x in pairs.columns]
    lists = [i for i, x in enumerate(EXTRA_LAYOUTS) if "fixes" in x]  # only these layouts list corrections
    pairs = pairs.withColumn("positional", F.when((F.col("pair_id") % len(EXTRA_LAYOUTS)).isin(lists), align.corrections("correct", "typos", mode="positional")))
    return pairs.select(*cols, F.explode(gens).alias("g")).select(*cols, "g.layout", "g.completion")


def _layout_sql(src: str) -> str:
    """``src`` has pair_id, correct and typos."""
    n = len(EXTRA_LAYOUTS)
    extra = " ".join(f"WHEN {i + 5} THEN {_extra_layout_sql(x)}" for i, x in enumerate(EXTRA_LAYOUTS))
    return (
        f"(SELECT p.*, l.layout, CASE l.layout "
        f"WHEN 1 THEN '<think>{LAYOUT_THINK_TEXT}</think><answer>' || correct || '</answer>' "
        f"WHEN 2 THEN '<answer>' || correct || '</answer>' WHEN 3 THEN correct "
        f"WHEN 4 THEN '<think>{LAYOUT_BAD_THINK}</think><answer>{LAYOUT_BAD_ANSWER}</answer>' {extra} END AS completion "
        f"FROM (SELECT *, {_positional_list_sql()} AS pos_words FROM {src}) p, range(1, {n + 5}) l(layout) "
        f"WHERE l.layout < 5 OR l.layout = p.pair_id % {n} + 5)"
    )


def _positional_sql(src: str) -> str:
    return (
        f"(SELECT p.pair_id, p.source, p.correct, p.typos, g.gen_idx, CASE g.gen_idx WHEN 0 THEN correct WHEN 1 THEN typos "
        f"ELSE substr(correct, 1, CAST(floor(length(correct) / 2) AS BIGINT)) END AS completion "
        f"FROM {src} p, (SELECT range AS gen_idx FROM range(3)) g)"
    )


# ------------------------------------------------------------------ Spark

def q_positional_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = all_pairs(spark, sf_dir)
    r = reward.positional_reward(positional_completions(pairs))
    return r.select("pair_id", F.col("gen_idx").cast("int").alias("gen_idx"), "matches",
                    r6(F.col("char_accuracy")).alias("char_accuracy"), "perfect_match", r6(F.col("reward")).alias("reward"))


def q_positional_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 per source (a batch of completions per corpus)."""
    pairs = all_pairs(spark, sf_dir)
    r = reward.positional_reward(positional_completions(pairs)).withColumnRenamed("source", "batch")
    s = report.reward_batch_stats(r)
    return s.select("batch", *[r6(F.col(c)).alias(c) for c in s.columns if c not in ("batch", "n_rows")], "n_rows")


def q_format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = all_pairs(spark, sf_dir).select("pair_id", "correct", "typos")
    lc = layout_completions(pairs)
    return lc.select("pair_id", F.col("layout").cast("int").alias("layout"),
                     TG.has_think("completion").alias("has_think"), TG.has_answer("completion").alias("has_answer"),
                     TG.proper_format("completion").alias("proper_format"),
                     r6(TG.outside_ratio("completion")).alias("outside_ratio"))


def q_format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = all_pairs(spark, sf_dir).select("pair_id", "correct", "typos")
    lc = layout_completions(pairs)
    cols = reward.format_reward_cols(F.col("completion"))
    return lc.select("pair_id", F.col("layout").cast("int").alias("layout"),
                     r6(cols["format_score"]).alias("format_score"), r6(cols["outside_penalty"]).alias("outside_penalty"))


def q_answer_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = all_pairs(spark, sf_dir).select("pair_id", "correct", "typos")
    lc = layout_completions(pairs)
    r = reward.with_answer_reward(lc, impl=DIST_IMPL)
    return r.select("pair_id", F.col("layout").cast("int").alias("layout"),
                    r6(F.col("answer_score")).alias("answer_score"), r6(F.col("cer")).alias("cer"),
                    r6(F.col("word_acc")).alias("word_acc"),
                    F.coalesce(F.col("exact"), F.lit(False)).alias("exact"),
                    F.coalesce(F.col("length_penalty"), F.lit(False)).alias("length_penalty"))


def q_legacy_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 over the layouts."""
    pairs = all_pairs(spark, sf_dir).select("pair_id", "correct", "typos")
    lc = layout_completions(pairs)
    r = reward.legacy_reward(lc, impl=DIST_IMPL)
    return r.select("pair_id", F.col("layout").cast("int").alias("layout"),
                    *[r6(F.col(c)).alias(c) for c in ("format_score", "answer_score", "think_score", "reward")])


def q_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 exploded: one row per phrase correction of every document's pair."""
    return align.corrections_long(all_pairs(spark, sf_dir), keep=["pair_id"], mode="phrase")


def q_correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 as a mining job: how often each phrase correction occurs per language,
    over every document's pair; the alignment is one step of it."""
    pairs = all_pairs(spark, sf_dir)
    long = align.corrections_long(pairs, keep=["lang"], mode="phrase")
    return long.groupBy("lang", "typo", "correct").agg(F.count(F.lit(1)).alias("n"))


def q_corrections_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native positional word pairs (a separate operator with a SQL oracle)."""
    pairs = all_pairs(spark, sf_dir)
    c = pairs.select("pair_id", align.corrections("correct", "typos", mode="positional").alias("corrections"))
    return align.explode_corrections(c, keep=["pair_id"])


def q_thinking_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(typos, target) for every document's untrimmed passage."""
    pairs = all_pairs(spark, sf_dir, trim=False)
    return align.thinking_pairs(pairs.select("pair_id", "correct", "typos"))


def q_thinking_target_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 with positional corrections, which SQL can express."""
    pairs = all_pairs(spark, sf_dir, trim=False).select("pair_id", "correct", "typos")
    corrs = align.corrections("correct", "typos", mode="positional")
    return pairs.select("pair_id", "typos", align.thinking_target("correct", corrs).alias("target"))


def q_thinking_pairs_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 with C5: untrimmed passages are routed to one of the two arms, and the
    target lists the corrections of what that arm returned (positional ones,
    which SQL can express)."""
    pairs, _ = align.routed_pairs(all_passages(spark, sf_dir, trim=False), external_typos, seed=SEED, noise_seed=NOISE_SEED, prob=PROB)
    return align.thinking_pairs(pairs.select("pair_id", "arm", "correct", "typos"), mode="positional")


def _pairs_with(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    pairs = all_pairs(spark, sf_dir).select("pair_id", "source", "correct", "typos")
    return pairs.withColumn("word_corrections", align.corrections("correct", "typos", mode=mode))


def _reasoning(spark: SparkSession, sf_dir: str, mode: str = "word") -> DataFrame:
    return reward.reasoning_reward(layout_completions(_pairs_with(spark, sf_dir, mode)), impl=DIST_IMPL)


# Pairs whose correct or typo text is taken away to make failed rows.
LOST_CORRECT, LOST_TYPOS = 97, 89


def _with_failures(df: DataFrame) -> DataFrame:
    lost = F.col("pair_id") % LOST_TYPOS == 0
    df = df.withColumn("correct", F.when(F.col("pair_id") % LOST_CORRECT != 0, F.col("correct")))
    return df.withColumn("word_corrections", F.when(~lost, F.col("word_corrections"))) if "word_corrections" in df.columns else df


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = layout_completions(_pairs_with(spark, sf_dir, "positional"))
    return reward.reasoning_reward(_with_failures(lc), impl=DIST_IMPL)


THINKING_COLUMNS = ("think_score", "think_len", "think_mentions", "typos_mentioned", "typos_total", "corrections_mentioned", "corrections_total")
TOTAL_COLUMNS = ("format_score", "answer_score", "think_score", "reward", "think_penalty", "format_penalty")


def _chosen(r: DataFrame, columns: tuple[str, ...], *more: str) -> DataFrame:
    kinds = dict(r.dtypes)
    return r.select("pair_id", F.col("layout").cast("int").alias("layout"), *[r6(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns], *more)


def _component_stats(r: DataFrame) -> DataFrame:
    """H4–H6, H10 per source."""
    s = report.component_batch_stats(r.withColumnRenamed("source", "batch"))
    return s.select("batch", *[r6(F.col(c)).alias(c) if dict(s.dtypes)[c] == "double" else F.col(c) for c in s.columns if c != "batch"])


def q_thinking_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(_reasoning(spark, sf_dir), THINKING_COLUMNS)


def q_total_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(_reasoning(spark, sf_dir), TOTAL_COLUMNS, "error")


def q_reward_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component_stats(_reasoning(spark, sf_dir))


def q_thinking_reward_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(_reasoning(spark, sf_dir, "positional"), THINKING_COLUMNS)


def q_total_reward_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(_reasoning(spark, sf_dir, "positional"), TOTAL_COLUMNS, "error")


def q_failed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a lost text; only the error and a reward of 0 are recorded."""
    r = _failing(spark, sf_dir)
    return _chosen(r, (*TOTAL_COLUMNS, *THINKING_COLUMNS[1:]), "error")


def q_failed_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component_stats(_failing(spark, sf_dir))


def q_failed_positional_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 with failed rows: they count as not perfect."""
    r = reward.positional_reward(_with_failures(positional_completions(all_pairs(spark, sf_dir))))
    s = report.reward_batch_stats(r.withColumnRenamed("source", "batch"))
    return s.select("batch", "n_rows", *[r6(F.col(c)).alias(c) for c in ("perfect_match_ratio", "reward_mean", "reward_max", "reward_std")])


def _completions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, gen_idx, completion, messages): what a generator hands over - text
    for even documents, a message list for odd ones - with some of unknown documents."""
    gens = positional_completions(all_pairs(spark, sf_dir).withColumn("source", F.col("doc_id")))
    gens = gens.withColumn("doc_id", F.when(F.col("source") % 7 == 0, F.col("source") + 10**9).otherwise(F.col("source")))
    odd = F.col("source") % 2 == 1
    message = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(" "), "completion").alias("content")))
    return gens.select("doc_id", "gen_idx", F.when(~odd, F.col("completion")).alias("completion"), F.when(odd, message).alias("messages"))


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = all_pairs(spark, sf_dir).select("doc_id", "correct")
    return reward.join_completions(reward.completion_text(_completions_table(spark, sf_dir), strip=True), pairs, ["doc_id"])


def q_score_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions joined with their pairs by key, then G1."""
    r = reward.positional_reward(_joined(spark, sf_dir)[0])
    return r.select("doc_id", F.col("gen_idx").cast("int").alias("gen_idx"), "matches", "perfect_match", r6(F.col("reward")).alias("reward"))


def q_unmatched_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: completions without a pair are reported."""
    return _joined(spark, sf_dir)[1].select("doc_id", F.col("gen_idx").cast("int").alias("gen_idx"), F.length("completion").cast("long").alias("n_chars"))


def q_user_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own reward over the scored rows."""
    r = reward.positional_reward(positional_completions(all_pairs(spark, sf_dir)))
    own = reward.user_reward(r, lambda df: F.col("char_accuracy") * 2 - F.when(F.col("perfect_match"), 0.0).otherwise(0.5))
    return own.select("pair_id", F.col("gen_idx").cast("int").alias("gen_idx"), r6(F.col("user_reward")).alias("user_reward"))


# Pairs for which the caller's reward raises, and for which it returns no number.
RAISING, NOTHING = 97, 89


def length_reward(prompts, completions, correct_text, typo_text, pair_id):
    """A caller's reward: how near a completion's length is to the correct text's.
    Completions are texts or lists of messages."""
    texts = [c if isinstance(c, str) else c[0]["content"] for c in completions]
    if any(i % RAISING == 0 for i in pair_id):
        raise ValueError(f"no reward for pair {next(i for i in pair_id if i % RAISING == 0)}")
    assert all(t in p for p, t in zip(prompts, typo_text, strict=True))
    return ["none" if i % NOTHING == 0 else min(len(t), len(c)) / max(len(t), len(c), 1) for t, c, i in zip(texts, correct_text, pair_id, strict=True)]


def q_batch_user_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function over batches of rows; it raises on some rows."""
    rows = positional_completions(all_pairs(spark, sf_dir))
    rows = rows.select("pair_id", "gen_idx", "completion", render.short_prompt("typos").alias("prompt"), F.col("correct").alias("correct_text"), F.col("typos").alias("typo_text"))
    r = reward.batch_reward(rows, length_reward, columns=("pair_id",))
    return r.select("pair_id", F.col("gen_idx").cast("int").alias("gen_idx"), r6(F.col("reward")).alias("reward"), "error")


CALL_ARRIVALS = 3


def q_streamed_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, H4 as calls arrive, a call's rows in two of the arrivals."""
    scored = _numbered(reward.positional_reward(positional_completions(all_pairs(spark, sf_dir))))
    part = F.least(F.floor((F.col("batch") - 1) * CALL_ARRIVALS / 20), F.lit(CALL_ARRIVALS - 1)) + (F.col("gen_idx") == 2).cast("int")
    rows = scored.select(F.col("run_id").cast("string").alias("run_id"), F.col("batch").cast("string").alias("call"), F.col("batch").alias("seq"),
                         "reward", "char_accuracy", "perfect_match", part.cast("int").alias("part"))
    path = checkpoint_path(spark, f"calls-{uuid.uuid4().hex}")
    files.write_records(rows, f"{path}/scored", partition_by=["part"])
    for i in range(CALL_ARRIVALS + 1):  # one write after the other, so that the files' times keep the order
        some = spark.read.schema(rows.schema).parquet(f"{path}/scored").filter(F.col("part") == i).drop("part")
        files.write_records(some, f"{path}/in")
    log = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    call_stats.start(log, f"{path}/stats").awaitTermination()
    s = call_stats.call_stats(spark, f"{path}/stats")
    return s.select("run_id", "call", "call_count", "n_rows", *[r6(F.col(c)).alias(c) for c in ("mean_char_accuracy", "perfect_match_ratio", "reward_mean", "reward_min", "reward_max", "reward_std")])


def q_evaluation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluations, each written twice, to a metric table with the key
    (run_id, eval_idx), read back in long form."""
    path = checkpoint_path(spark, f"metrics-{uuid.uuid4().hex}")
    scored = reward.positional_reward(positional_completions(all_pairs(spark, sf_dir)))
    # both evaluations from one pass over the documents, as a few rows a source that are written once
    means = cut_lineage(scored.filter(F.col("gen_idx").isin(1, 2)).groupBy(F.col("source").alias("run_id"), (F.col("gen_idx") - 1).alias("eval_idx")).agg(
        F.avg("char_accuracy").alias("char_accuracy"), F.avg("reward").alias("reward")))
    for eval_idx in (0, 1):
        for _ in range(2):  # a repeated evaluation replaces itself
            files.write_scalars(means.filter(F.col("eval_idx") == eval_idx), path)
    back = files.read_scalars(spark, path, "run_id string, eval_idx int")
    return back.select("run_id", "eval_idx", "metric", r6(F.col("value")).alias("value"))


def q_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: conversations written as JSON lines and scanned with a declared schema."""
    path = checkpoint_path(spark, f"jsonl-{uuid.uuid4().hex}")
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    files.write_jsonl(conv, path)
    return files.read_jsonl(spark, path, conv.schema)


def _numbered(df: DataFrame) -> DataFrame:
    """Reward calls: a run per last digit of the pair, a batch per source, counted from 1."""
    return df.withColumn("run_id", F.col("pair_id") % 10).withColumn("batch", F.regexp_extract("source", r"(\d+)$", 1).cast("int") + 1)


def q_first_batch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: the first batch of each run, over the positional-reward completions."""
    r = reward.positional_reward(positional_completions(all_pairs(spark, sf_dir)))
    s = report.first_batch_profile(_numbered(r))
    return s.select("run_id", "batch", *[r6(F.col(c)).alias(c) if dict(s.dtypes)[c] == "double" else F.col(c)
                                         for c in s.columns if c not in ("run_id", "batch")])


def _picked(spark: SparkSession, sf_dir: str, generations: int) -> tuple[DataFrame, DataFrame]:
    """H8 on keys: (first rows of every 10th batch, the pairs of their documents).

    A pair's id needs no text, so texts are read for the picked documents only."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ids = docs.select("doc_id", "source", corrupt.passage_id(F.col("doc_id"), F.lit(0), SEED).alias("pair_id"))
    keys = _numbered(ids).withColumn("gen_idx", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))))
    keys = keys.withColumn("pos", F.col("pair_id") * generations + F.col("gen_idx"))
    picked = report.example_rows(keys, batch_col="batch", order_col="pos", per_batch=3, every=10).select("batch", "pair_id", "doc_id", "gen_idx")
    few = docs.join(picked.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs, _ = corrupt.build_pairs(few, seed=SEED, noise_seed=NOISE_SEED, prob=PROB, keep=("lang",), impl=NOISE_IMPL)
    return picked.drop("doc_id"), pairs


def q_example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8 + F21: first 3 rows (by pair id) of every 10th batch, texts truncated."""
    picked, pairs = _picked(spark, sf_dir, 3)
    ex = reward.positional_reward(positional_completions(pairs)).join(picked, ["pair_id", "gen_idx"])
    return ex.select("batch", "pair_id", F.col("gen_idx").cast("int").alias("gen_idx"),
                     F.substring("typos", 1, 200).alias("typo_text"), F.substring("completion", 1, 300).alias("generated"),
                     F.substring("correct", 1, 200).alias("correct_text"), r6(F.col("reward")).alias("reward"))


def q_reasoning_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8 of the reasoning reward, over the layouts of the picked pairs."""
    picked, pairs = _picked(spark, sf_dir, 1)
    pairs = pairs.select("pair_id", "source", "correct", "typos").withColumn("word_corrections", align.corrections("correct", "typos", mode="positional"))
    r = reward.reasoning_reward(layout_completions(pairs), impl=DIST_IMPL).join(picked, "pair_id")
    ex = report.reasoning_examples(r)
    return ex.select("batch", "pair_id", F.col("layout").cast("int").alias("layout"), "shown", r6(F.col("cer")).alias("cer"), "has_think", "has_answer", "proper_format",
                     "outside", "typos", "corrections", r6(F.col("reward")).alias("reward"))


# ------------------------------------------------------------------ oracles

def _pos_matches_sql(a: str, b: str) -> str:
    return (
        f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE "
        f"len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda x: x[1] = x[2])) END)"
    )


def _positional_reward_sql() -> str:
    src = _positional_sql(pairs_sql())
    comp = _strip_sql("completion")
    m = _pos_matches_sql("c", "correct")
    acc = f"(CASE WHEN length(correct) > 0 THEN {m} / CAST(length(correct) AS DOUBLE) ELSE 0.0 END)"
    ratio = "(length(c) / CAST(greatest(length(correct), 1) AS DOUBLE))"
    base = f"({acc} + CASE WHEN c = correct THEN 2.0 ELSE 0.0 END)"
    rew = f"(CASE WHEN {ratio} < 0.5 OR {ratio} > 2.0 THEN {base} * 0.5 ELSE {base} END)"
    return (
        f"(SELECT pair_id, source, CAST(gen_idx AS INTEGER) AS gen_idx, c AS completion, CAST({m} AS BIGINT) AS matches, {acc} AS char_accuracy, "
        f"c = correct AS perfect_match, {rew} AS reward FROM (SELECT *, {comp} AS c FROM {src}))"
    )


def _has_block_sql(c: str, o: str, cl: str) -> str:
    return f"(coalesce(instr({c}, '{o}') > 0 AND strpos(substr({c}, instr({c}, '{o}') + {len(o)}), '{cl}') > 0, false))"


def _format_sql_cols(c: str = "completion") -> dict[str, str]:
    ht = _has_block_sql(c, "<think>", "</think>")
    ha = _has_block_sql(c, "<answer>", "</answer>")
    proper = f"({ht} AND {ha} AND instr({c}, '<think>') < instr({c}, '<answer>'))"
    rest = f"regexp_replace(regexp_replace({c}, '(?s)<think>(.*?)</think>', '', 'g'), '(?s)<answer>(.*?)</answer>', '', 'g')"
    for mk in ("<think>", "</think>", "<answer>", "</answer>"):
        rest = f"replace({rest}, '{mk}', '')"
    total = f"length({_strip_sql(c)})"
    ratio = f"(CASE WHEN {total} > 0 THEN length({_strip_sql(rest)}) / CAST({total} AS DOUBLE) ELSE 0.0 END)"
    raw = f"(CASE WHEN {proper} THEN 1.0 WHEN {ht} AND {ha} THEN 0.5 WHEN {ha} THEN 0.3 ELSE 0.0 END)"
    score = f"(CASE WHEN {ratio} > 0.1 THEN greatest(0.0, {raw} - least(0.5, {ratio})) ELSE {raw} END)"
    return {"has_think": ht, "has_answer": ha, "proper_format": proper, "outside_ratio": ratio,
            "format_score": score, "outside_penalty": f"(CASE WHEN {ratio} > 0.1 THEN least(0.5, {ratio}) END)"}


def _answer_sql() -> str:
    src = _layout_sql(pairs_sql())
    ha = _has_block_sql("completion", "<answer>", "</answer>")
    block = _strip_sql("regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1)")
    pred = f"(CASE WHEN {ha} THEN {block} ELSE {_strip_sql('completion')} END)"
    inner = f"SELECT pair_id, layout, correct, {pred} AS pred FROM {src}"
    d = distance_sql("pred", "correct")
    cer = f"({d} / CAST(greatest(length(correct), 1) AS DOUBLE))"
    pw, ew = _words_sql("pred"), _words_sql("correct")
    longest = f"greatest(length({pw}), length({ew}))"
    wacc = f"(CASE WHEN {longest} > 0 THEN 1 - {distance_sql(pw, ew)} / CAST({longest} AS DOUBLE) ELSE 0.0 END)"
    base = f"(greatest(0.0, 2.5 * (1 - {cer})) + greatest(0.0, 1.5 * {wacc}) + CASE WHEN pred = correct THEN 0.5 ELSE 0.0 END)"
    longp = "(length(pred) / CAST(greatest(length(correct), 1) AS DOUBLE) > 1.2)"
    score = f"(CASE WHEN {longp} THEN {base} * 0.8 ELSE {base} END)"
    return (
        f"SELECT pair_id, CAST(layout AS INTEGER) AS layout, round({score}, 6) AS answer_score, round({cer}, 6) AS cer, "
        f"round({wacc}, 6) AS word_acc, pred = correct AS exact, {longp} AS length_penalty FROM ({inner})"
    )


def _legacy_sql() -> str:
    src = _layout_sql(pairs_sql())
    f = _format_sql_cols()
    ha, ht, proper = f["has_answer"], f["has_think"], f["proper_format"]
    fmt = f"(CASE WHEN {proper} THEN 1.0 WHEN {ht} AND {ha} THEN 0.5 WHEN {ha} THEN 0.3 ELSE 0.0 END)"
    block = _strip_sql("regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1)")
    cer_t = f"({distance_sql(block, 'correct')} / CAST(greatest(length(correct), 1) AS DOUBLE))"
    cer_w = f"({distance_sql('completion', 'correct')} / CAST(greatest(length(correct), 1) AS DOUBLE))"
    ans = f"(CASE WHEN {ha} THEN greatest(0.0, 3 * (1 - {cer_t})) ELSE greatest(0.0, 2 * (1 - {cer_w})) END)"
    think = _strip_sql("regexp_extract(completion, '(?s)<think>(.*?)</think>', 1)")
    stems = " OR ".join(f"instr(lower({think}), '{s}') > 0" for s in TG.LEGACY_STEMS)
    thk = (f"(CASE WHEN {ht} AND length({think}) > 20 AND length({think}) < 500 THEN 0.5 + "
           f"CASE WHEN {stems} THEN 0.5 ELSE 0.0 END ELSE 0.0 END)")
    return (
        f"SELECT pair_id, CAST(layout AS INTEGER) AS layout, round(CAST({fmt} AS DOUBLE), 6) AS format_score, "
        f"round(CAST({ans} AS DOUBLE), 6) AS answer_score, round(CAST({thk} AS DOUBLE), 6) AS think_score, "
        f"round(CAST({fmt} AS DOUBLE) + {ans} + CAST({thk} AS DOUBLE), 6) AS reward FROM {src}"
    )


def _positional_list_sql() -> str:
    """DuckDB: [(typo word, correct word)] where the i-th words differ."""
    def words(x):
        return f"list_filter(regexp_split_to_array(lower({_strip_sql(x)}), '{_ws()}+'), lambda w: w <> '')"
    return f"list_filter(list_zip({words('typos')}, {words('correct')}), lambda p: NOT coalesce(p[1] = p[2], false))"


def _positional_corrections_sql() -> str:
    diffs = f"SELECT pair_id, {_positional_list_sql()} AS d FROM {pairs_sql()}"
    return (
        "SELECT pair_id, CAST(pos AS INTEGER) AS pos, coalesce(d[pos + 1][1], '') AS typo, "
        f"coalesce(d[pos + 1][2], '') AS correct FROM (SELECT pair_id, d, unnest(range(len(d))) AS pos FROM ({diffs}))"
    )


def _routed_sql() -> str:
    """(pair_id, arm, correct, typos) of untrimmed passages, each from the arm that it is routed to."""
    arm = lambda prob, seed: noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR)", prob=prob, seed=seed)
    route = f"{u_sql('route', 'doc_id', '0')} <= {int(0.5 * 2**32)}"
    flat = lambda x: f"replace({x}, chr(10), ' ')"
    noisy = f"CASE WHEN {route} THEN {arm(PROB, NOISE_SEED)} ELSE {arm(EXTERNAL_PROB, EXTERNAL_SEED)} END"
    return (f"(SELECT pair_id, CASE WHEN {route} THEN 'keyboard' ELSE 'external' END AS arm, {flat('passage')} AS correct, "
            f"{flat(noisy)} AS typos FROM {passages_sql(trim=False)} WHERE passage IS NOT NULL)")


def _thinking_target_sql(src: str, more: str = "") -> str:
    sep = align.SEP
    line = (f"CASE WHEN coalesce(p[1], '') <> '' AND coalesce(p[2], '') <> '' THEN p[1] || '{align.ARROW}' || p[2] "
            f"WHEN coalesce(p[1], '') <> '' THEN '{align.DELETE_PREFIX}' || p[1] ELSE '{align.INSERT_PREFIX}' || p[2] END")
    body = f"coalesce(array_to_string(list_transform({_positional_list_sql()}, lambda p: {line}), '{sep}'), '')"
    return (f"SELECT pair_id, {more}typos, '<think>{sep}' || {body} || '{sep}</think>{sep}<answer>' || correct || '</answer>' AS target "
            f"FROM {src}")


def _reasoning_sql(failures: bool = False) -> str:
    """All components of the reasoning reward with positional corrections."""
    src = _layout_sql(pairs_sql())
    correct, corrs = "correct", "pos_words"
    if failures:
        correct, corrs = f"CASE WHEN pair_id % {LOST_CORRECT} <> 0 THEN correct END", f"CASE WHEN pair_id % {LOST_TYPOS} <> 0 THEN pos_words END"
    f = _format_sql_cols()
    block = _strip_sql("regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1)")
    think = _strip_sql("regexp_extract(completion, '(?s)<think>(.*?)</think>', 1)")
    pred = f"(CASE WHEN {f['has_answer']} THEN {block} ELSE {_strip_sql('completion')} END)"
    s1 = (f"SELECT pair_id, source, layout, completion, {correct} AS correct, {corrs} AS d, {', '.join(f'{v} AS {k}' for k, v in f.items())}, "
          f"{pred} AS pred, lower({think}) AS low, length({think}) AS tlen FROM {src}")
    pw, ew = _words_sql("pred"), _words_sql("correct")
    longest = f"greatest(length({pw}), length({ew}))"
    mentions = " + ".join(f"CASE WHEN instr(low, '{x}') > 0 THEN 1 ELSE 0 END" for x in TG.ERROR_STEMS)
    total = lambda i: f"len(list_filter(d, lambda p: coalesce(p[{i}], '') <> ''))"
    hit = lambda i: f"len(list_filter(d, lambda p: coalesce(p[{i}], '') <> '' AND instr(low, lower(p[{i}])) > 0))"
    s2 = (f"SELECT *, {distance_sql('pred', 'correct')} / CAST(greatest(length(correct), 1) AS DOUBLE) AS cer, "
          f"CASE WHEN {longest} > 0 THEN 1 - {distance_sql(pw, ew)} / CAST({longest} AS DOUBLE) ELSE 0.0 END AS word_acc, "
          f"length(pred) / CAST(greatest(length(correct), 1) AS DOUBLE) > 1.2 AS too_long, "
          f"{mentions} AS mentions, {hit(1)} AS th, {total(1)} AS tt, {hit(2)} AS ch, {total(2)} AS ct, "
          f"correct IS NULL OR (has_think AND d IS NULL) AS failed FROM ({s1})")
    band = ("CASE WHEN tlen < 10 THEN 0.0 WHEN tlen < 50 THEN 0.25 * (tlen / 50.0::DOUBLE) WHEN tlen <= 300 THEN 0.5 "
            "WHEN tlen <= 500 THEN 0.5 * (1 - (tlen - 300) / 200.0::DOUBLE) ELSE 0.1 END")
    base = "(greatest(0.0, 2.5 * (1 - cer)) + greatest(0.0, 1.5 * word_acc) + CASE WHEN pred = correct THEN 0.5 ELSE 0.0 END)"
    cover = lambda a, b: f"0.75 * CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0.0 END"
    s3 = (f"SELECT *, CASE WHEN too_long THEN {base} * 0.8 ELSE {base} END AS answer_score, "
          f"CASE WHEN has_think THEN {band} + least(0.5, mentions * 0.15) + {cover('th', 'tt')} + {cover('ch', 'ct')} ELSE 0.0 END AS think_score FROM ({s2})")
    s4 = f"SELECT *, CAST(format_score + answer_score + think_score AS DOUBLE) AS total FROM ({s3})"
    ok = lambda x: f"CASE WHEN NOT failed THEN {x} END"
    only = lambda x: ok(f"CASE WHEN has_think THEN CAST({x} AS BIGINT) END")
    return (
        f"(SELECT pair_id, source, CAST(layout AS INTEGER) AS layout, {ok('CAST(format_score AS DOUBLE)')} AS format_score, {ok('CAST(answer_score AS DOUBLE)')} AS answer_score, "
        f"{ok('CAST(think_score AS DOUBLE)')} AS think_score, {only('tlen')} AS think_len, {only('mentions')} AS think_mentions, {only('th')} AS typos_mentioned, "
        f"{only('tt')} AS typos_total, {only('ch')} AS corrections_mentioned, {only('ct')} AS corrections_total, {ok('cer')} AS cer, {ok('word_acc')} AS word_acc, "
        f"{ok('pred = correct')} AS exact, {ok('CASE WHEN NOT has_think AND total > 3.0 THEN total - 3.0 END')} AS think_penalty, "
        f"{ok('CASE WHEN has_think AND NOT proper_format AND total > 4.0 THEN total - 4.0 END')} AS format_penalty, "
        f"{ok('CAST(outside_penalty AS DOUBLE)')} AS outside_penalty, {ok('CASE WHEN outside_ratio > 0.1 THEN outside_ratio END')} AS outside_recorded, "
        "CASE WHEN failed THEN 0.0 WHEN NOT has_think THEN least(total, 3.0) WHEN NOT proper_format THEN least(total, 4.0) ELSE total END AS reward, "
        "CASE WHEN failed THEN 'missing pair text' END AS error, has_think, has_answer, proper_format, outside_ratio, pred, completion "
        f"FROM ({s4}))"
    )


def _component_stats_sql(src: str) -> str:
    z = lambda c: f"round(avg(CAST(coalesce({c}, 0) AS DOUBLE)), 6)"
    return (
        "SELECT source AS batch, round(avg(cer), 6) AS character_error_rate, round(avg(1 - word_acc), 6) AS word_error_rate, round(avg(word_acc), 6) AS word_accuracy, "
        f"{z('format_score')} AS format_score, {z('think_score')} AS thinking_score, {z('answer_score')} AS answer_score, round(avg(reward), 6) AS reward_mean, "
        "round(min(reward), 6) AS reward_min, round(max(reward), 6) AS reward_max, round(stddev_pop(reward), 6) AS reward_std, "
        "round(avg(CAST(coalesce(think_score, 0) > 0 AS DOUBLE)), 6) AS has_think_ratio, round(avg(CAST(coalesce(exact, false) AS DOUBLE)), 6) AS exact_match_ratio, "
        "count(think_penalty) AS think_penalty_count, count(format_penalty) AS format_penalty_count, count(outside_penalty) AS outside_penalty_count, "
        f"{z('outside_recorded')} AS mean_outside_ratio, {z('typos_mentioned')} AS mean_typos_mentioned, {z('typos_total')} AS mean_typos_total, "
        f"{z('corrections_mentioned')} AS mean_corrections_mentioned, {z('corrections_total')} AS mean_corrections_total, count(*) AS n_rows FROM {src} GROUP BY source"
    )


def _columns_sql(columns: tuple[str, ...]) -> str:
    whole = {"think_len", "think_mentions", "typos_mentioned", "typos_total", "corrections_mentioned", "corrections_total"}
    return "pair_id, layout, " + ", ".join(c if c in whole else f"round({c}, 6) AS {c}" for c in columns)


BATCH_SQL = "CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) + 1"


def _reasoning_examples_sql() -> str:
    keys = f"(SELECT pair_id, {BATCH_SQL} AS batch FROM {pairs_sql()})"
    picked = f"(SELECT pair_id, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pair_id) AS rn FROM {keys} WHERE batch % 10 = 0) WHERE rn <= 3)"
    ratio = lambda a, b: f"coalesce({a}, 0) || '/' || coalesce({b}, 0)"
    return (
        "SELECT batch, r.pair_id, layout, CASE WHEN has_answer THEN pred ELSE substr(completion, 1, 100) || '...' END AS shown, round(cer, 6) AS cer, has_think, has_answer, "
        "proper_format, printf('%.0f%%', outside_ratio * 100) AS outside, "
        f"{ratio('typos_mentioned', 'typos_total')} AS typos, {ratio('corrections_mentioned', 'corrections_total')} AS corrections, round(reward, 6) AS reward "
        f"FROM {_reasoning_sql()} r JOIN {picked} p USING (pair_id)"
    )


def _completions_sql() -> str:
    """(doc_id, gen_idx, completion, correct) as handed over: unknown documents have no pair."""
    src = pairs_sql()
    gens = _positional_sql(f"(SELECT pair_id, doc_id AS source, correct, typos FROM {src})")
    return (f"(SELECT CASE WHEN source % 7 = 0 THEN source + 1000000000 ELSE source END AS doc_id, CAST(gen_idx AS INTEGER) AS gen_idx, {_strip_sql('completion')} AS c, correct, "
            f"source % 7 <> 0 AS known FROM {gens})")


def _score_completions_sql() -> str:
    m = _pos_matches_sql("c", "correct")
    acc = f"(CASE WHEN length(correct) > 0 THEN {m} / CAST(length(correct) AS DOUBLE) ELSE 0.0 END)"
    ratio = "(length(c) / CAST(greatest(length(correct), 1) AS DOUBLE))"
    base = f"({acc} + CASE WHEN c = correct THEN 2.0 ELSE 0.0 END)"
    return (f"SELECT doc_id, gen_idx, CAST({m} AS BIGINT) AS matches, c = correct AS perfect_match, "
            f"round(CASE WHEN {ratio} < 0.5 OR {ratio} > 2.0 THEN {base} * 0.5 ELSE {base} END, 6) AS reward FROM {_completions_sql()} WHERE known")


def _ws() -> str:
    from ..functions.text import WS_RE2
    return WS_RE2


def oracles() -> dict[str, str]:
    pr = _positional_reward_sql()
    fmt = _format_sql_cols()
    layouts = _layout_sql(pairs_sql())
    return {
        "positional_reward": (
            f"SELECT pair_id, gen_idx, matches, round(char_accuracy, 6) AS char_accuracy, perfect_match, "
            f"round(reward, 6) AS reward FROM {pr}"
        ),
        "positional_batch_stats": (
            "SELECT source AS batch, round(avg(char_accuracy), 6) AS mean_char_accuracy, "
            "round(avg(CAST(perfect_match AS DOUBLE)), 6) AS perfect_match_ratio, round(avg(reward), 6) AS reward_mean, "
            "round(min(reward), 6) AS reward_min, round(max(reward), 6) AS reward_max, round(stddev_pop(reward), 6) AS reward_std, "
            f"count(*) AS n_rows FROM {pr} GROUP BY source"
        ),
        "first_batch_profile": (
            "SELECT run_id, batch, round(avg(length(completion)), 6) AS mean_len, CAST(min(length(completion)) AS BIGINT) AS min_len, "
            "CAST(max(length(completion)) AS BIGINT) AS max_len, round(avg(reward), 6) AS reward_mean, round(min(reward), 6) AS reward_min, "
            "round(max(reward), 6) AS reward_max, CAST(count(*) FILTER (WHERE reward > 0) AS BIGINT) AS nonzero, count(*) AS n_rows "
            f"FROM (SELECT *, min(batch) OVER (PARTITION BY run_id) AS first FROM (SELECT *, pair_id % 10 AS run_id, {BATCH_SQL} AS batch FROM {pr})) "
            "WHERE batch = first GROUP BY run_id, batch"
        ),
        "example_rows": (
            "SELECT batch, pair_id, gen_idx, substr(typos, 1, 200) AS typo_text, substr(completion, 1, 300) AS generated, "
            "substr(correct, 1, 200) AS correct_text, round(reward, 6) AS reward FROM ("
            "SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pair_id * 3 + gen_idx) AS rn FROM ("
            f"SELECT q.*, p.typos, p.correct, {BATCH_SQL.replace('source', 'q.source')} AS batch "
            f"FROM {pr} q JOIN (SELECT pair_id, typos, correct FROM {pairs_sql()}) p USING (pair_id)) WHERE batch % 10 = 0) "
            "WHERE rn <= 3"
        ),
        "reasoning_examples": _reasoning_examples_sql(),
        "thinking_target_positional": _thinking_target_sql(pairs_sql(trim=False)),
        "thinking_pairs_routed": _thinking_target_sql(_routed_sql(), "arm, "),
        "thinking_reward_positional": f"SELECT {_columns_sql(THINKING_COLUMNS)} FROM {_reasoning_sql()}",
        "total_reward_positional": f"SELECT {_columns_sql(TOTAL_COLUMNS)}, error FROM {_reasoning_sql()}",
        "failed_rewards": f"SELECT {_columns_sql((*TOTAL_COLUMNS, *THINKING_COLUMNS[1:]))}, error FROM {_reasoning_sql(failures=True)}",
        "failed_batch_stats": _component_stats_sql(_reasoning_sql(failures=True)),
        "reward_batch_stats_positional": _component_stats_sql(_reasoning_sql()),
        "failed_positional_stats": (
            "SELECT source AS batch, count(*) AS n_rows, round(avg(CAST(NOT lost AND perfect_match AS DOUBLE)), 6) AS perfect_match_ratio, "
            "round(avg(CASE WHEN lost THEN 0.0 ELSE reward END), 6) AS reward_mean, round(max(CASE WHEN lost THEN 0.0 ELSE reward END), 6) AS reward_max, "
            f"round(stddev_pop(CASE WHEN lost THEN 0.0 ELSE reward END), 6) AS reward_std FROM (SELECT *, pair_id % {LOST_CORRECT} = 0 AS lost FROM {pr}) GROUP BY source"
        ),
        "score_completions": _score_completions_sql(),
        "unmatched_completions": f"SELECT doc_id, gen_idx, CAST(length(c) AS BIGINT) AS n_chars FROM {_completions_sql()} WHERE NOT known",
        "user_reward": f"SELECT pair_id, gen_idx, round(char_accuracy * 2 - CASE WHEN perfect_match THEN 0.0 ELSE 0.5 END, 6) AS user_reward FROM {pr}",
        "batch_user_reward": (
            f"SELECT pair_id, gen_idx, CASE WHEN error IS NULL THEN round(least(c, n) / CAST(greatest(c, n, 1) AS DOUBLE), 6) ELSE 0.0 END AS reward, error FROM ("
            f"SELECT pair_id, CAST(gen_idx AS INTEGER) AS gen_idx, length(completion) AS c, length(correct) AS n, CASE WHEN pair_id % {RAISING} = 0 THEN 'ValueError: no reward for pair ' || pair_id "
            f"WHEN pair_id % {NOTHING} = 0 THEN 'TypeError: a reward is a number, not a text' END AS error FROM {_positional_sql(pairs_sql())})"
        ),
        "streamed_call_stats": (
            "SELECT run_id::VARCHAR AS run_id, batch::VARCHAR AS call, dense_rank() OVER (PARTITION BY run_id ORDER BY batch) AS call_count, count(*) AS n_rows, "
            "round(avg(char_accuracy), 6) AS mean_char_accuracy, round(avg(CAST(perfect_match AS DOUBLE)), 6) AS perfect_match_ratio, round(avg(reward), 6) AS reward_mean, "
            "round(min(reward), 6) AS reward_min, round(max(reward), 6) AS reward_max, round(stddev_pop(reward), 6) AS reward_std "
            f"FROM (SELECT *, pair_id % 10 AS run_id, {BATCH_SQL} AS batch FROM {pr}) GROUP BY run_id, batch"
        ),
        "evaluation_tables": (
            "SELECT run_id, eval_idx, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT source AS run_id, CAST(gen_idx - 1 AS INTEGER) AS eval_idx, "
            f"avg(char_accuracy) AS char_accuracy, avg(reward) AS reward FROM {pr} WHERE gen_idx > 0 GROUP BY ALL) ON char_accuracy, reward INTO NAME metric VALUE value)"
        ),
        "json_lines": "SELECT conv_id, turn, role, text FROM conversations",
        "format_check": (
            f"SELECT pair_id, CAST(layout AS INTEGER) AS layout, {fmt['has_think']} AS has_think, {fmt['has_answer']} AS has_answer, "
            f"{fmt['proper_format']} AS proper_format, round({fmt['outside_ratio']}, 6) AS outside_ratio FROM {layouts}"
        ),
        "format_reward": (
            f"SELECT pair_id, CAST(layout AS INTEGER) AS layout, round({fmt['format_score']}, 6) AS format_score, "
            f"round({fmt['outside_penalty']}, 6) AS outside_penalty FROM {layouts}"
        ),
        "answer_reward": _answer_sql(),
        "legacy_reward": _legacy_sql(),
        "corrections_positional": _positional_corrections_sql(),
    }


def queries() -> dict:
    return {
        "positional_reward": q_positional_reward,
        "positional_batch_stats": q_positional_batch_stats,
        "first_batch_profile": q_first_batch_profile,
        "example_rows": q_example_rows,
        "reasoning_examples": q_reasoning_examples,
        "format_check": q_format_check,
        "format_reward": q_format_reward,
        "answer_reward": q_answer_reward,
        "legacy_reward": q_legacy_reward,
        "corrections": q_corrections,
        "correction_counts": q_correction_counts,
        "corrections_positional": q_corrections_positional,
        "thinking_target": q_thinking_target,
        "thinking_target_positional": q_thinking_target_positional,
        "thinking_pairs_routed": q_thinking_pairs_routed,
        "thinking_reward": q_thinking_reward,
        "thinking_reward_positional": q_thinking_reward_positional,
        "total_reward": q_total_reward,
        "total_reward_positional": q_total_reward_positional,
        "reward_batch_stats": q_reward_batch_stats,
        "reward_batch_stats_positional": lambda spark, sf_dir: _component_stats(_reasoning(spark, sf_dir, "positional")),
        "failed_rewards": q_failed_rewards,
        "failed_batch_stats": q_failed_batch_stats,
        "failed_positional_stats": q_failed_positional_stats,
        "score_completions": q_score_completions,
        "unmatched_completions": q_unmatched_completions,
        "user_reward": q_user_reward,
        "batch_user_reward": q_batch_user_reward,
        "streamed_call_stats": q_streamed_call_stats,
        "evaluation_tables": q_evaluation_tables,
        "json_lines": q_json_lines,
    }
