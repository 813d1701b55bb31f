"""Registered queries of the ``render`` job and evaluation joins."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS, WS_RE2
from ..operators import render, score
from ..session import cut_lineage, ensure_checkpoint_dir, remove_path
from ..sources import files
from ..sources.tables import load
from .common import all_pairs, pairs_sql

CHATML = render.CHATML


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(template: str, text_sql: str) -> str:
    before, after = template.split("{text}")
    return f"({_sql_lit(before)} || {text_sql} || {_sql_lit(after)})"


# ------------------------------------------------------------------ Spark

def q_chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = render.chat_record(all_pairs(spark, sf_dir).select("pair_id", "correct", "typos"))
    return recs.select("pair_id", render.nth_of_role(F.col("messages"), "user", 0).alias("user_content"),
                       render.nth_of_role(F.col("messages"), "assistant", 0).alias("assistant_content"), "task")


def q_short_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = render.prompt_records(all_pairs(spark, sf_dir).select("pair_id", "correct", "typos"), kind="short")
    return p.select("pair_id", "prompt", "correct_text", "typo_text")


def q_reasoning_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = render.prompt_records(all_pairs(spark, sf_dir).select("pair_id", "correct", "typos"), kind="reasoning")
    return p.select("pair_id", "prompt")


def q_template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return render.render_conversations(conv, generation=True, drop_last=True)


def q_nth_role_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = render.nth_of_role_long(conv, "user", 0)
    a = render.nth_of_role_long(conv, "assistant", 0)
    return u.unionByName(a).select("conv_id", "role", "turn", "text")


def q_drop_last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return render.drop_last_long(conv)


def q_backtick_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = render.chat_record(all_pairs(spark, sf_dir).select("pair_id", "correct", "typos"))
    user = render.nth_of_role(F.col("messages"), "user", 0)
    return recs.select("pair_id", render.backtick_payload(user).alias("typo_text"))


def q_prefix_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 on generated = rendered prompt + the correct text (a perfect generation)."""
    p = render.prompt_records(all_pairs(spark, sf_dir).select("pair_id", "correct", "typos"), kind="short")
    gen = F.concat(F.col("prompt"), F.col("correct_text"))
    return p.select("pair_id", render.strip_prefix(gen, F.col("prompt")).alias("completion"))


def q_realign_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 over all documents: prompts are the texts (exact copies share a key);
    results come back with whitespace changed and lower-cased, one per
    document, and must be placed at the right prompt index."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    prompts = docs.select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"))
    results = docs.select(
        F.col("doc_id").alias("ridx"),
        F.lower(F.translate("text", WS_CHARS, " " * len(WS_CHARS))).alias("prompt"),
        F.concat(F.lit("gen-"), F.col("doc_id").cast("string")).alias("completion"),
    )
    return score.realign_completions(prompts, results).select("idx", "completion")


def roundtrip_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def q_pair_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 then A1: write every document's pair as CSV, read it back."""
    path = roundtrip_dir(spark, "pairs-csv")
    files.write_pairs(all_pairs(spark, sf_dir), path, mode="overwrite")
    ok, _bad = files.read_pairs(spark, path)
    back = cut_lineage(ok.select("correct", "typos"))
    remove_path(spark, path)
    return back


# ------------------------------------------------------------------ oracles

def _chatml_sql(role_sql: str, content_sql: str) -> str:
    before, after = CHATML["open"].split("{role}")
    return f"({_sql_lit(before)} || {role_sql} || {_sql_lit(after)} || {content_sql} || {_sql_lit(CHATML['close'])})"


def oracles() -> dict[str, str]:
    pairs = pairs_sql()
    user = f"({_sql_lit(render.SFT_INSTRUCTION + '`')} || typos || '`')"
    short = _sql_text(render.SHORT_PROMPT, "typos")
    reasoning = _sql_text(render.REASONING_PROMPT, "typos")
    gen_marker = _sql_lit(CHATML["generation"])
    short_prompt = f"({_chatml_sql(_sql_lit('user'), short)} || {gen_marker})"
    ticks = f"(length({user}) - length(replace({user}, '`', '')))"
    return {
        "chat_records": f"SELECT pair_id, {user} AS user_content, correct AS assistant_content, 'typo' AS task FROM {pairs}",
        "short_prompt": f"SELECT pair_id, {short_prompt} AS prompt, correct AS correct_text, typos AS typo_text FROM {pairs}",
        "reasoning_prompt": f"SELECT pair_id, ({_chatml_sql(_sql_lit('user'), reasoning)} || {gen_marker}) AS prompt FROM {pairs}",
        "template_render": (
            f"SELECT conv_id, coalesce(string_agg({_chatml_sql('role', 'coalesce(text, ' + chr(39) + chr(39) + ')')}, '' ORDER BY turn) FILTER (turn < last_turn), '') || {gen_marker} AS rendered "
            "FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) GROUP BY conv_id"
        ),
        "nth_role_message": (
            "SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k "
            "FROM conversations WHERE role IN ('user', 'assistant')) WHERE k = 1"
        ),
        "drop_last_message": (
            "SELECT conv_id, turn, role FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) "
            "WHERE turn < last_turn"
        ),
        "backtick_payload": (
            f"SELECT pair_id, CASE WHEN instr({user}, 'Napraw literówki') > 0 AND instr({user}, '`') > 0 THEN "
            f"CASE WHEN {ticks} >= 2 THEN split_part({user}, '`', 2) ELSE '' END ELSE {user} END AS typo_text FROM {pairs}"
        ),
        "prefix_removal": (
            f"SELECT pair_id, regexp_replace(substr(g, length(p) + 1), '^{WS_RE2}+|{WS_RE2}+$', '', 'g') AS completion "
            f"FROM (SELECT pair_id, {short_prompt} AS p, {short_prompt} || correct AS g FROM {pairs})"
        ),
        "realign_completions": (
            f"WITH p AS (SELECT doc_id AS idx, lower(regexp_replace(text, '{WS_RE2}+', '', 'g')) AS k FROM documents), "
            f"r AS (SELECT lower(regexp_replace(lower(regexp_replace(text, '{WS_RE2}+', ' ', 'g')), '{WS_RE2}+', '', 'g')) AS k, "
            "arg_max('gen-' || CAST(doc_id AS VARCHAR), doc_id) AS completion FROM documents GROUP BY 1), "
            "o AS (SELECT k, max(idx) AS idx FROM p GROUP BY k) "
            "SELECT p.idx, x.completion FROM p LEFT JOIN (SELECT o.idx, r.completion FROM o JOIN r USING (k)) x ON p.idx = x.idx"
        ),
        "pair_csv_roundtrip": f"SELECT correct, typos FROM {pairs}",
    }


def queries() -> dict:
    return {
        "chat_records": q_chat_records,
        "short_prompt": q_short_prompt,
        "reasoning_prompt": q_reasoning_prompt,
        "template_render": q_template_render,
        "nth_role_message": q_nth_role_message,
        "drop_last_message": q_drop_last_message,
        "backtick_payload": q_backtick_payload,
        "prefix_removal": q_prefix_removal,
        "realign_completions": q_realign_completions,
        "pair_csv_roundtrip": q_pair_csv_roundtrip,
    }
