"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fumble.llm import chat, exact_dedup, jaccard_join, lm_scoring, mixing, packing, periodic_runs, quality_classifier, quality_rules, records, spelling, sql, url_filter, warc
from fumble.llm.shared import keep, table
from fumble.session import BATCH_ROWS, session_with

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, keep(url_filter.spam_list(pages), "url-list"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_conversations(chat.with_adversary(table(spark, sf_dir, "conversations"))))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = session_with(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS))
    return lm_scoring.lm_score(table(texts, sf_dir, "documents"), WORD_TOKENIZER)


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_repeats(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_classifier, op2_url_filter, op3_exact_dedup, op4_mixing, op5_quality_rules, op6_chat_formatting,
        op7_jaccard_join, op8_best_fit_packing, op9_token_records, op10_lm_scoring, op11_warc_archives, op12_spelling_variants, op13_periodic_runs,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": sql.url_filter(),
        "op3_exact_dedup": sql.exact_dedup(),
        "op5_quality_rules": sql.quality_rules(),
        "op6_chat_formatting": sql.chat_formatting(),
        "op7_jaccard_join": sql.jaccard_join(),
        "op11_warc_archives": sql.warc_archives(),
    }
