"""Shared parameters and pair-building steps of the registered queries.

Every registered query reads the driver tables and runs over all of their
rows and whole texts; parameters below are the reference's own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import keyboard_noise, noise_sql_duckdb
from ..operators import corrupt
from ..session import spread, text_session
from ..sources.tables import load

# Reference parameters.
SEED = 42            # sampling, cropping and routing draws
NOISE_SEED = 0       # keyboard-noise draws (the reference seeds its noise with 0)
PROB = 0.1           # keyboard-noise probability
K_PER_SOURCE = 20    # documents per corpus and round
TEST_ROUNDS = 10     # rounds of the test split
EXTERNAL_SEED = 7    # stand-in for the external arm (see external_typos)
EXTERNAL_PROB = 0.2
NOISE_IMPL = "arrow"   # numpy kernel; equal to the Catalyst expression (tests/test_properties.py)
DIST_IMPL = "arrow"    # bit-parallel distance; equal to Catalyst levenshtein (tests/test_properties.py)


def u_sql(salt: str, *keys: str, seed: int = SEED) -> str:
    """DuckDB twin of ``fumble.functions.text.rand_u``."""
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *keys])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT"


def id_sql(salt: str, *keys: str, seed: int = SEED) -> str:
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *keys])
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 15))::UBIGINT)::BIGINT"


# The non-ASCII characters of the documents and of the reward layouts, and as
# many one-byte codes that no text uses: DuckDB's levenshtein counts bytes, so
# its arguments - and nothing else - are mapped one to one before the call.
NON_ASCII = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüąęłś"
ONE_BYTE = "".join(map(chr, [*range(1, 9), *range(14, 32), 127][: len(NON_ASCII)]))


def distance_sql(a: str, b: str) -> str:
    """Code-point edit distance of two DuckDB expressions."""
    one = lambda x: f"translate({x}, '{NON_ASCII}', '{ONE_BYTE}')"
    return f"levenshtein({one(a)}, {one(b)})"


def r6(c):
    """Round a double column to 6 places (oracle comparisons)."""
    return F.round(c, 6)


# ---------------------------------------------------------------- Spark side

def all_passages(spark: SparkSession, sf_dir: str, trim: bool = True) -> DataFrame:
    """One passage per document (round 0): the pair-building input used by the
    scoring and reward queries, over every document.

    Passages are cropped where the documents are read; only they are spread."""
    docs = load(text_session(spark), sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return spread(corrupt.make_passages(docs.withColumn("round", F.lit(0)), seed=SEED, trim=trim, keep=("lang",)))


def all_pairs(spark: SparkSession, sf_dir: str, trim: bool = True) -> DataFrame:
    """Keyboard-noise pairs for every document: (pair_id, doc_id, source, lang, correct, typos)."""
    p = all_passages(spark, sf_dir, trim)
    return p.select(
        "pair_id", "doc_id", "source", "lang",
        corrupt.flatten_newlines("passage").alias("correct"),
        corrupt.flatten_newlines(keyboard_noise(F.col("passage"), F.col("pair_id"), prob=PROB, seed=NOISE_SEED, impl=NOISE_IMPL)).alias("typos"),
    )


def external_typos(passages: DataFrame) -> DataFrame:
    """Stand-in for the external corruption arm's output ``(doc_id, round, text_with_typos)``.

    The reference asks a hosted model for the passages routed to it; that call
    is not part of this engine. The responses are derived by Spark from those
    passages (a second keyboard pass with its own seed and rate), so the join,
    routing and quarantine run on data that grows with the input.
    """
    return passages.select(
        "doc_id", "round",
        keyboard_noise(F.col("passage"), F.col("pair_id"), prob=EXTERNAL_PROB, seed=EXTERNAL_SEED, impl=NOISE_IMPL).alias("text_with_typos"),
    )


# ---------------------------------------------------------------- SQL side

def passages_sql(trim: bool = True) -> str:
    """DuckDB: one (trimmed) passage per document, round 0."""
    crop = (
        "substr(text, CAST(" + u_sql("crop", "doc_id", "0") + " % (length(text) - least(1000, length(text)) + 1) AS BIGINT) + 1, "
        "least(1000, length(text)))"
    )
    body = (
        f"array_to_string(list_slice(string_split(p0, ' '), 2, len(string_split(p0, ' ')) - 1), ' ')"
        if trim else "p0"
    )
    return (
        f"(SELECT pair_id, doc_id, source, lang, {body} AS passage FROM "
        f"(SELECT {id_sql('pair', 'doc_id', '0')} AS pair_id, doc_id, source, lang, {crop} AS p0 FROM documents))"
    )


def pairs_sql(trim: bool = True) -> str:
    noisy = noise_sql_duckdb("passage", "CAST(pair_id AS VARCHAR)", prob=PROB, seed=NOISE_SEED)
    correct = "replace(passage, chr(10), ' ')"
    typos = f"replace({noisy}, chr(10), ' ')"
    return (
        f"(SELECT pair_id, doc_id, source, lang, {correct} AS correct, {typos} AS typos "
        f"FROM {passages_sql(trim)})"
    )
