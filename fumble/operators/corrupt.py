"""Passage building and corruption (C1–C10), job ``corrupt``.

``sampled documents -> pairs(pair_id, doc_id, source, round, correct, typos)``.
All randomness is md5-keyed per (document, round[, variant]); there is no
driver state and no per-task generator, so re-running a lost task reproduces
exactly the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.noise import keyboard_noise
from ..functions.text import col_, rand_id, rand_u
from ..sources import files
from . import calls

# Passage length and the request text of the external arm.
PASSAGE_CHARS = 1000
EXTERNAL_REQUEST = "Wprowadź do tekstu jakieś częste literówki: `{text}`"

PAIR_COLUMNS = ["pair_id", "doc_id", "source", "round", "correct", "typos"]


def crop_passage(text: Column | str, doc_id: Column, round_: Column, seed: int = 42,
                 size: int = PASSAGE_CHARS) -> Column:
    """``c = min(size, len)``; start uniform in ``[0, len - c]``; short text whole."""
    text = col_(text)
    n = F.length(text)
    c = F.least(F.lit(size), n)
    start = rand_u(seed, "crop", doc_id, round_) % (n - c + 1)
    return F.substring(text, start + 1, c)


def trim_edge_words(p: Column | str) -> Column:
    """``' '.join(p.split(' ')[1:-1])`` — the text strictly between the first
    and the last single space ('' when there are fewer than two spaces)."""
    p = col_(p)
    first = F.instr(p, " ")
    last = F.length(p) - F.instr(F.reverse(p), " ") + 1
    return F.when(first == 0, F.lit("")).when(last > first, F.substring(p, first + 1, last - first - 1)).otherwise(F.lit(""))


def flatten_newlines(c: Column | str) -> Column:
    """``\\n`` -> space (``\\r`` is left as is)."""
    return F.replace(col_(c), F.lit("\n"), F.lit(" "))


def route_is_noise(doc_id: Column, round_: Column, seed: int = 42, share: float = 0.5) -> Column:
    """``r <= share`` with ``r`` uniform in [0, 1) picks the keyboard arm."""
    return rand_u(seed, "route", doc_id, round_) <= F.lit(int(share * 2**32))


def passage_id(doc_id: Column, round_: Column, seed: int = 42, variant: Column | None = None) -> Column:
    keys = [doc_id, round_] + ([variant] if variant is not None else [])
    return rand_id(seed, "pair", *keys)


def external_requests(passages: DataFrame, passage_col: str = "passage") -> DataFrame:
    """The request text for the external corruption arm, one per passage."""
    before, after = EXTERNAL_REQUEST.split("{text}")
    return passages.select("pair_id", F.concat(F.lit(before), F.col(passage_col), F.lit(after)).alias("request"))


def make_passages(sampled: DataFrame, seed: int = 42, trim: bool = True,
                  size: int = PASSAGE_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """C1 (+ C2 when ``trim``): one passage per sampled (document, round).

    ``keep`` names extra input columns carried to the output (e.g. ``lang``).
    """
    if "round" not in sampled.columns:
        sampled = sampled.withColumn("round", F.lit(0))
    d, r = F.col("doc_id"), F.col("round")
    passage = crop_passage("text", d, r, seed, size)
    if trim:
        passage = trim_edge_words(passage)
    return sampled.select(
        passage_id(d, r, seed).alias("pair_id"), "doc_id", "source", "round", *keep, passage.alias("passage")
    )


def noise_variants(passages: DataFrame, n: int, prob: float = 0.1, seed: int = 0,
                   passage_col: str = "passage", impl: str = "arrow") -> DataFrame:
    """C4: ``n`` independent noisy variants per passage (``variant`` 0..n-1)."""
    v = passages.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = F.concat_ws(":", F.col("pair_id").cast("string"), F.col("variant").cast("string"))
    return v.withColumn("typos", keyboard_noise(F.col(passage_col), key, prob=prob, seed=seed, impl=impl))


def build_pairs(
    sampled: DataFrame,
    external: DataFrame | None = None,
    seed: int = 42,
    noise_seed: int = 0,
    prob: float = 0.1,
    trim: bool = True,
    noise_share: float = 0.5,
    keep: tuple[str, ...] = (),
    impl: str = "arrow",
) -> tuple[DataFrame, DataFrame]:
    """Passages, routed corruption, newline flattening."""
    passages = make_passages(sampled, seed=seed, trim=trim, keep=keep)
    return pairs_of_passages(passages, external, seed, noise_seed, prob, noise_share, keep, impl)


def pairs_of_passages(
    passages: DataFrame,
    external: DataFrame | None = None,
    seed: int = 42,
    noise_seed: int = 0,
    prob: float = 0.1,
    noise_share: float = 0.5,
    keep: tuple[str, ...] = (),
    impl: str = "arrow",
) -> tuple[DataFrame, DataFrame]:
    """C3–C10 on passages: (pairs, quarantine).

    ``external`` is a table ``(doc_id, round, text_with_typos)`` produced
    outside (the remote model call is not part of this engine). Rows routed to
    the external arm without a response are returned in the second DataFrame
    (quarantine) instead of being silently dropped. With ``external=None``
    every row takes the keyboard arm. The join key is the document and round:
    60-bit pair ids meet by chance among very many pairs.

    ``impl`` picks the noise implementation: ``arrow`` (numpy kernel in a
    pandas UDF, ~10× faster) or ``native`` (one Catalyst expression); both
    give identical text (tested on every driver document). The kernel runs on
    rows of the keyboard arm only: for the others its input is null.

    The external table is joined with a plain equi-join; AQE broadcasts it
    when its runtime size is below the broadcast threshold and uses a
    shuffle join otherwise.
    """
    noise_of = lambda text: keyboard_noise(text, F.col("pair_id"), prob=prob, seed=noise_seed, impl=impl)
    # The keyboard arm is null exactly when the passage is null, so the
    # quarantine test never needs the (expensive) noisy text: a filter on it
    # would be pushed below the repartition and run the noise twice.
    if external is None:
        routed = passages.withColumn("typos", noise_of(F.col("passage"))).withColumn("arm", F.lit("keyboard"))
        ok = F.col("passage").isNotNull()
    else:
        ext = external.select("doc_id", "round", "text_with_typos")
        to_noise = route_is_noise(F.col("doc_id"), F.col("round"), seed, noise_share)
        routed = (
            passages.join(ext, on=["doc_id", "round"], how="left")
            .withColumn("arm", F.when(to_noise, F.lit("keyboard")).otherwise(F.lit("external")))
            .withColumn("ok", F.col("passage").isNotNull() & (to_noise | F.col("text_with_typos").isNotNull()))
            .withColumn("typos", F.coalesce(noise_of(F.when(to_noise, F.col("passage"))), F.when(~to_noise, F.col("text_with_typos"))))
            .drop("text_with_typos")
        )
        ok = F.col("ok")
    routed = routed.withColumn("_ok", ok)
    pairs = routed.select(
        "pair_id", "doc_id", "source", "round", *keep,
        flatten_newlines("passage").alias("correct"),
        flatten_newlines("typos").alias("typos"),
        "arm", "_ok",
    )
    return pairs.filter(F.col("_ok")).drop("_ok"), pairs.filter(~F.col("_ok")).drop("_ok")


def apply_prepare(sampled: DataFrame, prepare_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pair builder with a pluggable ``DataFrame -> DataFrame`` step."""
    return sampled.transform(prepare_fn)


PREPARED = T.StructType([T.StructField("correct", T.StringType()), T.StructField("typos", T.StringType())])


def _pair(x: object) -> dict:
    passage, transformed = x
    if not isinstance(passage, str) or not isinstance(transformed, str):
        raise TypeError("a prepared pair is two texts")
    return {"correct": passage, "typos": transformed}


def prepare_rows(docs: DataFrame, step: Callable[..., list], path: str, inputs: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ("doc_id", "source"),
                 call_rows: int = calls.CALL_ROWS) -> tuple[DataFrame, DataFrame]:
    """C8, C9, C10, U2 per row: ``step(**inputs) -> [(passage, transformed), ...]``.

    Documents pass the step once. What it returned and what it raised is written
    below ``path``, parted by outcome; both outputs are read from there:
    (pairs ``(*keep, correct, typos)``, rejected ``(*keep, error)``)."""
    used = list(dict.fromkeys((*keep, *inputs)))
    tagged = calls.with_step(docs.select(*used), step, list(inputs), "prepared", PREPARED, _pair, call_rows)
    rows = tagged.select(*keep, flatten_newlines("prepared.correct").alias("correct"), flatten_newlines("prepared.typos").alias("typos"), "error", F.col("error").isNull().alias("built"))
    files.write_records(rows, path, mode="overwrite", partition_by=["built"])
    back = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return back.filter("built").select(*keep, "correct", "typos"), back.filter("NOT built").select(*keep, "error")
